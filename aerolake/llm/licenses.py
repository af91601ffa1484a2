"""License scans: windows of a text against license templates by the Dice coefficient over word bigrams.

Any window of words may be a match, whatever lines it is on. From every place that holds a bigram of a template the
window is walked on once, word by word, with running numbers of its distinct bigrams and of those it shares with the
template, and the end with the best coefficient is kept (the nearest of equal ones). Of what bounds a coefficient of
at least t by the sizes of both sides follows that a text must hold n * t / (2 - t) of a template's n bigrams, or it
is done after one look at its bigrams; that so many must lie near a start; and that a walk ends after
s * (2 - t) / t words, s being the template's length: a window that repeats itself beyond that is not looked at. No size
in between is left out, and the walks of a text grow with its length alone. Everything is one narrow projection of array
expressions; the templates are a literal of known size.

Windows that overlap are settled in two sweeps. In the order of the text (start, then the better, the longer and the
first by name) a window goes if the kept ones of no lower coefficient that begin before it hold more than half of
it; then from the end of the text a window goes if those before it and any one of no lower coefficient behind it do.

Defined results: a null or empty text has no license; a text of fewer than two words has no bigrams and matches
nothing; of templates with the same coefficient on the same words the first by name wins; repeated
rows give a row each; an empty table gives an empty table; other columns are carried along, but for one
named l_matches, which is replaced. The ``unit`` of a match is its words in lower case.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.license_texts import BODIES
from aerolake.llm.tables import without

MIN_DICE = 0.8
#: The literal of templates may hold so many bigrams in all.
MAX_TEMPLATE_BIGRAMS = 200_000
#: Least number of windows that are swept together: a fold copies its state, so that what is kept must not grow within it.
BLOCK = 64

#: Notices that name public licenses, and the wording of the short ones.
NOTICES = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "EPL-2.0": (
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
}
#: The notices together with the paragraphs of the long licenses.
TEMPLATES = {name: (*NOTICES.get(name, ()), *BODIES.get(name, ())) for name in sorted({*NOTICES, *BODIES})}


def _words(unit: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")


def _pairs(words: Column) -> Column:
    """64-bit hashes of the neighbouring words, in the order of the text."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def template_rows(spark: SparkSession, templates: dict[str, tuple[str, ...]], min_dice: float) -> list[dict]:
    """What a scan needs of every template; refuses more than ``MAX_TEMPLATE_BIGRAMS``.

    A unit that reaches ``min_dice`` holds at least ``need`` of a template's n bigrams, so that it holds one of any
    n - need + 1 of them: ``keys`` are as many of the rarest. Rare is what few templates hold, and what is long; a bad
    guess costs time and no matches.
    """
    listed = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
    texts = F.array(*[F.lit(text) for _, text in listed])
    made = spark.range(1).select(F.transform(texts, lambda t: F.struct(_words(t).alias("w"), _pairs(_words(t)).alias("g"))).alias("t")).first()["t"]
    common = Counter(g for t in made for g in set(t["g"]))
    if sum(len(set(t["g"])) for t in made) > MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"license templates of more than {MAX_TEMPLATE_BIGRAMS} bigrams")
    rows = []
    for (name, _), t in zip(listed, made):
        length = {g: len(a) + len(b) for g, a, b in zip(t["g"], t["w"], t["w"][1:])}
        if not length:
            continue
        n, span, least = len(length), len(t["g"]), min_dice / (2 - min_dice)
        need = max(1, math.ceil(n * least - 1e-9))
        rare = sorted(length, key=lambda g: (common[g], -length[g], g))
        rows.append({"name": name, "need": need, "reach": math.ceil(span / least), "grams": list(length), "keys": rare[: n - need + 1]})
    return rows


_TEMPLATE = "array<struct<name:string,need:int,reach:int,grams:array<bigint>,keys:array<bigint>>>"
_WINDOW = "struct<a:int,b:int,dice:double,template:int,held:int>"


def _earlier(pairs: Column) -> Column:
    """For every bigram of the text the place where it stood before, or -1."""
    def linked(order: Column) -> Column:
        return F.transform(order, lambda o, k: F.struct(o["i"].alias("i"), F.when(F.get(order, k - 1)["g"] == o["g"], F.get(order, k - 1)["i"]).otherwise(-1).alias("p")))

    placed = F.array_sort(F.transform(pairs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.array_sort(_let(placed, linked))["p"]


def _windows(pairs: Column, earlier: Column, t: Column, number: Column, min_dice: float) -> Column:
    """The best window from every start for one template and its number, if it reaches ``min_dice``; it holds the bigrams a to b - 1."""
    def walked(p: Column, spots: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            new = x["p"] < p
            met = new & x["t"]
            seen, shared = s["seen"] + new.cast("int"), s["shared"] + met.cast("int")
            dice = 2.0 * shared / (F.size(t["grams"]) + seen)
            better = met & (dice > s["dice"])
            return F.struct((s["i"] + 1).alias("i"), seen.alias("seen"), shared.alias("shared"),
                            F.when(better, s["i"] + 1).otherwise(s["b"]).alias("b"), F.when(better, dice).otherwise(s["dice"]).alias("dice"))

        first = F.struct(p.alias("i"), F.lit(0).alias("seen"), F.lit(0).alias("shared"), p.alias("b"), F.lit(0.0).alias("dice"))
        return F.reduce(F.slice(spots, p + 1, t["reach"]), first, step, lambda s: F.struct(
            p.alias("a"), s["b"].alias("b"), s["dice"].alias("dice"), number.alias("template"), F.lit(0).alias("held")))

    def from_starts(spots: Column) -> Column:
        def near(at: Column) -> Column:
            starts = F.filter(at, lambda p, k: F.coalesce(F.get(at, k + t["need"] - 1) - p < t["reach"], F.lit(False)))
            return F.filter(F.transform(starts, lambda p: walked(p, spots)), lambda w: w["dice"] >= min_dice)

        return _let(F.array_compact(F.transform(spots, lambda x, i: F.when(x["t"], i))), near)

    return _let(F.transform(pairs, lambda g, i: F.struct(F.get(earlier, i).alias("p"), F.array_contains(t["grams"], g).alias("t"))), from_starts)


def _swept(windows: Column, held: Callable[[Column, Column], Column], live: Callable[[Column, Column], Column]) -> Column:
    """The windows of which kept ones hold no more than half. ``held(active, w)`` is what they hold of one, ``live(v, w)``
    tells whether a kept one can still meet windows from w on."""
    none = F.array().cast(f"array<{_WINDOW}>")

    def add(s: Column, w: Column) -> Column:
        active = F.filter(s["active"], lambda v: live(v, w))
        n = held(active, w)
        kept = F.array(F.struct(w["a"].alias("a"), w["b"].alias("b"), w["dice"].alias("dice"), w["template"].alias("template"), n.alias("held")))
        return F.when(2 * n > w["b"] - w["a"], s).otherwise(F.struct(F.concat(s["kept"], kept).alias("kept"), F.concat(active, kept).alias("active")))

    def add_block(s: Column, block: Column) -> Column:
        return F.reduce(block, F.struct(none.alias("kept"), s["active"].alias("active")), add,
                        lambda x: F.struct(F.concat(s["kept"], x["kept"]).alias("kept"), x["active"].alias("active")))

    def in_blocks(all_: Column) -> Column:
        size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(all_))).cast("int"))
        places = F.sequence(F.lit(0), F.floor(F.size(all_) / size).cast("int"))
        blocks = F.transform(places, lambda k: F.slice(all_, k * size + 1, size))
        return F.reduce(blocks, F.struct(none.alias("kept"), none.alias("active")), add_block, lambda s: s["kept"])

    return _let(windows, in_blocks)


def _settled(windows: Column, reach: Column) -> Column:
    """The windows that stay after both sweeps, in the order of the text."""
    def before(active: Column, w: Column) -> Column:
        ends = F.transform(F.filter(active, lambda v: v["dice"] >= w["dice"]), lambda v: F.least(v["b"], w["b"]) - w["a"])
        return F.coalesce(F.array_max(ends), F.lit(0))

    def behind(active: Column, w: Column) -> Column:
        rest = F.transform(F.filter(active, lambda v: v["dice"] >= w["dice"]), lambda v: F.least(v["b"], w["b"]) - F.greatest(v["a"], w["a"] + w["held"]))
        return w["held"] + F.greatest(F.coalesce(F.array_max(rest), F.lit(0)), F.lit(0))

    order = F.array_sort(F.transform(windows, lambda w: F.struct(w["a"].alias("a"), (-w["dice"]).alias("d"), (-w["b"]).alias("b"), w["template"].alias("n"), w.alias("w"))))["w"]
    forth = _swept(order, before, lambda v, w: v["b"] > w["a"])
    return F.reverse(_swept(F.reverse(forth), behind, lambda v, w: v["a"] < w["a"] + reach))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, tuple[str, ...]] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """The documents without their text, with ``l_matches``: array<struct<dice, license, unit>>, the matching windows in
    the order of the text."""
    docs = without(docs, ["l_matches"])
    rows = template_rows(docs.sparkSession, TEMPLATES if templates is None else templates, min_dice)
    known = F.from_json(F.lit(json.dumps(rows)), _TEMPLATE)
    keys = sorted({k for r in rows for k in r["keys"]})

    def matches(words: Column, pairs: Column, near: Column) -> Column:
        found = _let(_earlier(pairs), lambda e: F.flatten(F.transform(near, lambda t, i: _windows(pairs, e, t, i, min_dice))))
        return F.transform(_settled(found, F.array_max(near["reach"])), lambda w: F.struct(
            w["dice"].alias("dice"), F.get(near, w["template"])["name"].alias("license"), F.array_join(F.slice(words, w["a"] + 1, w["b"] - w["a"] + 1), " ").alias("unit")))

    def searched(words: Column) -> Column:
        def look(pairs: Column) -> Column:
            met = F.array_distinct(F.filter(pairs, lambda g: g.isin(keys)))
            near = _let(met, lambda m: F.filter(known, lambda t: F.arrays_overlap(t["keys"], m) & (F.size(F.array_intersect(t["grams"], pairs)) >= t["need"])))
            return _let(near, lambda n: F.when(F.size(n) > 0, matches(words, pairs, n)))

        return _let(_pairs(words), look)

    found = F.coalesce(_let(_words(F.coalesce(F.col(text), F.lit(""))), searched), F.array().cast("array<struct<dice:double,license:string,unit:string>>"))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], found.alias("l_matches"))


def scan_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_matches, licenses, best_license, best_dice): a row per document."""
    found = scan(docs.select("doc_id", "text"))
    best = F.array_max(F.transform("l_matches", lambda m: F.struct(m["dice"], m["license"])))
    return found.select("doc_id", F.size("l_matches").cast("long").alias("n_matches"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("l_matches", lambda m: m["license"]))), ",").alias("licenses"),
                        best["license"].alias("best_license"), best["dice"].alias("best_dice"))
