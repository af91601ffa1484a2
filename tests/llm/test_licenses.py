"""License windows against a search of every window, and long texts of many notices."""

import random
import re
import time

import pytest
from aerolake.llm import licenses

SCHEMA = "doc_id long, text string"
SMALL = {n: licenses.TEMPLATES[n][:4] for n in ("BSD-3-Clause", "ISC", "MIT", "GPL-3.0")}


def words_of(t):
    return re.findall(r"[^\W_]+", t.lower())


def grams_of(words):
    return list(zip(words, words[1:]))


def every_window(text, templates, t=licenses.MIN_DICE):
    """(a, b, dice, license) of the best window from every start, by sets made anew for every window."""
    pairs, found = grams_of(words_of(text)), []
    for name in sorted(templates):
        for template in templates[name]:
            span = grams_of(words_of(template))
            have, reach = set(span), -int(-len(span) * (2 - t) / t // 1)
            for a in range(len(pairs)):
                if pairs[a] not in have:
                    continue
                sizes = [(2 * len(have & set(pairs[a:b])) / (len(have) + len(set(pairs[a:b]))), -b) for b in range(a + 1, min(a + reach, len(pairs)) + 1)]
                dice, b = max(sizes)
                if dice >= t:
                    found.append((a, -b, dice, name))
    return found


def settled(found):
    """Both sweeps, over lists of all that was kept."""
    forth, back = [], []
    for w in sorted(found, key=lambda w: (w[0], -w[2], -w[1], w[3])):
        inside = {i for v, _ in forth if v[2] >= w[2] for i in range(max(v[0], w[0]), min(v[1], w[1]))}
        if 2 * len(inside) <= w[1] - w[0]:
            forth.append((w, inside))
    for w, inside in reversed(forth):
        most = max((len(inside | set(range(max(v[0], w[0]), min(v[1], w[1])))) for v in back if v[2] >= w[2]), default=len(inside))
        if 2 * most <= w[1] - w[0]:
            back.append(w)
    return back[::-1]


def made_texts(n, seed):
    rng = random.Random(seed)
    pool = [x for ts in SMALL.values() for x in ts]
    filler = "the software of this license and a copy under any person notice word".split()
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(pool).split()
            i = rng.randrange(len(words))
            kind = rng.randrange(5)
            if kind == 1:
                words = words[: i // 6] + words[i // 6 + rng.randrange(1, 8):]
            elif kind == 2:
                words[i:i] = [rng.choice(filler) for _ in range(rng.randrange(1, 12))]
            elif kind == 3:
                words = [w if rng.random() > 0.07 else rng.choice(filler) for w in words]
            elif kind == 4:
                words = words[i:] + words[:i]
            parts += [rng.choice(filler) for _ in range(rng.choice((0, 0, 3, 9)))] + words
        parts += [rng.choice(filler) for _ in range(rng.choice((0, 4)))]
        texts.append("".join(w + rng.choice((" ", " ", " ", "\n", "\r\n", "\n\n", "\n# ")) for w in parts))
    return texts


def test_windows_are_those_of_a_search_of_every_window(spark):
    texts = made_texts(60, 5) + [None, "", "one", "released under the mit license " * 7, "\n".join(["Released under the MIT License."] * 5)]
    got = {r.doc_id: r.l_matches for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), templates=SMALL).collect()}
    for i, text in enumerate(texts):
        words, found = words_of(text or ""), every_window(text or "", SMALL)
        want = [(d, n, " ".join(words[a : b + 1])) for a, b, d, n in settled(found)]
        assert [(m.dice, m.license, m.unit) for m in got[i]] == [(pytest.approx(d), n, u) for d, n, u in want]
        assert bool(got[i]) == bool(found) and max([m.dice for m in got[i]], default=0) == pytest.approx(max([w[2] for w in found], default=0))


def test_grants_inside_other_words_are_all_found(spark):
    """A changed grant at any place of a text has the coefficient of its best window."""
    rng, grant, texts = random.Random(9), licenses.NOTICES["MIT"][3].split(), []
    for i in range(40):
        words = [w if rng.random() > 0.06 else f"x{rng.randrange(99)}" for w in grant]
        texts.append(" ".join([f"f{rng.randrange(50)}" for _ in range(rng.randrange(40))] + words + [f"b{rng.randrange(50)}" for _ in range(rng.randrange(40))]))
    templates = {"MIT": (licenses.NOTICES["MIT"][3],)}
    got = {r.doc_id: r.l_matches for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), templates=templates).collect()}
    for i, text in enumerate(texts):
        best = max((w[2] for w in every_window(text, templates)), default=0)
        assert max((m.dice for m in got[i]), default=0) == pytest.approx(best)


def test_ties_and_repeated_rows(spark):
    templates = {"B": ("one two three four",), "A": ("one two three four",), "C": ("one two three four",)}
    rows = [(1, "x one two three four y")] * 3
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA), templates=templates).collect()
    assert [[tuple(m) for m in r.l_matches] for r in got] == [[(1.0, "A", "one two three four")]] * 3


def test_many_notices_in_one_text(spark):
    spark.range(1).count()
    for text, n in (("Released under the MIT License.\n" * 6_400, 6_400), ("a line of code\nReleased under the MIT License. " * 6_400, 6_400)):
        begun = time.time()
        (got,) = licenses.scan_report(spark.createDataFrame([(1, text)], SCHEMA)).collect()
        print(n, round(time.time() - begun, 1), "s")
        assert (got.n_matches, got.licenses, got.best_dice) == (n, "MIT", 1.0)
