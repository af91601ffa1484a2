"""The methods against brute force, and the registered queries on the smallest tables."""

import base64
import hashlib
import random

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from aerolake.llm import bpe, components, licenses, lines, minhash, ngram, pii, quality, queries, text
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)


def test_words_and_hashes():
    texts = text.Texts(pa.array(["Ab cd", None, "", "é\tx\n", "ab", "cd "]), lower=True)
    texts.words()
    assert np.diff(texts.first).tolist() == [2, 0, 0, 2, 1, 1]
    h = texts.word_hashes()
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 4


def test_slices_bound_their_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 90, 200, 1, 1)])], names=["t"])
    parts = list(text.slices(batch, "t", 100))
    assert sum(p.num_rows for p in parts) == 5 and all(sum(len(x.as_py()) for x in p.column(0)[1:]) < 100 for p in parts)


# -- quality ----------------------------------------------------------------------------------------------------------

def test_hosts_are_judged_and_shrunk(spark):
    """A large bad host goes with its good documents, a host with one bad document stays."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "bad", "x" if i % 10 else good + str(i)) for i in range(200)]
    rows += [(1000 + i, f"h{i % 40}", f"{good} {i}") for i in range(4000)] + [(9000, "tiny", "x"), (9001, "tiny", good)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id for r in quality.judge(docs).filter("q_kept").select("doc_id").collect()}
    assert not [d for d in kept if d < 200] and 9001 in kept and len([d for d in kept if 1000 <= d < 9000]) == 4000
    assert {r.doc_id for r in quality.keep_good(docs).select("doc_id").collect()} == kept


# -- near duplicates --------------------------------------------------------------------------------------------------

def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 2**63, 300).astype(np.uint64)
    for scale in (1.0, 7.0, 0.05):
        a, b = rng.random(300) * scale * rng.integers(1, 9, 300), rng.random(300) * scale * rng.integers(1, 9, 300)
        b[:200] = a[:200]
        k = 1024
        owner = np.repeat([0, 1], 300)
        signed = minhash.dart_signatures(owner, np.concatenate([keys, keys]), np.concatenate([a, b]), 2, k=k)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((signed[0] == signed[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)


def test_signature_is_the_earliest_dart_of_each_coordinate():
    """Throwing on to far higher ranks changes nothing, and order of elements does not matter."""
    rng = np.random.default_rng(2)
    keys, weight = rng.integers(1, 2**63, 40).astype(np.uint64), rng.integers(1, 20, 40).astype(float)
    one = minhash.dart_signatures(np.zeros(40, int), keys, weight, 1)
    by = rng.permutation(40)
    assert (one == minhash.dart_signatures(np.zeros(40, int), keys[by], weight[by], 1)).all()
    far = minhash.dart_signatures(np.repeat([0, 1], [40, 1]), np.append(keys, np.uint64(5)), np.append(weight, 1.0), 2)
    assert (one[0] == far[0]).all()


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("weighting", ["presence", "count"])
def test_near_classes(spark, weighting):
    """A large group of near copies around two centers, pairs near the threshold, exact copies, short texts."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    other = base[:200] + [f"v{i}" for i in range(60)]
    texts = [edited(rng, base, rng.randrange(0, 8)) for _ in range(120)] + [edited(rng, other, rng.randrange(0, 6)) for _ in range(60)]
    texts += [edited(rng, [f"u{i}.{j}" for j in range(100)], k) for i in range(30) for k in (0, 1, 2, 3, 4)]
    texts += ["one two", "one two", "one two three", "", None, " ".join(["again and again"] * 50), " ".join(["again and again"] * 51)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, weighting=weighting).collect()}
    assert got == brute.near_classes(rows, weighted=weighting == "count")


def texts_of_one_center():
    """Texts 1 and 2 are near each other, not the center 0: they only share buckets that it is in, and no band of their differences from it."""
    core = [f"c{i}" for i in range(204)]
    shared = lambda i: core + [f"s{i}.{k}" for k in range(27)]
    texts = [" ".join(core)] + [" ".join(shared(1762) + [f"{n}1762.{k}" for k in range(25)]) for n in "xy"]
    return list(enumerate(texts + [" ".join(shared(i) + [f"x{i}.{k}" for k in range(25)]) for i in range(20)]))


def test_links_between_members_of_one_center(spark):
    rows = texts_of_one_center()
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_classes(rows)
    assert got[1] == got[2] != got[0]


def test_pipeline_drops_members_near_each_other(spark):
    rows = texts_of_one_center()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()}
    assert kept == set(brute.near_classes(rows).values()) and 1 in kept and 2 not in kept


@pytest.mark.parametrize("weighting", ["presence", "count"])
def test_members_far_apart_make_no_keys(spark, monkeypatch, weighting):
    """Copies of a center and a text that holds it in many more words: their distances from it tell that they are not similar, so no key is told."""
    made, whole = [], minhash.prefixes
    monkeypatch.setattr(minhash, "prefixes", lambda *args: made.append(whole(*args)) or made[-1])
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:98], f"a{i}", f"b{i}"]) for i in range(20)] + [" ".join(base + [f"far{i}" for i in range(60)])]
    rows = list(enumerate([" ".join(base), *texts]))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weighting=weighting).collect()}
    assert got == brute.near_classes(rows, weighted=weighting == "count") and len(set(got.values())) == 2
    assert len(made) == 1 and made[0].count() == 0


@pytest.mark.parametrize("weighting", ["presence", "count"])
@pytest.mark.parametrize("cell", [3, 2000])
def test_keys_of_many_members(spark, monkeypatch, weighting, cell):
    """Members that hold the same keys are met in several cells, to the same classes."""
    monkeypatch.setattr(minhash, "CELL_ROWS", cell)
    rng = random.Random(8)
    base = [[f"w{i}.{j}" for j in range(9)] for i in range(14)]
    texts = [" ".join(w for i, block in enumerate(base) for w in (block if i in kept else [f"v{i}.{j}" for j in range(9)]) * rng.choice((1, 1, 2)))
             for kept in (rng.sample(range(14), rng.randrange(8, 15)) for _ in range(160))]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weighting=weighting).collect()}
    want = brute.near_classes(rows, weighted=weighting == "count")
    assert got == want and 20 < len(set(want.values())) < 150


@pytest.mark.parametrize("most", [2**19, 4])
def test_only_texts_that_may_be_wanted_are_shuffled(spark, monkeypatch, most):
    """All wanted texts pass, unless the screen is full few others do; and it needs no shuffle of the texts."""
    monkeypatch.setattr(minhash, "SCREEN_WORDS", most)
    texts = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("m_print"), F.col("id").alias("m_doc"), F.lit("text").alias("m_text"))
    wanted = minhash.cut(texts.filter("m_doc % 40 = 0").drop("m_text"))
    got = minhash.screened(texts, wanted)
    assert got.columns == texts.columns and got.join(wanted, ["m_print", "m_doc"]).count() == 100
    assert got.count() == got.distinct().count() < (600 if most > 4 else 4000)
    assert "m_text" not in " ".join(line for line in got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines() if "hashpartitioning" in line)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 180)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(600)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


# -- language model ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_follow_the_definition(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("a b c d A é x1 x2 x3 x4".split()) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in ngram.score_documents(docs, order=order, block_bytes=500, bucket_bytes=900).collect()}
    for want in brute.lm_scores(rows, order, ngram.MU):
        assert got[want[0]][:5] == want[:5] and got[want[0]][5:] == pytest.approx(want[5:], rel=1e-9)


def test_model_is_better_than_the_base_on_held_out_texts(spark):
    held = queries.op3_lm_score(spark, FOLDER).filter("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert held.m > held.b


# -- lines ------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("min_words", [3, 9, 50])
def test_repeated_lines(spark, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(f"t{rng.randrange(99)}" for _ in range(rng.randrange(0, 9))) for _ in range(40)]
    rows = []
    for d in range(60):
        out = []
        while len(out) < rng.randrange(5, 60):
            at = rng.randrange(40)
            out += pool[at : at + rng.randrange(1, 14)] if rng.random() < 0.6 else [f"own {d} {len(out)} {rng.random()}"]
        rows.append((d, "\n".join(out)))
    rows += [(100 + i, "\n".join(["head line that all have"] + [f"next {i % 7} a b c d e f g"] * 2)) for i in range(60)] + [(200, "\n".join(["same again"] * 80)), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_repeats(docs, min_words).collect()}
    assert got == brute.drop_repeats(rows, min_words)


def test_ranks_are_the_suffix_order(spark):
    """Ranks by 2^k lines tell suffixes apart exactly as their first 2^k lines do, and order them the same way each round."""
    rng = random.Random(9)
    rows = [(d, "\n".join(rng.choice("abc") + " word" for _ in range(25))) for d in range(12)]
    ranked = lines.suffix_ranks(lines.repeated_stretches(spark.createDataFrame(rows, "doc_id long, text string"), 8), 8).collect()
    texts = {d: t.split("\n") for d, t in rows}
    for k in range(4):
        groups = {}
        for r in ranked:
            groups.setdefault((r.s_id, r.ranks[k]), set()).add(tuple(texts[r.s_doc][r.s_at : r.s_at + 2**k]))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


# -- licenses, personal data, tokens ------------------------------------------------------------------------------------

def test_license_matches(spark):
    import re

    def grams(t):
        w = [x for x in re.sub(r"[\W_]+", " ", t.lower()).split() if x]
        return set(zip(w, w[1:]))

    rows = [(1, "intro\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, "licensed UNDER the apache license version 2.0"), (4, "The MIT people"),
            (5, "x\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated documentation files (the \"Software\"), to deal in the "
                "Software without restriction, including without\nlimitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the\nSoftware, "
                "and to permit persons to whom the Software is furnished to do so, subject to these conditions:\n\ny"),
            (6, "This work is licensed under the GNU General Public License, version 3."), (7, "This work is licensed under the GNU General Public License, version 2.")]
    got = {r.doc_id: r for r in licenses.scan_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.best_license for d, r in got.items()} == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "Apache-2.0", 4: None, 5: "MIT", 6: "GPL-3.0", 7: "GPL-2.0"}
    for d, unit in ((2, rows[1][1]), (3, rows[2][1])):
        best = max(2 * len(grams(unit) & grams(t)) / (len(grams(unit)) + len(grams(t))) for ts in licenses.TEMPLATES.values() for t in ts)
        assert got[d].best_dice == pytest.approx(best)


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""


def test_licenses_stand_in_any_layout(spark):
    """A wrapped grant between any kind of line breaks, and notices inside a line or across lines."""
    rows = [(1, f"Title\n\n{MIT_GRANT}\n\nmore"), (2, f"Title\n\n{MIT_GRANT}\n\nmore".replace("\n", "\r\n")), (3, f"Title\n \n{MIT_GRANT}\n\t\nmore"), (4, MIT_GRANT),
            (5, f"some code here\n# {MIT_GRANT}\nand more of it".replace("\n", "\n# ")), (6, "see the file for details Released under the MIT License. and a lot of other words behind it"),
            (7, "a line before\nthis one is Licensed under\nthe Apache License, Version 2.0.\nand one behind"), (8, "under the sea, permission to use the software\n" * 3),
            (9, "released\tunder\tthe\tMIT\tlicense"), (10, "x Licensed under CC BY-NC 4.0. y z\n" * 3)]
    got = {r.doc_id: r.l_matches for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: [m.license for m in x] for d, x in got.items()} == {
        **dict.fromkeys((1, 2, 3, 4, 5, 6, 9), ["MIT"]), 7: ["Apache-2.0"], 8: [], 10: ["CC-BY-NC-4.0"] * 3}
    assert all(m.dice == pytest.approx(1.0) for d in (1, 2, 3, 4, 6, 7, 9) for m in got[d]) and got[5][0].dice > 0.9


def test_license_bodies_are_known(spark):
    import textwrap

    bsd = licenses.NOTICES["BSD-2-Clause"][2:6]
    mpl = licenses.TEMPLATES["MPL-2.0"][20]
    rows = [(1, "Copyright (c) 2020, A. Person\n\n" + "\n\n".join(textwrap.fill(p, 70) for p in bsd)), (2, textwrap.fill(licenses.NOTICES["MIT"][-1], 60)),
            (3, textwrap.fill(licenses.NOTICES["ISC"][-1].upper(), 60)), (4, textwrap.fill(mpl, 72)), (5, "\n".join(textwrap.fill(p, 72) for p in licenses.TEMPLATES["GPL-3.0"])),
            (6, "\n\n".join(textwrap.fill(p, 72) for p in licenses.TEMPLATES["GPL-2.0"])), (7, " ".join(licenses.NOTICES["BSD-3-Clause"][-1].split()))]
    got = {r.doc_id: r for r in licenses.scan_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.licenses for d, r in got.items()} == {1: "BSD-2-Clause", 2: "MIT", 3: "ISC", 4: "MPL-2.0", 5: "GPL-3.0", 6: "GPL-2.0", 7: "BSD-3-Clause"}
    assert got[5].n_matches > 60 and all(r.best_dice == pytest.approx(1.0) for r in got.values())


def test_base_spans():
    rng = random.Random(4)
    alphabet = "a.@-+_% 01234567890123456789()\n"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert [s for s in sorted(pii.proposals(t)) if s[0] in pii.BASE_KINDS] == sorted(brute.base_pii(t)), t
    assert [m[:3] for m in pii.scored("IBAN GB82 WEST 1234 5698 7654 32, SSN 123-45-6789")] == [("iban", 5, 32), ("ssn", 38, 49)]
    assert pii.redacted("to a@b.cd now", pii.scored("to a@b.cd now")) == "to <email> now"


@pytest.mark.parametrize("before, iban, behind", [
    ("IBAN ", "DE89 3704 0044 0532 0130 00", " BIC COBADEFFXXX"), ("", "DE89370400440532013000", " USD 500"), ("pay ", "GB82WEST12345698765432", " 2024"),
    ("", "DE89370400440532013000", " Usd"), ("REF AB12 ", "GB82 WEST 1234 5698 7654 32", " A B C D E F G H I J K L M N O P Q R S T"), ("", "DE89370400440532013000", ""),
    ("", "NO9386011117947", " 12 NOK")])
def test_ibans_end_before_the_words_behind_them(before, iban, behind):
    text_ = before + iban + behind
    assert [(a, b) for k, a, b in pii.proposals(text_) if k == "iban"] == [(len(before), len(before) + len(iban))]
    assert list(pii.ibans(f"{iban} {iban}")) == [(0, len(iban)), (len(iban) + 1, 2 * len(iban) + 1)]
    wrong = iban[:-1] + str((int(iban[-1]) + 1) % 10)
    assert not [s for s in pii.ibans(before + wrong) if s[1] == len(before + wrong)]


def test_personal_data_query(spark, documents):
    got = {r.doc_id: r.base_sha256 for r in queries.op8_pii(spark, FOLDER).collect()}
    assert got == {d: brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_pii(t or ""))) for d, t in documents}


def test_encoding_query(spark, documents, tokenizer):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_bpe(spark, FOLDER).collect()}
    for d, t in documents:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_joins_are_repaired(tokenizer):
    """Texts cut at every place, through words and special tokens, give the tokens of the whole."""
    encoder = bpe.Encoder(queries.vocabulary())
    assert encoder.splits
    rng = random.Random(8)
    for _ in range(150):
        t = "".join(rng.choice(["word", "Étude", " ", "\n", "'s", "42", "<|endoftext|>", "é", "x" * 40, " ", "\u0085", "\x1c", "ß!?", "漢字"]) for _ in range(rng.randrange(1, 40)))
        data = t.encode()
        at = sorted({c for c in (rng.randrange(1, len(data) + 1) for _ in range(6)) if c < len(data) and data[c] & 0xC0 != 0x80})
        got = bpe.encode_text(encoder, data, at)
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert list(map(int, got[1].split())) == ids and got[2].decode() == tokenizer.decode(ids, skip_special_tokens=False), (t, at)


@pytest.mark.parametrize("most", [0, 1, 3, 20])
def test_a_full_memory_of_words_loses_none(tokenizer, monkeypatch, most):
    """Cuts inside CRLF, blank lines and double spaces, with a memory that holds next to no words."""
    monkeypatch.setattr(bpe, "MAX_WORDS", most)
    encoder = bpe.Encoder(queries.vocabulary())
    rng = random.Random(most)
    for _ in range(60):
        t = "".join(f"w{rng.randrange(500)}" + rng.choice(["\r\n", "\n\n", "  ", " "]) for _ in range(rng.randrange(1, 60)))
        data = t.encode()
        inside = [i for i in range(1, len(data)) if data[i - 1 : i + 1].isspace()]
        at = sorted({*rng.sample(inside, len(inside) // 2), *(rng.randrange(1, len(data)) for _ in range(4))})
        got = bpe.encode_text(encoder, data, at)
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert list(map(int, got[1].split())) == ids and got[2].decode() == tokenizer.decode(ids, skip_special_tokens=False), (t, at)


def test_cuts_are_content_defined():
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefg ") for _ in range(30_000)).encode()
    a, b = (np.frombuffer(x + body, np.uint8) for x in (b"", b"shift " * 7))
    one, two = bpe.cuts(a), bpe.cuts(b) - 42
    assert len(one) > 10 and set(one[one > 30]) == set(two[two > 30])
    encoder = bpe.Encoder(queries.vocabulary())
    for data in (a, b):
        bpe.encode_text(encoder, data.tobytes(), bpe.cuts(data).tolist())
    assert encoder.reused_chunks >= len(one) - 2


def test_archive_query(spark, duck):
    pages = duck.execute("SELECT page_id, coalesce(html, '') FROM pages").fetchall()
    largest = {}
    for page, html in pages:
        largest[html] = max(largest.get(html, page), page)
    want = {(p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if largest[h] == p else "revisit", None if largest[h] == p else largest[h]) for p, h in pages}
    assert {tuple(r) for r in queries.op6_warc(spark, FOLDER).collect()} == want


def test_line_and_near_queries(spark, documents):
    assert {r.doc_id: r.text for r in queries.op5_line_dedup(spark, FOLDER).collect()} == brute.drop_repeats(documents)
    assert {r.doc_id: r.class_id for r in queries.op2_near_duplicates(spark, FOLDER).collect()} == brute.near_classes(documents)


# -- pipeline -----------------------------------------------------------------------------------------------------------

def test_pipeline(spark, duck, documents, tokenizer):
    """All stages against their brute-force versions, one after the other."""
    judged = {r[0]: r[1] for r in duck.execute(f"SELECT doc_id, kept FROM ({queries.ORACLES['op4_quality_rules']})").fetchall()}
    rows = [(d, t) for d, t in documents if judged[d]]
    cleaned = brute.drop_repeats(rows)
    rows = [(d, cleaned[d]) for d, t in rows if cleaned[d] == t or brute.WORD.search(cleaned[d])]
    classes = brute.near_classes(rows)
    rows = [(d, t) for d, t in rows if classes[d] == d]
    leaks = duckdb.connect()
    leaks.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    leaks.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    leaks.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{FOLDER}/benchmark.parquet'")
    leaked = {r[0] for r in leaks.execute(f"SELECT doc_id FROM ({queries.ORACLES['op9_decontamination']}) WHERE contaminated").fetchall()}
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in rows if d not in leaked}
    assert {r.doc_id: list(r.input_ids) for r in corpus_pipeline.run(spark, FOLDER).collect()} == want
