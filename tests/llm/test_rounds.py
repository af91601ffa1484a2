"""Byte-level BPE, periodic runs and the prefix trie against brute force, with the edge cases of each."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from aerolake.llm import bytebpe, periodic, prefixes, queries
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 40), (5, "xy" * 3000), (5, "xy" * 3000), (6, "don't <|endoftext|> É 42\x1c\x85  \U0001f600  "), (7, "w v u " * 5000), (8, "1" * 4000)]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def edges(spark):
    """Extra columns bear the names of results and of columns used inside."""
    return spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({c: F.lit(i) for i, c in enumerate(("n_tokens", "p_text", "words", "decoded"))})


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = queries.rank_file()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})


def encoded(library, rows):
    ids = [(d, library.encode_ordinary(t or ""), t or "") for d, t in rows]
    return sorted(((d, len(i), sha(np.array(i, "<u4").tobytes()), sha(t)) for d, i, t in ids), key=repr)


def test_byte_bpe_query_equals_the_library(spark, documents, library):
    assert sorted((tuple(r) for r in queries.op11_byte_bpe(spark, FOLDER).collect()), key=repr) == encoded(library, documents)


def test_byte_bpe_edges_and_round_trip(spark, edges, library):
    made = bytebpe.encode(edges, *queries.rank_file())
    assert made.columns == ["doc_id", "p_text", "words", "decoded", "n_tokens", "ids_sha256", "decoded_sha256", "input_ids"]
    assert sorted((tuple(r) for r in made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr) == encoded(library, EDGES)
    back = bytebpe.decode(made, *queries.rank_file())
    assert sorted((repr((r.doc_id, bytes(r.decoded).decode())) for r in back.collect())) == sorted(repr((d, t or "")) for d, t in EDGES)
    assert bytebpe.encode(edges.limit(0), *queries.rank_file()).count() == 0


@pytest.mark.parametrize("memory", [1, 7, 10_000])
def test_byte_bpe_any_memory_and_text(library, memory):
    encoder, dice = bytebpe.ByteEncoder(*queries.rank_file(), memory), random.Random(memory)
    for size in (0, 1, 2, 3, 9, 64, 65, 700):
        for alphabet in ("ab", "aeinorst ", "é中\U0001f600x", "0123 .,'s\n\t"):
            text = "".join(dice.choice(alphabet) for _ in range(size))
            ids = encoder.encode(text)
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and encoder.decode(ids).decode() == text


def test_merges_of_a_toy_vocabulary_are_leftmost_lowest():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    assert bytebpe.merge(b"aaab", ranks) == [2, 3] and bytebpe.merge(b"aab", ranks) == [4] and bytebpe.merge(b"aaa", ranks) == [2, 0]


# Periodic runs


def brute_runs(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((b, q, e - b) for (b, e), q in found.items())


def brute_collapse(words):
    runs = brute_runs(words)
    gone = {i for b, q, n in runs for i in range(b + q, b + n)}
    best = max(runs, key=lambda r: (r[2] / r[1], -r[0], -r[1])) if runs else None
    return runs, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(dice):
    out, size = [], dice.choice([0, 5, 23, 24, 60, 200])
    while len(out) < size:
        p = dice.randrange(1, max(2, size // 4))
        root = dice.choice([[dice.randrange(40) for _ in range(p)], [0] * p + [1], ([2, 3] * p)[:p] + [7], [5] * (p // 2) + [6] + [5] * (p // 3) + [8]])
        out += root * dice.choice([1, 2, 3, 3, 4]) + root[: dice.randrange(len(root) + 1)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    dice = random.Random(seed)
    for _ in range(60):
        texts = [some_words(dice) for _ in range(dice.randrange(1, 6))]
        first = np.cumsum([0, *map(len, texts)])
        for least in (24, 3):
            start, end, period = periodic.find_runs(np.array([w for t in texts for w in t], np.int64), first, least)
            want = sorted((b + int(first[i]), q, n) for i, t in enumerate(texts) for b, q, n in brute_runs(t, least))
            assert sorted(zip(start.tolist(), period.tolist(), (end - start).tolist())) == want


def test_periodic_query_equals_brute_force(spark, documents):
    want = []
    for doc_id, text in documents:
        words = (text or "").encode().split()
        order = queries.repeated_words(doc_id, len(words))
        words = [w.decode() for w in (words if order is None else [words[i] for i in order])]
        if len(words) > 3000:
            continue  # the brute force is quadratic
        runs, best, left = brute_collapse(words)
        start, q, n = best or (None, None, None)
        want.append((doc_id, len(runs), start, n, q, None if best is None else 1000 * n // q, sha("".join(f"{b},{k},{p}\n" for b, p, k in runs)), sha(left)))
    short = {w[0] for w in want}
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, FOLDER).collect()]
    assert len(got) == len(documents) and sorted((g for g in got if g[0] in short), key=repr) == sorted(want, key=repr)
    assert any(w[1] for w in want)


def test_periodic_edges(spark, edges):
    made = periodic.collapse(edges)
    assert made.columns == ["doc_id", "n_tokens", "words", "decoded", "p_runs", "p_best", "p_text"]
    rows = {(r.doc_id, len(r.p_runs), r.p_text) for r in made.collect()}
    assert {(1, 0, ""), (2, 0, ""), (3, 0, ""), (None, 1, "a b"), (7, 1, "w v u"), (8, 0, "1" * 4000)} <= rows and made.count() == len(EDGES)
    assert periodic.collapse(edges.limit(0)).count() == 0


def test_best_run_breaks_ties_by_start():
    assert periodic._best([(0, 30, 10), (5, 6, 2), (40, 24, 2), (50, 24, 2)]) == {"start": 40, "length": 24, "period": 2} and periodic._best([]) is None


# Prefix trie


def brute_trie(rows):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            given[conv].append((turn is not None, turn or 0, role or "", text or ""))
    given = {c: [t[2:] for t in sorted(turns)] for c, turns in given.items()}
    built = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = given.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members, children, out = defaultdict(list), defaultdict(set), {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    for node in sorted(members, key=len, reverse=True):
        here, below = members[node], [out[n] for n in children[node]]
        saved = sum(b[6] for b in below) + ((len(here) - 1) * len(node[-1][1]) if node else 0)
        ends = ",".join(map(str, sorted(c for c in here if len(built[c]) == len(node))))
        out[node] = (min(here), len(node), min(members[node[:-1]]) if node else None, len(here), len(below), sum(b[5] for b in below) or 1, saved, sha(ends))
    return sorted(out.values(), key=repr)


def trie_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"k1": F.lit(1), "depth": F.lit("x")}).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r[c] for c in prefixes.COLUMNS) for r in queries.op13_prefix_trie(spark, str(tmp_path)).collect()), key=repr)


def talks(seed):
    dice, rows = random.Random(seed), [(None, 0, "user", "x"), (None, 1, "user", "x")]
    for conv in [*range(40), *range(100, 160), *range(201, 230)]:
        turns = [("user", "hi"), ("assistant", "yo" * 9)] * 6
        turns = turns[: dice.randrange(13)] if dice.random() < 0.4 else [(dice.choice(["user", None]), dice.choice(["a", "b", "", None])) for _ in range(dice.randrange(1, 8))]
        rows += [(conv, i if dice.random() < 0.95 else None, *t) for i, t in enumerate(turns)]
    return rows + rows[5:9]  # repeated rows


@pytest.mark.parametrize("bits", [15, 3])
def test_trie_equals_brute_force(spark, tmp_path, monkeypatch, bits):
    """A sketch with room for all prefixes, and one that is full."""
    monkeypatch.setattr(prefixes, "MIN_CELL_BITS", min(bits, 15))
    monkeypatch.setattr(prefixes, "MAX_CELL_BITS", bits)
    rows = talks(bits)
    assert trie_of(spark, tmp_path, rows) == brute_trie(rows)


def test_trie_in_the_split_plan(spark, tmp_path, small_tasks):
    rows = talks(1) + [(7, i, "user", "long") for i in range(200)] + [(160, i, "user", "long") for i in range(200)]
    assert trie_of(spark, tmp_path, rows) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark, tmp_path):
    assert trie_of(spark, tmp_path / "none", []) == []
    one = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)  # its base is absent and it loses its only turn
    assert trie_of(spark, tmp_path / "one", [(one, 0, "user", "x")]) == [(one, 0, None, 1, 0, 1, 0, sha(str(one)))]
