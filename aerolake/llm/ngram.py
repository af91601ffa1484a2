"""Language-model scoring with a weighted backoff automaton.

The model is hierarchical: the probability of a word after a history h is
``(c(h w) + mu * p(w | shorter h)) / (c(h) + mu)``, down to ``(c + 0.1) / (N + 0.1 * (V + 1))`` for the
word alone, which leaves one share for all unknown words. Each level sums to one. As an automaton:
seen n-grams are arcs, histories are states, and what the model gives to unseen words is the weight of
a state's failure arc. A text is read once from left to right; a text begins in the state of the end
token and ends with that token.

How it is distributed. Documents fall into blocks of about ``BLOCK_BYTES``. A block counts its distinct
n-grams, sorted by a 64-bit hash, and sends them to buckets of the hash range: a frequent n-gram is one
entry per block, however often it occurs, so there is no hot key. A bucket adds up its entries and
answers each block with the corpus counts in the block's own order, as differences to its own counts,
which are mostly zero. A block then builds the automaton of the n-grams it can meet, exact for its
texts, and walks all its texts through it, one word of each at a time. No task holds the whole model.

Two different n-grams of a corpus with n distinct ones share a hash with probability n^2 / 2^65.

Defined results: a null text is an empty one (one end token); a null doc_id counts as the empty string
in the split; repeated rows are trained on and scored each; an empty table gives an empty table; with
no training text the base score is 0 and every token is unknown; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.text import Texts, chained, mix
from aerolake.session import cut

ORDER = 2
#: Weight of the shorter history, in words.
MU = 3.0
ADD = 0.1
BLOCK_BYTES = 8_000_000
#: Bytes of text whose n-grams make up a bucket.
BUCKET_BYTES = 16_000_000

_END = np.uint64(0xE17A1465E17A1465)
_CODEC = "zstd"


def _packed(values: np.ndarray) -> bytes:
    """Compressed byte planes: the upper bytes of small numbers are all zero."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.Codec(_CODEC).compress(planes.tobytes(), asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec(_CODEC).decompress(data, n * size, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class Block:
    """The tokens of some texts, each between two end tokens, and their distinct n-grams of every order.

    ``grams[k]``: sorted hashes; ``at[k]``: of every token, the n-gram of order k + 1 that ends there
    (-1 where the text has no such history); ``own[k]``: counts in the training texts of the block.
    """

    def __init__(self, texts: pa.Array, training: np.ndarray, order: int) -> None:
        flat = Texts(texts, lower=True)
        flat.words()
        owner, n = flat.owner(), flat.n
        self.length = np.diff(flat.first) + 1
        self.begin = flat.first[:-1] + 2 * np.arange(n)  # of the end token before the text
        tokens = np.full(len(owner) + 2 * n, _END, np.uint64)
        tokens[np.arange(len(owner)) + 2 * owner + 1] = flat.word_hashes()
        place = np.arange(len(tokens)) - np.repeat(self.begin, self.length + 1)
        counted = np.repeat(training, self.length + 1)
        self.grams, self.at, self.own, self.sample = [], [], [], []
        keys = mix(tokens)
        for k in range(order):
            if k:
                keys[1:] = chained(keys[:-1], tokens[1:])
            real = np.flatnonzero(place >= max(k, 1))
            grams, first, inverse = np.unique(keys[real], return_index=True, return_inverse=True)
            at = np.full(len(tokens), -1, np.int64)
            at[real] = inverse
            if not k:
                at[self.begin] = np.searchsorted(grams, mix(np.array([_END])))[0] if n else 0
            self.grams.append(grams)
            self.at.append(at)
            self.own.append(np.bincount(inverse, weights=counted[real], minlength=len(grams)).astype(np.int64))
            self.sample.append(real[first])

    def walk(self, counts: list[np.ndarray], tokens: int, types: int, mu: float) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of every text, from the corpus counts of the n-grams."""
        order, n_words = len(self.grams), max(1, len(self.grams[0]))
        chance = (counts[0] + ADD) / (tokens + ADD * (types + 1))
        word_weight = np.log10(chance)
        # States: 0 has no history; a seen n-gram shorter than the order is the state of its words.
        state_of, fail, backoff, size = [], [np.zeros(1, np.int64)], [np.zeros(1)], 1
        arcs, weights, targets = [], [], []
        for k in range(order - 1):
            seen = counts[k] > 0
            ids = np.full(len(seen), -1, np.int64)
            ids[seen] = size + np.arange(seen.sum())
            size += int(seen.sum())
            state_of.append(ids)
            fail.append(np.zeros(seen.sum(), np.int64) if not k else state_of[k - 1][self.at[k - 1][self.sample[k][seen]]])
            backoff.append(np.log10(mu / (counts[k][seen] + mu)))
        for k in range(1, order):
            here = self.sample[k]
            history, shorter = self.at[k - 1][here - 1], self.at[k - 1][here]
            chance = (counts[k] + mu * chance[shorter]) / (counts[k - 1][history] + mu)
            seen = counts[k] > 0
            arcs.append(state_of[k - 1][history[seen]] * n_words + self.at[0][here[seen]])
            weights.append(np.log10(chance[seen]))
            targets.append(state_of[k][seen] if k < order - 1 else state_of[k - 1][shorter[seen]])
        fail, backoff = np.concatenate(fail), np.concatenate(backoff)
        arcs = np.concatenate([*arcs, [np.iinfo(np.int64).max]])
        by = np.argsort(arcs)
        arcs, weights, targets = arcs[by], np.concatenate([*weights, [0.0]])[by], np.concatenate([*targets, [0]])[by]
        word_target = np.maximum(state_of[0], 0) if order > 1 else np.zeros(n_words, np.int64)

        rows = np.argsort(-self.length, kind="stable")
        begin, length = self.begin[rows], self.length[rows]
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right") if len(rows) else []
        total = np.zeros(len(rows))
        state = word_target[self.at[0][begin]] if len(rows) else np.zeros(0, np.int64)
        for step, n in enumerate(alive, 1):
            word = self.at[0][begin[:n] + step]
            at, sums = state[:n], total[:n]
            left = np.flatnonzero(at)
            after = word_target[word]
            gained = word_weight[word]
            while len(left):
                key = at[left] * n_words + word[left]
                found = np.searchsorted(arcs, key)
                hit = arcs[found] == key
                gained[left[hit]], after[left[hit]] = weights[found[hit]], targets[found[hit]]
                left = left[~hit]
                sums[left] += backoff[at[left]]
                at[left] = fail[at[left]]
                left = left[at[left] > 0]
            sums += gained
            state[:n] = after
        score = np.empty(len(rows))
        score[rows] = total
        words = self.at[0].copy()
        words[self.begin] = -1
        inside = words >= 0
        text = np.repeat(np.arange(len(rows)), self.length + 1)
        known = np.bincount(text[inside], weights=(counts[0] > 0)[words[inside]], minlength=len(rows)).astype(np.int64)
        base = np.bincount(text[inside], weights=word_weight[words[inside]], minlength=len(rows))
        return self.length, known, base, score


def _edges(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the hash range begins in sorted hashes."""
    lows = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(grams, lows), len(grams))


_PARTS = "order int, bucket int, block int, n int, grams binary, own binary"
_ANSWERS = "order int, bucket int, block int, n int, more binary, tokens bigint, types bigint"


def _columns(values: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([v[i] for v in values], f.type) for i, f in enumerate(schema)], schema=schema)


_PARTS_ARROW = pa.schema([("order", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("grams", pa.binary()), ("own", pa.binary())])
_ANSWERS_ARROW = pa.schema([("order", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("more", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])


def _block_of(rows: pa.Table, order: int) -> Block:
    rows = rows.combine_chunks()
    column = lambda name: rows.column(name).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(name).type)
    return Block(column("text"), ~np.asarray(column("held_out").to_numpy(zero_copy_only=False), bool), order)


def score_documents(docs: DataFrame, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row per row of ``docs``.

    Documents whose ``crc32(doc_id) mod 10`` is 0 are held out of training.
    """
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), (remainder == 0).alias("held_out"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))

    def count_block(table: pa.Table) -> pa.Table:
        block, number = _block_of(table, order), table.column("block")[0].as_py()
        out = []
        for k in range(order):
            edges = _edges(block.grams[k], buckets)
            for b in np.flatnonzero(np.diff(edges)):
                grams, own = block.grams[k][edges[b] : edges[b + 1]], block.own[k][edges[b] : edges[b + 1]]
                steps = np.diff(grams, prepend=np.uint64(0))
                out.append((k, int(b), number, len(grams), _packed(steps), _packed(own.astype(np.uint32))))
        return _columns(out, _PARTS_ARROW)

    def add_up(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        grams = [np.cumsum(_unpacked(p["grams"], p["n"], np.uint64)) for p in parts]
        own = [_unpacked(p["own"], p["n"], np.uint32).astype(np.int64) for p in parts]
        kinds, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(own), minlength=len(kinds)).astype(np.int64)
        out, at = [], 0
        for i, (p, mine) in enumerate(zip(parts, own)):
            more = total[inverse[at : at + p["n"]]] - mine
            at += p["n"]
            first = not i and p["order"] == 0
            out.append((p["order"], p["bucket"], p["block"], p["n"], _packed(more), int(total.sum()) if first else 0, int((total > 0).sum()) if first else 0))
        return _columns(out, _ANSWERS_ARROW)

    answers = cut(rows.groupBy("block").applyInArrow(count_block, _PARTS).groupBy("order", "bucket").applyInArrow(add_up, _ANSWERS))
    tokens, types = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def score_block(table: pa.Table, answer: pa.Table) -> pa.Table:
        block = _block_of(table, order)
        counts = [c.copy() for c in block.own]
        for part in answer.to_pylist():
            k, b = part["order"], part["bucket"]
            low = np.searchsorted(block.grams[k], np.uint64((b << 64) // buckets))
            counts[k][low : low + part["n"]] += _unpacked(part["more"], part["n"], np.int64)
        n, known, base, score = block.walk(counts, tokens, types, mu)
        columns = [table.column("doc_id").cast(pa.int64()), table.column("held_out"), n, known, np.full(len(n), tokens), base, score]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, result)], schema=result)

    return rows.groupBy("block").cogroup(answers.select("order", "bucket", "block", "n", "more").groupBy("block")).applyInArrow(
        score_block, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
