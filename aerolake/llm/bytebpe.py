"""Byte-level BPE with a segment tree over the byte positions of a match.

The split pattern cuts a text into matches; each match is encoded on its own. A match that is a token is
that token. For any other one the leaves of a segment tree stand for its byte positions: a leaf holds the
rank of the pair that begins there (rank first, then place, so that the root is the leftmost pair of the
lowest rank) or nothing. A merge takes the pair at the root, empties the leaf of its right half, and sets
the leaves of the new token and of its living neighbour on the left: three point updates of logarithmic
cost, so that a match of n bytes costs n log n, however long it is.

Encoded matches are remembered in each Python worker, in two generations of ``MEMORY`` matches of at most
``MEMORY_BYTES`` bytes each; what falls out is encoded again. The pass is narrow: nothing is shuffled, and
a lost task only repeats itself.

Defined results: a null text is encoded as an empty one (no tokens, no decoded bytes); very long texts and
matches are encoded whole; repeated rows give a row each; an empty table gives an empty table; other columns
are carried along, but for those that bear the names of the results, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aerolake.llm.text import slices

#: Remembered matches in one of the two generations, and the longest match that is remembered.
MEMORY = 250_000
MEMORY_BYTES = 64

RESULTS = ("n_tokens", "ids_sha256", "decoded_sha256", "input_ids")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and a number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    shift = (n - 1).bit_length()
    leaves, place, rank_of = 1 << shift, (1 << shift) - 1, ranks.get
    nothing = 1 << 62
    tree = [nothing] * (2 * leaves)
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[leaves + i] = rank << shift | i
    for node in range(leaves - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    ends = list(range(1, n + 2))  # where the token that begins here ends
    left = list(range(-1, n))  # where the token before the one that begins here begins
    while tree[1] != nothing:
        i = tree[1] & place
        right = ends[i]
        end = ends[right]
        ends[i] = end
        if end < n:
            left[end] = i
        for at in (right, i, left[i]):
            if at < 0:
                continue
            value = nothing
            if at != right and ends[at] < n:
                rank = rank_of(piece[at : ends[ends[at]]])
                if rank is not None:
                    value = rank << shift | at
            node = leaves + at
            if tree[node] == value:
                continue
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                best = value if value < other else other
                if tree[node] == best:
                    break
                tree[node] = value = best
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return ids


class Matches(dict):
    """Ids of matches as little-endian 32-bit integers; a missing match is encoded and remembered."""

    def __init__(self, ranks: dict[bytes, int], memory: int) -> None:
        super().__init__()
        self.ranks, self.memory, self.old = ranks, memory, {}

    def __missing__(self, match: str) -> bytes:
        found = self.old.get(match)
        if found is None:
            piece = match.encode()
            found = as_bytes(merge(piece, self.ranks))
            if len(piece) > MEMORY_BYTES:
                return found
        if len(self) >= self.memory:
            self.old = dict(self)
            self.clear()
        self[match] = found
        return found


class ByteEncoder:
    """A rank file with its split pattern."""

    def __init__(self, path: str, pattern: str, memory: int = MEMORY) -> None:
        import regex

        self.ranks = read_ranks(path)
        # The pattern is meant for an engine whose \s is the Unicode property; here \s also holds \x1c to \x1f.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.matches = Matches(self.ranks, memory)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.matches.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], ByteEncoder] = {}


def encoder_for(path: str, pattern: str) -> ByteEncoder:
    """The worker's encoder; it outlives a task and serves the next one."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteEncoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """The documents without their text, with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``input_ids``.

    ``ranks`` is a rank file that every executor has at that path. ``ids_sha256`` is the digest of the ids as
    little-endian unsigned 32-bit integers, ``decoded_sha256`` that of the bytes that the ids decode to.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, *RESULTS)]
    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", input_ids array<int>" if with_ids else "")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks, pattern)
        for batch in batches:
            for part in slices(batch, text):
                encoded = [encoder.encode(t or "") for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                columns += [pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                            pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded], pa.string()),
                            pa.array([hashlib.sha256(encoder.decode(ids)).hexdigest() for ids in encoded], pa.string())]
                if with_ids:
                    offsets = np.cumsum([0, *(len(ids) // 4 for ids in encoded)])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4"))))
                names = [*(f.name for f in kept), *RESULTS[: 4 if with_ids else 3]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids: str = "input_ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded bytes of each array of ids (binary); a null array gives no bytes."""
    kept = [f for f in encoded.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks, pattern)
        for batch in batches:
            arrays = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns.append(pa.array([encoder.decode(as_bytes(a or [])) for a in arrays], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), out])

    return encoded.mapInArrow(run, schema)
