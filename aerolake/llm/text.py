"""Flat views of Arrow text columns: words, lines and 64-bit hashes of them, a slice of rows at a time.

All functions work on whole texts. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 2_000_000

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def chained(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hash of its front and the hash of its next item."""
    return mix(h * _STEP + nxt)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, which are in order and do not overlap. Equal bytes give equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + lengths * _STEP)


def mask_of(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_SPACE = mask_of(SPACES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Texts:
    """The texts of a slice as one byte array with the offsets of each text."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        column = column.cast(pa.large_string()).fill_null("") if len(column) else column
        self.n = len(column)
        if self.n:
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            self.offsets = offsets - offsets[0]
            self.data = _LOWER[data] if lower else data
        else:
            self.offsets, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def words(self) -> None:
        """Sets ``starts``, ``ends`` (bytes) of all words, and ``first``: the number of words before each text."""
        inside = ~_SPACE[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.offsets[1:-1]
        before[edges[edges < len(inside)]] = False
        after[edges[edges > 0] - 1] = False
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Counts of marked bytes in each text."""
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def per_text_words(self, marks: np.ndarray) -> np.ndarray:
        """Counts of marked words in each text."""
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every run of ``size`` words that lies in one text, and the text it lies in."""
        owner = self.owner()
        if len(owner) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
        return at, owner[at]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces that hold, beside their first row, less than ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
    pieces = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(pieces)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def twice_or_more(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    marks = np.zeros(len(keys), bool)
    marks[order[1:][same]] = True
    marks[order[:-1][same]] = True
    return marks


def later_copies(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur before in the array."""
    marks = np.ones(len(keys), bool)
    marks[np.unique(keys, return_index=True)[1]] = False
    return marks
