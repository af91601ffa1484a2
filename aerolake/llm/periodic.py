"""Maximal periodic runs of words, by string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q and at least ``REPEATS`` q words that no neighbouring word
extends. Periods up to ``SMALL`` are found by comparing the words with themselves, shifted by the period:
these are the highly periodic regions of all scales. Then, for t = ``SMALL``/2, doubled as long as a text has
more than 6 t words, the periods from 2 t + 1 to 4 t are found:

* Every stretch of t words has a hash; stretches of a period up to t/3 (they lie in runs of lower scales) have
  none. A place is synchronising if the least hash of the t + 1 stretches that begin from it on is that of the
  first or the last. Whether a place is one depends on its next 2 t words alone, and a stretch in which t
  places in a row are none has a period up to t/3.
* Two synchronising places that follow each other with equal contexts propose their distance as a period.
  Contexts are 3 t words for periods up to 3 t and 4 t words beyond: not shorter than the period, so that no
  equal context lies between, and short enough for a run of three periods to hold two of them, either from
  the place on or up to the end of its 2 t words, whatever place in the period the synchronising ones have.
* A proposal is extended word by word to both sides and is a run if it is long enough and no run of a smaller
  period has the same bounds.

Words are compared as such (numbered within a slice of rows), never by hash; equal hashes of different
stretches could only leave a run unproposed. The pass is narrow; a task holds a slice of rows, or one text.

Defined results: a null text has no words; a text of fewer than ``min_length`` words has no runs; texts are
taken whole, however long; repeated rows give a row each; an empty table gives an empty table; other columns
are carried along, but for those that bear the names of the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aerolake.llm.text import mix, slices

#: Runs have at least this many periods and words.
REPEATS, MIN_LENGTH = 3, 24
#: Periods up to here are found by shifted comparison; twice a power of two.
SMALL = 8

RESULTS = ("p_runs", "p_best", "p_text")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Runs:
    """Runs as parallel arrays: first word (in the slice), end, period."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        if len(start):
            self.parts.append((start, end, period))

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One run for each pair of bounds: that of the smallest period."""
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        start, end, period = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[first], end[first], period[first]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _A + mix(right + _B))


def _ahead(values: np.ndarray, by: int, fill: np.uint64) -> np.ndarray:
    """The value ``by`` places further on."""
    moved = np.full(len(values), fill, values.dtype)
    if by < len(values):
        moved[: len(values) - by] = values[by:]
    return moved


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place on; ``width`` is a power of two."""
    least, reach = values, 1
    while reach < width:
        least = np.minimum(least, _ahead(least, reach, _NONE))
        reach *= 2
    return least


def _small_periods(words: np.ndarray, runs: Runs) -> None:
    for q in range(1, min(SMALL, len(words) // REPEATS) + 1):
        same = np.zeros(len(words) - q + 2, np.int8)
        same[1:-1] = words[q:] == words[:-q]
        edges = np.diff(same)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + q
        enough = end - start >= REPEATS * q
        runs.add(start[enough], end[enough], np.full(int(enough.sum()), q, np.int64))


def _reach(left: np.ndarray, right: np.ndarray) -> int:
    """How many items agree from the start on."""
    n, step, at = min(len(left), len(right)), 32, 0
    while at < n:
        differ = np.flatnonzero(left[at : at + step] != right[at : at + step][: len(left) - at])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def _extend(words: np.ndarray, places: np.ndarray, distances: np.ndarray, runs: Runs) -> None:
    """Runs around the proposals: a place and a period each."""
    order = np.lexsort((places, distances))
    found, last, until = [], 0, -1
    for s, d in zip(places[order].tolist(), distances[order].tolist()):
        if d == last and s + d <= until:
            continue  # within the stretch of the proposal before
        ahead = _reach(words[s : len(words) - d], words[s + d :])
        back = _reach(words[:s][::-1], words[d : s + d][::-1])
        last, until = d, s + ahead + d
        if until - (s - back) >= REPEATS * d:
            found.append((s - back, until, d))
    if found:
        runs.add(*np.array(found, np.int64).T)


def _proposals(hashes: np.ndarray, double: np.ndarray, t: int, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of neighbouring equal contexts; ``high`` marks stretches of a period up to t / 3."""
    ranks = np.where(high, _NONE, hashes)
    last = _ahead(ranks, t, _NONE)
    least = np.minimum(_least_of(ranks, t), last)
    sync = np.flatnonzero((least != _NONE) & ((least == ranks) | (least == last)))
    sync = sync[sync + 2 * t <= len(hashes)]
    triple = _joined(double, _ahead(hashes, 2 * t, np.uint64(0)))
    fourfold = _joined(double, _ahead(double, 2 * t, np.uint64(0)))
    places, distances = [], []
    for context, low, size in ((triple, 2 * t, 3 * t), (fourfold, 3 * t, 4 * t)):
        for shift in (0, size - 2 * t):  # contexts from the place on, and up to the end of its 2 t words
            at = sync[sync >= shift] - shift
            at = at[at + size <= len(hashes)]
            keys = context[at]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            gap = at[1:] - at[:-1]
            pick = (keys[1:] == keys[:-1]) & (gap > low) & (gap <= size)
            places.append(at[:-1][pick])
            distances.append(gap[pick])
    return np.concatenate(places), np.concatenate(distances)


def find_runs(words: np.ndarray, first: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts whose words begin at ``first`` (with the end as last item),
    with at least ``least`` words, ordered by start and period."""
    sizes = np.diff(first)
    chosen = np.flatnonzero(sizes >= max(least, REPEATS))
    if not len(chosen):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    # Texts one after the other, each closed by a number of its own, so that nothing crosses it.
    owner = np.repeat(np.arange(len(chosen)), sizes[chosen] + 1)
    begins = np.cumsum([0, *(sizes[chosen] + 1)])
    local = np.arange(begins[-1]) - begins[:-1][owner]
    inside = local < sizes[chosen][owner]
    row = np.where(inside, np.minimum(first[:-1][chosen][owner] + local, max(len(words) - 1, 0)), 0)
    values = np.where(inside, words[row], -1 - owner)
    place = np.where(inside, row, -1)  # the word's number in the slice

    runs = Runs()
    _small_periods(values, runs)
    hashes, t = mix(values.astype(np.uint64) * _A + _B), 1
    while t < SMALL // 2:
        hashes, t = _joined(hashes, _ahead(hashes, t, np.uint64(0))), 2 * t
    base = np.arange(len(values))  # the place in the first arrangement of what is left
    now = values
    while True:
        long = np.diff(begins) - 1 > 2 * REPEATS * t
        if not long.any():
            break
        if not long.all():
            keep = np.repeat(long, np.diff(begins))
            now, hashes, base = now[keep], hashes[keep], base[keep]
            begins = np.cumsum([0, *np.diff(begins)[long]])
        start, end, period = runs.all()
        marks = np.zeros(len(now) + 1, np.int64)
        wide = (REPEATS * period <= t) & (end - start >= t)
        at = np.searchsorted(base, start[wide])
        there = at < len(base)
        there[there] = base[at[there]] == start[wide][there]
        np.add.at(marks, at[there], 1)
        np.add.at(marks, at[there] + (end - start)[wide][there] - t + 1, -1)
        double = _joined(hashes, _ahead(hashes, t, np.uint64(0)))
        places, distances = _proposals(hashes, double, t, np.cumsum(marks)[:-1] > 0)
        scale = Runs()
        _extend(now, places, distances, scale)
        start, end, period = scale.all()
        runs.add(base[start], base[start] + (end - start), period)
        hashes, t = double, 2 * t
    start, end, period = runs.all()
    enough = end - start >= least
    start, end, period = start[enough], end[enough], period[enough]
    begin = place[start]
    return begin, begin + (end - start), period


def _kept(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Marks the words that no run holds after its first period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, end, -1)
    return np.cumsum(marks)[:-1] == 0


def _best(runs: list[tuple[int, int, int]]) -> dict | None:
    """The run of the greatest exact exponent; of several the one that starts first, then of the smallest period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return None if best is None else dict(zip(("start", "length", "period"), best))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse(docs: DataFrame, text: str = "text", arrange: Callable[[object, int], np.ndarray | None] | None = None, key: str = "doc_id",
             min_length: int = MIN_LENGTH) -> DataFrame:
    """The documents without their text, with ``p_runs`` (array of start, length and period, in words, by start and
    period), ``p_best`` (the run of the greatest exponent, null if none) and ``p_text``: the words that are left, joined
    by one space, when every run is cut to its first period.

    ``arrange(key, n)`` may give the numbers of the words that a text of n words is to consist of (None: as it is).
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, *RESULTS)]
    run_type = "struct<start:bigint,length:bigint,period:bigint>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"p_runs array<{run_type}>, p_best {run_type}, p_text string"])

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode().split() for t in part.column(part.schema.get_field_index(text)).to_pylist()]
        if arrange is not None:
            keys = part.column(part.schema.get_field_index(key)).to_pylist()
            for i, (k, words) in enumerate(zip(keys, texts)):
                order = arrange(k, len(words))
                if order is not None:
                    texts[i] = [words[j] for j in order.tolist()]
        numbers: dict[bytes, int] = {}
        words = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
        first = np.cumsum([0, *map(len, texts)])
        start, end, period = find_runs(words, first, min_length)
        left = _kept(len(words), start, end, period)
        owner = np.searchsorted(first, start, side="right") - 1
        runs: list[list] = [[] for _ in texts]
        for i, s, e, q in zip(owner.tolist(), start.tolist(), end.tolist(), period.tolist()):
            runs[i].append((s - int(first[i]), e - s, q))
        for i in set(owner.tolist()):
            texts[i] = [w for w, keep in zip(texts[i], left[first[i] : first[i + 1]].tolist()) if keep]
        columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
        columns.append(pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(_RUN)))
        columns.append(pa.array([_best(rs) for rs in runs], _RUN))
        columns.append(pa.array([b" ".join(t).decode() for t in texts], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *RESULTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield of(part)

    return docs.mapInArrow(run, schema)
