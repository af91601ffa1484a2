"""Greedy anchors: walk a sorted series, a row becomes an anchor when it is far from the last one.

Clustering pins and thinning to a minimum spacing are both this walk. Two neighbours further
apart than the gap always start anew, so the walk restarts at such breaks and every stretch
between breaks ("chain") is independent work. A chain too long for one task is solved by
pointer doubling instead: every row points to the row that would follow it as an anchor, and
the set of rows reachable from the first one doubles its depth each round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators.asof import bracket
from aerolake.operators.ordered import Ordered, needs_split, null_safe_join
from aerolake.session import cut, rows_per_task


def _walk(gap: float, strict: bool):
    """Anchors of rows (_id, x, _n) that come chain by chain in order; chains may go on in the next batch.

    Hops from anchor to anchor by binary search, so that the work is the number of anchors, not of rows.
    """
    def next_far(x: np.ndarray, at: int, stop: int, anchor: float) -> int:
        """First place from ``at`` on that is far from the anchor; the difference itself decides, not the rounded sum."""
        found = at + int(np.searchsorted(x[at:stop], anchor + gap, "left"))
        far = (lambda v: v - anchor > gap) if strict else (lambda v: v - anchor >= gap)
        while found > at and far(x[found - 1]):
            found -= 1
        while found < stop and not far(x[found]):
            found += 1
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, anchor, anchor_row = None, 0.0, 0
        for batch in batches:
            ids, x, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = np.empty(len(ids), np.int64)
            borders = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else []
            for start, stop in zip(borders, [*borders[1:], len(ids)]):
                at = start
                if ids[start] == chain:  # the chain goes on from the batch before
                    at = next_far(x, start, stop, anchor)
                    out[start:at] = anchor_row
                chain = ids[start]
                while at < stop:
                    anchor, anchor_row = x[at], rows[at]
                    after = max(at + 1, next_far(x, at, stop, anchor))
                    out[at:after] = anchor_row
                    at = after
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], names=["_id", "_n", "anchor"])

    return run


def _by_doubling(rows: DataFrame, keys: Sequence[str], x: str, gap: float, strict: bool,
                 longest: int) -> DataFrame:
    """Anchors of long chains; ``rows`` carry _chain and the per-key row number _n."""
    group = [*keys, "_chain"]
    here = rows.select(*group, x, "_n")
    moved = here.withColumn(x, F.col(x) + gap)
    exact = "lower" if strict else "upper"
    target = here.withColumn("_to", F.col("_n"))
    found = bracket(moved, target, group, x, "_n", ["_to"], exact=exact, sides=["upper"], split=True)
    jump = cut(found.where(F.col("upper").isNotNull())
               .select(*keys, "_n", F.col("upper._to").alias("_to")))
    reached = cut(here.groupBy(*group).agg(F.min("_n").alias("_n")).select(*keys, "_n"))
    known, depth = reached.count(), 1
    while depth < longest:
        further = null_safe_join(reached, jump, [*keys, "_n"], "inner").select(
            *keys, F.col("_to").alias("_n"))
        reached = cut(reached.unionByName(further).distinct())
        count = reached.count()
        if count == known:
            break
        known, depth = count, depth * 2
        onward = jump.select(*keys, F.col("_n").alias("_to"), F.col("_to").alias("_far"))
        jump = cut(null_safe_join(jump, onward, [*keys, "_to"], "inner").select(
            *keys, "_n", F.col("_far").alias("_to")))
    marks = reached.withColumn("_mark", F.col("_n"))
    marked = null_safe_join(rows, marks, [*keys, "_n"], "left")
    filled = Ordered(marked, keys, ["_n"], True).add(last={"anchor": F.col("_mark")})
    return filled.drop("_mark")


def greedy_anchors(df: DataFrame, keys: Sequence[str], x: str, order: Sequence[str], gap: float,
                   strict: bool = True, split: bool | None = None) -> DataFrame:
    """Add ``anchor`` (row number of the governing anchor) and ``is_anchor``.

    strict: a new anchor needs distance > gap (clustering); otherwise >= gap (thinning).
    """
    split = needs_split(df, keys) if split is None else split
    sequence = [x, *[c for c in order if c != x]]
    rows = Ordered(df, keys, sequence, split).add(position="_n", prev={"_px": F.col(x)})
    step = F.col(x) - F.col("_px")
    fresh = F.col("_px").isNull() | ((step > gap) if strict else (step >= gap))
    rows = Ordered(rows.withColumn("_new", fresh.cast("bigint")), keys, sequence, split).add(
        running={"_chain": ("sum", F.col("_new"))}).drop("_new", "_px")
    group = [*keys, "_chain"]
    walk = _walk(gap, strict)
    columns = [*rows.columns, "anchor"]

    def walked(part: DataFrame) -> DataFrame:
        """Only (chain id, x, row number) goes through Python; the other columns are joined back."""
        placed = part.withColumn("_id", F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], *[F.col(k).isNull() for k in keys], "_chain"))
        narrow = placed.select("_id", F.col(x).cast("double").alias("_x_"), "_n").repartition("_id").sortWithinPartitions("_id", "_n")
        found = narrow.mapInArrow(walk, "_id bigint, _n bigint, anchor bigint")
        return placed.join(found.withColumnsRenamed({"_id": "_fid", "_n": "_fn"}), (F.col("_id") == F.col("_fid")) & (F.col("_n") == F.col("_fn"))).select(*columns)

    if split:
        rows = cut(rows)
        sizes = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_len")))
        limit = rows_per_task(df.sparkSession)
        longest = sizes.agg(F.max("_len")).first()[0] or 0
        if longest > limit:
            long = sizes.where(F.col("_len") > limit).drop("_len")
            inside = null_safe_join(rows, long, group, "left_semi")
        else:
            inside = None
        if inside is not None:
            outside = null_safe_join(rows, long, group, "left_anti")
            result = walked(outside).unionByName(
                _by_doubling(inside, keys, x, gap, strict, longest).select(*columns))
        else:
            result = walked(rows)
    else:
        result = walked(rows)
    return result.withColumn("is_anchor", F.col("anchor") == F.col("_n")).drop("_n", "_chain")


def thin_min_spacing(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], gap: float,
                     split: bool | None = None) -> DataFrame:
    """Rows at least ``gap`` after the last kept row."""
    kept = greedy_anchors(df, keys, ts, order, gap, strict=False, split=split)
    return kept.where("is_anchor").drop("anchor", "is_anchor")


def cluster_events(events: DataFrame, views: DataFrame, keys: Sequence[str], ts: str, order: str,
                   severity_rank: str, x0: float, x1: float, min_px: float = 11.0,
                   split: bool | None = None) -> DataFrame:
    """Events inside each key's view merged into pins at least ``min_px`` pixels apart.

    The anchor of a cluster is its first event; output has the mean time, the member count and
    the highest severity rank.
    """
    joined = null_safe_join(events, views.select(*keys, "view_start", "view_end"), keys, "inner")
    visible = joined.where((F.col(ts) >= F.col("view_start")) & (F.col(ts) <= F.col("view_end")))
    span = F.col("view_end") - F.col("view_start")
    x = F.when(span > 0, x0 + (F.col(ts) - F.col("view_start")) / span * (x1 - x0)).otherwise(x0)
    placed = visible.withColumn("_x", x.cast("double"))
    marked = greedy_anchors(placed, keys, "_x", ["_x", order], min_px, True, split)
    return marked.groupBy(*keys, "anchor").agg(
        F.avg(ts).alias("t"), F.count(F.lit(1)).alias("n"), F.max(severity_rank).alias("rank"),
        F.min(ts).alias("t_first"),
    ).drop("anchor")
