"""Gaps-and-islands operators: state regions, change segments, run lengths, phase clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.operators.ordered import Ordered, needs_split, null_safe_join


def key_span(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("t_first"), F.max(ts).alias("t_last"))


def state_regions(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], on: Column,
                  ends: DataFrame | None = None, end: str = "t_last",
                  split: bool | None = None) -> DataFrame:
    """Closed regions from an "on" row to the next "off" row, in row order ``order``.

    A region still open at the last row ends at ``ends[end]`` (one row per key). Output:
    keys, idx, t_start, t_end.
    """
    split = needs_split(df, keys) if split is None else split
    rows = df.select(*keys, ts, *[c for c in order if c != ts], on.alias("_on"))
    seen = Ordered(rows, keys, order, split).add(prev={"_was": F.col("_on")})
    edges = seen.where(F.col("_on") != F.coalesce(F.col("_was"), F.lit(False)))
    closed = Ordered(edges, keys, order, split).add(next={"t_end": F.col(ts)})
    opened = closed.where("_on").select(*keys, F.col(ts).alias("t_start"), "t_end", *[
        F.col(c).alias(f"_o_{c}") for c in order])
    if ends is not None:
        opened = null_safe_join(opened, ends.select(*keys, F.col(end).alias("_stop")), keys, "left")
        opened = opened.withColumn("t_end", F.coalesce("t_end", "_stop")).drop("_stop")
    ranked = Ordered(opened, keys, [f"_o_{c}" for c in order], split).add(position="idx")
    return ranked.select(*keys, (F.col("idx") - 1).alias("idx"), "t_start", "t_end")


def paired_regions(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
                   ends: DataFrame, end: str = "t_last", split: bool | None = None) -> DataFrame:
    """Regions from rows taken two by two (1st to 2nd, 3rd to 4th, ...); an odd last one is open."""
    split = needs_split(df, keys) if split is None else split
    ordered = Ordered(df.select(*keys, ts, *[c for c in order if c != ts]), keys, order, split)
    rows = ordered.add(position="_n", next={"t_end": F.col(ts)}).where(F.col("_n") % 2 == 1)
    rows = null_safe_join(rows, ends.select(*keys, F.col(end).alias("_stop")), keys, "left")
    return rows.select(*keys, ((F.col("_n") - 1) / 2).cast("bigint").alias("idx"),
                       F.col(ts).alias("t_start"), F.coalesce("t_end", "_stop").alias("t_end"))


def change_segments(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], label: str,
                    ends: DataFrame | None = None, end: str = "t_last",
                    split: bool | None = None) -> DataFrame:
    """Runs of equal labels: keys, idx, label, t_start, t_end (next run's start or the key's end)."""
    split = needs_split(df, keys) if split is None else split
    rows = df.select(*keys, label, *order)
    seen = Ordered(rows, keys, order, split).add(prev={"_was": F.struct(F.col(label).alias("v"))})
    changed = F.col("_was").isNull() | ~F.col("_was.v").eqNullSafe(F.col(label))
    heads = seen.where(changed).drop("_was")
    runs = Ordered(heads, keys, order, split).add(next={"t_end": F.col(ts)}, position="idx")
    if ends is not None:
        runs = null_safe_join(runs, ends.select(*keys, F.col(end).alias("_stop")), keys, "left")
        runs = runs.withColumn("t_end", F.coalesce("t_end", "_stop"))
    return runs.select(*keys, (F.col("idx") - 1).alias("idx"), label,
                       F.col(ts).alias("t_start"), "t_end")


def merge_slivers(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str = "kind",
                  start: str = "t_start", end: str = "t_end", shortest: float = 0.05,
                  split: bool | None = None) -> DataFrame:
    """Fold intervals shorter than ``shortest`` into the one before, then merge equal neighbours.

    A sliver never changes the kind it is folded into, so the kept kinds are the non-slivers
    (plus the first row), and a run of equal kept kinds ends where the next run begins to be
    read: all of it is neighbour lookups, no sequential pass.
    """
    split = needs_split(df, keys) if split is None else split
    first = Ordered(df, keys, order, split).add(position="_n")
    kept = (F.col("_n") == 1) | (F.col(end) - F.col(start) >= shortest)
    marked = first.withColumn("_kept_kind", F.when(kept, F.struct(F.col(kind).alias("v"))))
    marked = Ordered(marked, keys, order, split).add(last={"_now": F.col("_kept_kind")})
    seen = Ordered(marked, keys, order, split).add(prev={"_before": F.col("_now"),
                                                           "_prev_end": F.col(end)})
    head = F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col("_now.v"))
    last_end = seen.groupBy(*keys).agg(F.max_by(end, F.struct(*order)).alias("_final"))
    runs = Ordered(seen.where(head), keys, order, split).add(
        next={"_next_prev_end": F.col("_prev_end")}, position="idx")
    runs = null_safe_join(runs, last_end, keys, "left")
    return runs.select(*keys, (F.col("idx") - 1).alias("idx"), F.col("_now.v").alias(kind), start,
                       F.coalesce("_next_prev_end", "_final").alias(end))


def drop_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                 split: bool | None = None) -> DataFrame:
    """Drop rows whose values equal those of the previous row."""
    value = F.struct(*[F.col(v) for v in values])
    seen = Ordered(df, keys, order, split).add(prev={"_was": value})
    return seen.where(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(value)).drop("_was")
