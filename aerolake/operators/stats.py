"""Grouped statistics: all are partial aggregates, so a hot key is combined before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators.ordered import null_safe_join


def signal_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Minimum, maximum, mean, population deviation and count of the finite values."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return df.where(finite).groupBy(*by).agg(
        F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"),
        F.stddev_pop(v).alias("v_std"), F.count(v).alias("n"))


def density(df: DataFrame, views: DataFrame, keys: Sequence[str], ts: str, bins: int,
            start: str = "view_start", end: str = "view_end") -> DataFrame:
    """Counts in ``bins`` equal bins of each key's view, empty bins included.

    Bins are half-open but the last one also holds its right edge. ``views`` has one row per
    key; the points are reduced to (key, bin) counts before they meet the dense bin list.
    """
    t = F.col(ts).cast("double")
    inside = null_safe_join(df, views.select(*keys, start, end), keys, "inner").where(
        (t >= F.col(start)) & (t <= F.col(end)) & (F.col(end) > F.col(start)))
    width = (F.col(end) - F.col(start)) / bins
    slot = F.least(F.floor((t - F.col(start)) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dense = views.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    joined = null_safe_join(dense, counts, [*keys, "bin"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
                rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key in ``order``; Spark trims each task's rows before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
