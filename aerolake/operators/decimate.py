"""Row reduction that keeps the shape of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators.ordered import Ordered, null_safe_join


def _numbered(df, keys, order, split) -> DataFrame:
    ordered = Ordered(df, keys, order, split)
    rows = ordered.add(position="_n")
    if not ordered.split:
        return rows.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return null_safe_join(rows, sizes, keys, "left")


def decimate_even(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_points: int,
                  split: bool | None = None) -> DataFrame:
    """At most ``max_points`` rows per key at evenly spread positions, first and last included.

    Row i (0-based) is kept when some k has int(k * (size-1) / (max_points-1)) = i. The k next
    at or above i decides that, so no list of positions is built.
    """
    rows = _numbered(df, keys, order, split)
    i, last = F.col("_n") - 1, F.col("_size") - 1
    step = last / F.lit(float(max_points - 1))
    k = F.ceil(i / step)
    hit = F.lit(False)
    for near in (k - 1, k, k + 1):
        hit = hit | ((near <= max_points - 2) & (F.floor(near * step) == i))
    keep = (F.col("_size") <= max_points) | (i == last) | hit
    return rows.where(keep).drop("_n", "_size")


def decimate_stride(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_points: int,
                    split: bool | None = None) -> DataFrame:
    """Every (size // max_points)-th row of keys with more than ``max_points`` rows."""
    rows = _numbered(df, keys, order, split)
    step = F.greatest(F.floor(F.col("_size") / max_points), F.lit(1))
    keep = (F.col("_size") <= max_points) | ((F.col("_n") - 1) % step == 0)
    return rows.where(keep).drop("_n", "_size")


def decimate_peaks(df: DataFrame, keys: Sequence[str], ts: str, value: str, views: DataFrame,
                   buckets: int, start: str = "view_start", end: str = "view_end") -> DataFrame:
    """Lowest and highest value of each time bucket, with their times (ties: earliest)."""
    t = F.col(ts).cast("double")
    inside = null_safe_join(df, views.select(*keys, start, end), keys, "inner").where(
        (t >= F.col(start)) & (t <= F.col(end)) & F.col(value).isNotNull())
    width = (F.col(end) - F.col(start)) / buckets
    slot = F.least(F.floor((t - F.col(start)) / width), F.lit(buckets - 1)).cast("int")
    low = F.min(F.struct(F.col(value).alias("v"), t.alias("t")))
    high = F.max(F.struct(F.col(value).alias("v"), (-t).alias("t")))
    grouped = inside.groupBy(*keys, F.coalesce(slot, F.lit(0)).alias("bucket")).agg(
        low.alias("_lo"), high.alias("_hi"))
    return grouped.select(*keys, "bucket", F.col("_lo.v").alias("v_min"), F.col("_lo.t").alias("t_min"),
                          F.col("_hi.v").alias("v_max"), (-F.col("_hi.t")).alias("t_max"))
