"""Joins between points and time intervals, written so that no key is matched all-against-all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators.asof import bracket
from aerolake.operators.ordered import Ordered, null_safe_join

# Windows are broadcast only below these measured sizes; beyond them the as-of way is used.
BROADCAST_WINDOWS = 200_000
BROADCAST_WINDOWS_PER_KEY = 32
# Levels of the dyadic grid: cells of 2^-4 to 2^12 of the time unit. Longer windows take several of the largest cells, so
# that no cell holds more than about an hour of one signal.
FINEST_LEVEL, COARSEST_LEVEL = -4, 12


def merge_windows(windows: DataFrame, keys: Sequence[str], start: str, end: str,
                  split: bool | None = None) -> DataFrame:
    """Union of closed windows per key: overlapping or touching windows become one."""
    ordered = Ordered(windows.select(*keys, start, end), keys, [start, end], split)
    reach = ordered.add(running={"_reach": ("max", F.col(end))})
    reach = Ordered(reach, keys, [start, end], ordered.split).add(prev={"_before": F.col("_reach")})
    heads = reach.withColumn("_new", F.col("_before").isNull() | (F.col(start) > F.col("_before")))
    numbered = Ordered(heads, keys, [start, end], ordered.split).add(
        running={"_group": ("sum", F.col("_new").cast("bigint"))})
    return (numbered.groupBy(*keys, "_group")
            .agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_group"))


def few_windows(windows: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the windows are measured to be small enough for a broadcast."""
    total, widest = (windows.groupBy(*keys).count()
                     .agg(F.sum("count"), F.max("count")).first())
    setting = windows.sparkSession.conf.get
    most = int(setting("aerolake.broadcastWindows", str(BROADCAST_WINDOWS)))
    return (total or 0) <= most and (widest or 0) <= int(setting("aerolake.broadcastWindowsPerKey", str(BROADCAST_WINDOWS_PER_KEY)))


def within_windows(df: DataFrame, windows: DataFrame, keys: Sequence[str], ts: str,
                   start: str = "t_start", end: str = "t_end", small: bool | None = None,
                   split: bool | None = None) -> DataFrame:
    """Rows of ``df`` inside any closed window of their key; each row at most once.

    Few windows: they are packed into one array per key and broadcast, and ``df`` is filtered
    without a shuffle. Otherwise the windows are merged and found by an as-of join.
    """
    if few_windows(windows, keys) if small is None else small:
        packed = windows.groupBy(*keys).agg(
            F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"))).alias("_w"))
        joined = null_safe_join(df, F.broadcast(packed), keys, "inner")
        inside = F.exists("_w", lambda w: (F.col(ts) >= w["a"]) & (F.col(ts) <= w["b"]))
        return joined.where(inside).drop("_w")
    merged = merge_windows(windows, keys, start, end, split)
    samples = merged.withColumn("_zero", F.lit(0)).withColumn(ts, F.col(start).cast("double"))
    found = bracket(df, samples, keys, ts, "_zero", [end], exact="lower", sides=["lower"], split=split)
    return found.where(F.col(ts) <= F.col("lower")[end]).drop("lower")


def match_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str,
                    payload: Sequence[str], order: str, start: str = "t_start", end: str = "t_end",
                    split: bool | None = None) -> DataFrame:
    """All (point, interval) pairs of closed intervals that overlap at most in their borders.

    A point lies in the last interval that starts before it, and in every interval that starts
    exactly at it; the first is an as-of join, the second a plain equi-join.
    """
    samples = intervals.withColumn(ts, F.col(start).cast("double"))
    earlier = bracket(points, samples, keys, ts, order, [start, end, *payload], sides=["lower"],
                      split=split)
    names = [start, end, *payload]
    inside = earlier.where(F.col(ts) <= F.col("lower")[end])
    inside = inside.select(*points.columns, *[F.col("lower")[n].alias(f"i_{n}") for n in names])
    heads = intervals.select(*keys, *[F.col(n).alias(f"i_{n}") for n in names])
    heads = heads.withColumn(ts, F.col(f"i_{start}").cast("double"))
    at_start = null_safe_join(points, heads, [*keys, ts], "inner")
    return inside.unionByName(at_start.select(*inside.columns))


def interval_lookup(cursors: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str,
                    payload: Sequence[str], order: str, out: str = "interval",
                    start: str = "t_start", end: str = "t_end",
                    split: bool | None = None) -> DataFrame:
    """The first interval (by ``order``) that contains each cursor, NULL when there is none."""
    samples = intervals.withColumn(ts, F.col(start).cast("double"))
    names = [start, end, *payload]
    found = bracket(cursors, samples, keys, ts, order, names, split=split)
    t = F.col(ts).cast("double")
    earlier = F.when(t <= F.col("lower")[end], F.col("lower"))
    begins = F.when(F.col("upper.t") == t, F.col("upper"))
    return found.withColumn(out, F.coalesce(earlier, begins)).drop("lower", "upper")


def count_in_windows(windows: DataFrame, points: DataFrame, keys: Sequence[str], ts: str,
                     order: str, start: str = "t_start", end: str = "t_end",
                     out: str = "n_points", split: bool | None = None) -> DataFrame:
    """Points with start <= t <= end per window: two rank lookups instead of a range join."""
    points = points.select(*keys, ts, order)
    ordered = Ordered(points, keys, [ts, order], split)
    ranked = ordered.add(position="_n")
    first = bracket(windows.withColumn(ts, F.col(start).cast("double")), ranked, keys, ts, order,
                    ["_n"], exact="upper", sides=["lower"], split=split)
    first = first.withColumn("_before", F.coalesce(F.col("lower._n"), F.lit(0))).drop("lower")
    both = bracket(first.withColumn(ts, F.col(end).cast("double")), ranked, keys, ts, order,
                   ["_n"], exact="lower", sides=["lower"], split=split)
    upto = F.coalesce(F.col("lower._n"), F.lit(0))
    counted = F.greatest(upto - F.col("_before"), F.lit(0)).cast("bigint")
    return both.withColumn(out, counted).drop("lower", "_before", ts)


def overlap_distinct(windows: DataFrame, segments: DataFrame, keys: Sequence[str], window_id: str,
                     label: str, order: str, start: str = "t_start", end: str = "t_end",
                     out: str = "n_labels", split: bool | None = None) -> DataFrame:
    """Distinct segment labels with segment.start < window.end and segment.end > window.start.

    Both sides are free of inner overlaps, so a pair either has the segment starting inside the
    window or the segment covering the window's start: two as-of joins, linear in the rows.
    """
    ts = "_at"
    covers = bracket(
        windows.withColumn(ts, F.col(start).cast("double")),
        segments.withColumn(ts, F.col(start).cast("double")),
        keys, ts, order, [end, label], sides=["lower"], split=split)
    covers = covers.where(F.col("lower")[end] > F.col(start))
    covers = covers.select(*keys, window_id, F.col("lower")[label].alias("_label"))
    hosts = windows.select(*keys, window_id, F.col(start).alias("_ws"), F.col(end).alias("_we"))
    starts = bracket(
        segments.withColumn(ts, F.col(start).cast("double")),
        hosts.withColumn(ts, F.col("_ws").cast("double")),
        keys, ts, window_id, [window_id, "_ws", "_we"], exact="lower", sides=["lower"], split=split)
    inside = (F.col(start) < F.col("lower._we")) & (F.col(end) > F.col("lower._ws"))
    starts = starts.where(inside).select(
        *keys, F.col("lower")[window_id].alias(window_id), F.col(label).alias("_label"))
    counts = (covers.unionByName(starts).groupBy(*keys, window_id)
              .agg(F.count_distinct("_label").alias(out)))
    joined = null_safe_join(windows, counts, [*keys, window_id], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("bigint"))


def windows_around(df: DataFrame, cursors: DataFrame, keys: Sequence[str], ts: str, cursor_id: str,
                   before: float, after: float, width: float | None = None) -> DataFrame:
    """(cursor, row) pairs with cursor - before <= t <= cursor + after, for short windows.

    The result holds every such pair by definition. The time axis is cut into tiles of the
    window's length; a cursor is copied to the two or three tiles it touches, and the equi-join
    runs on (key, tile), which spreads a hot key over its tiles.
    """
    width = width or max(before + after, 1e-3)
    at = F.col(ts).cast("double")
    tiles = F.sequence(F.floor((at - before) / width), F.floor((at + after) / width))
    marks = cursors.select(*keys, F.col(cursor_id).alias("cursor_id"), at.alias("cursor_t"),
                           F.explode(tiles).alias("_tile"))
    rows = df.withColumn("_tile", F.floor(at / width))
    pairs = null_safe_join(rows, marks, [*keys, "_tile"], "inner")
    near = (F.col(ts) >= F.col("cursor_t") - before) & (F.col(ts) <= F.col("cursor_t") + after)
    return pairs.where(near).drop("_tile")


def pairs_in_windows(points: DataFrame, windows: DataFrame, keys: Sequence[str], ts: str,
                     start: str, end: str) -> DataFrame:
    """All (point, window) pairs of a key with start <= t <= end; windows overlap as they like and have any width.

    Every window lies on the level of a dyadic grid whose cells are as wide as itself, so that it touches two cells
    at most; one wider than the largest cell touches as many of those as it needs. A point is copied once for each level
    that a window of its key has, and meets the windows of its cell by an equi-join on (key, level, cell). The pairs
    looked at are those of windows at most three times as wide, and the cells of a hot key are spread over all tasks.

    Columns of ``windows`` that are no keys follow those of ``points``. NULL keys match each other; points without a
    time and windows without a border or with the end before the start meet nothing.
    """
    a, b, t = F.col(start).cast("double"), F.col(end).cast("double"), F.col(ts).cast("double")
    fine, coarse = F.lit(float(FINEST_LEVEL)), F.lit(float(COARSEST_LEVEL))
    level = F.when(a < b, F.ceil(F.log2(b - a)).cast("double")).otherwise(fine)
    placed = windows.where(a <= b).withColumn("_level", F.greatest(fine, F.least(coarse, level)))
    cell = F.pow(F.lit(2.0), "_level")
    cells = F.sequence(F.floor(a / cell), F.floor(b / cell))
    placed = placed.withColumn("_cell", F.explode(cells))
    levels = placed.select(*keys, "_level").distinct()
    copies = null_safe_join(points.where(t.isNotNull()), levels, keys, "inner").withColumn("_cell", F.floor(t / cell))
    met = null_safe_join(copies, placed, [*keys, "_level", "_cell"], "inner")
    return met.where((t >= a) & (t <= b)).drop("_level", "_cell")
