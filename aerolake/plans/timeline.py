"""Temporal structure of each log: span, arm regions, modes, altitude, phases, flights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.functions import columns as C
from aerolake.functions import fixed
from aerolake.operators.asof import interp_clamped
from aerolake.operators.decimate import decimate_even
from aerolake.operators.intervals import (
    count_in_windows, interval_lookup, match_intervals, overlap_distinct)
from aerolake.operators.ordered import Ordered, needs_split, null_safe_join
from aerolake.operators.resample import resample
from aerolake.operators.segments import change_segments, merge_slivers, paired_regions, state_regions
from aerolake.plans.events import flight_events, with_event_position
from aerolake.session import cut
from aerolake.schema import KEY, Source, any_number, first_source, has_number, number, plain

ALTITUDE_SOURCES = (
    Source("POS", None, "RelHomeAlt"), Source("BARO", 0, "Alt"), Source("BARO", None, "Alt"),
    Source("BARO", 1, "Alt"), Source("SIM2", None, "PD", -1.0), Source("POS", None, "Alt"),
)


def fleet_split(telemetry: DataFrame) -> bool:
    """Whether some log holds too many records of one message for a single task."""
    return needs_split(telemetry, ["log_id", "msg"])


def log_span(telemetry: DataFrame) -> DataFrame:
    timed = telemetry.where(F.col("t").isNotNull())
    return timed.groupBy(*KEY).agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def message_sizes(telemetry: DataFrame) -> DataFrame:
    """(log_id, msg, n, t_first, t_last): what both ``fleet_split`` and ``log_span`` look for, in one pass."""
    return telemetry.groupBy(*KEY, "msg").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def message_range(telemetry: DataFrame) -> DataFrame:
    return telemetry.where(F.col("t").isNotNull()).groupBy(*KEY, "msg", "instance").agg(
        F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def arm_regions(telemetry: DataFrame, span: DataFrame | None = None,
                split: bool | None = None) -> DataFrame:
    """(log_id, idx, t_start, t_end, source): from ARM records, else from arming events."""
    split = fleet_split(telemetry) if split is None else split
    span = log_span(telemetry) if span is None else span
    arm = plain(telemetry, "ARM").where(F.col("t").isNotNull())
    with_state = arm.where(any_number(*fixed.ARM_STATE))
    armed = F.coalesce(number(*fixed.ARM_STATE).cast("bigint") == 1, F.lit(False))
    by_state = state_regions(with_state, KEY, "t", ["seq", "t"], armed, span, split=split)
    stateless = arm.where(~any_number(*fixed.ARM_STATE))
    by_pairs = paired_regions(stateless, KEY, "t", ["seq", "t"], span, split=split)
    from_arm = by_state.unionByName(by_pairs).withColumn("source", F.lit("ARM"))

    event = number("Id").cast("bigint")
    switch = plain(telemetry, "EV").where(
        F.col("t").isNotNull() & has_number("Id")
        & event.isin(*fixed.ARMING_EVENT_IDS, fixed.DISARMING_EVENT_ID))
    on = event.isin(*fixed.ARMING_EVENT_IDS)
    from_events = state_regions(switch, KEY, "t", ["t", "seq"], on, span, split=split)
    covered = from_arm.select(F.col("log_id").alias("_covered")).distinct()
    fallback = from_events.join(covered, F.col("log_id") == F.col("_covered"), "left_anti")
    return from_arm.unionByName(fallback.withColumn("source", F.lit("EV")))


def mode_segments(telemetry: DataFrame, span: DataFrame | None = None,
                  split: bool | None = None) -> DataFrame:
    split = fleet_split(telemetry) if split is None else split
    span = log_span(telemetry) if span is None else span
    rows = plain(telemetry, "MODE").where(
        F.col("t").isNotNull() & any_number(*fixed.MODE_NUMBER))
    rows = rows.select(*KEY, "seq", "t", number(*fixed.MODE_NUMBER).cast("bigint").alias("mode_num"))
    runs = change_segments(rows, KEY, "t", ["t", "seq"], "mode_num", span, split=split)
    return runs.withColumn("mode", C.mode_name(F.col("mode_num")))


def altitude_series(telemetry: DataFrame) -> DataFrame:
    """(log_id, seq, t, agl, source) from the first altitude source each log has."""
    return first_source(telemetry, ALTITUDE_SOURCES).withColumnRenamed("value", "agl")


def altitude_profile(telemetry: DataFrame, max_points: int = 2000,
                     split: bool | None = None) -> DataFrame:
    return decimate_even(altitude_series(telemetry), KEY, ["seq"], max_points, split)


def flight_windows(telemetry: DataFrame, regions: DataFrame | None = None,
                   events: DataFrame | None = None, modes: DataFrame | None = None,
                   altitude: DataFrame | None = None, split: bool | None = None) -> DataFrame:
    """One row per armed region: times, peak height, event count, distinct modes."""
    split = fleet_split(telemetry) if split is None else split
    # The regions are few and read several times below: cut once instead of planned repeatedly.
    regions = cut(arm_regions(telemetry, split=split) if regions is None else regions)
    events = flight_events(telemetry) if events is None else events
    modes = mode_segments(telemetry, split=split) if modes is None else modes
    altitude = altitude_series(telemetry) if altitude is None else altitude
    heights = match_intervals(altitude.select(*KEY, "seq", "t", "agl"), regions, KEY, "t", ["idx"],
                              "idx", split=split)
    peaks = heights.groupBy(*KEY, F.col("i_idx").alias("idx")).agg(F.max("agl").alias("_peak"))
    counted = count_in_windows(regions, with_event_position(events), KEY, "t", "ord",
                               out="event_count", split=split)
    counted = overlap_distinct(counted, modes, KEY, "idx", "mode_num", "idx", out="mode_count",
                               split=split)
    joined = null_safe_join(counted, peaks, [*KEY, "idx"], "left")
    return joined.select(
        *KEY, F.col("idx").alias("flight_index"), "t_start", "t_end",
        (F.col("t_end") - F.col("t_start")).alias("duration"),
        F.coalesce("_peak", F.lit(0.0)).alias("peak_agl"), "event_count", "mode_count", "source")


def log_summary(span: DataFrame, flights: DataFrame, events: DataFrame) -> DataFrame:
    totals = flights.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("flight_count"), F.sum("duration").alias("armed_total_s"),
        F.max("peak_agl").alias("peak_agl_m"))
    counts = events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("event_total"))
    joined = null_safe_join(null_safe_join(span, totals, KEY, "left"), counts, KEY, "left")
    return joined.select(
        *KEY, "t_first", "t_last",
        F.coalesce("flight_count", F.lit(0)).alias("flight_count"),
        F.coalesce("armed_total_s", F.lit(0.0)).alias("armed_total_s"),
        F.coalesce("peak_agl_m", F.lit(0.0)).alias("peak_agl_m"),
        F.coalesce("event_total", F.lit(0)).alias("event_total"))


def _rate_states(regions: DataFrame, altitude: DataFrame, split: bool) -> DataFrame:
    """Climb / hover / descent runs of every armed region on its half-second grid."""
    points = F.greatest(F.lit(2), F.floor((F.col("t_end") - F.col("t_start")) / fixed.PHASE_STEP_S) + 1)
    grid = resample(regions, altitude.withColumnRenamed("agl", "h"), KEY, "t", "h", "seq", points,
                    out="agl", split=split)
    keys = [*KEY, "region"]
    near = Ordered(grid, keys, ["i"], split).add(
        prev={"_p": F.struct("t", "agl")}, next={"_n": F.struct("t", "agl")})
    left, right = F.coalesce("_p", F.struct("t", "agl")), F.coalesce("_n", F.struct("t", "agl"))
    rate = (right["agl"] - left["agl"]) / (right["t"] - left["t"])
    rated = near.withColumn("_rate", rate)
    around = Ordered(rated, keys, ["i"], split).add(
        prev={"_before": F.col("_rate")}, next={"_after": F.col("_rate")})
    smooth = (F.coalesce("_before", F.lit(0.0)) + F.col("_rate") + F.coalesce("_after", F.lit(0.0))) / 3
    two_points = F.floor((F.col("t_end") - F.col("t_start")) / fixed.PHASE_STEP_S) + 1 <= 2
    value = F.when(two_points, F.col("_rate")).otherwise(smooth)
    kind = (F.when(value > fixed.CLIMB_RATE, F.lit("CLIMB"))
            .when(value < -fixed.CLIMB_RATE, F.lit("DESCENT")).otherwise(F.lit("HOVER")))
    states = around.withColumn("kind", kind)
    ends = regions.select(*keys, "t_end")
    return change_segments(states, keys, "t", ["i", "t"], "kind", ends, end="t_end", split=split)


def phases(telemetry: DataFrame, regions: DataFrame | None = None, modes: DataFrame | None = None,
           span: DataFrame | None = None, split: bool | None = None) -> DataFrame:
    """(log_id, idx, kind, t_start, t_end): contiguous flight phases of every log."""
    split = fleet_split(telemetry) if split is None else split
    span = log_span(telemetry) if span is None else span
    span = cut(span)
    regions = cut(arm_regions(telemetry, span, split) if regions is None else regions)
    modes = mode_segments(telemetry, span, split) if modes is None else modes
    altitude = altitude_series(telemetry)
    regions = regions.select(*KEY, F.col("idx").alias("region"), "t_start", "t_end")
    sizes = altitude.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_alt_rows"))
    sized = null_safe_join(regions, sizes, KEY, "left")
    flown = (F.coalesce("_alt_rows", F.lit(0)) >= 2) & (F.col("t_end") > F.col("t_start"))
    blank = sized.where(~flown).select(*KEY, "region", F.lit(0).cast("bigint").alias("idx"),
                                       F.lit("FLIGHT").alias("kind"), "t_start", "t_end")
    flown_regions = cut(sized.where(flown).drop("_alt_rows"))
    keys = [*KEY, "region"]
    runs = cut(_rate_states(flown_regions, altitude, split))

    # Ground contact at the region's two ends renames its first climb and its last descent.
    edges = flown_regions.select(*keys, F.explode(F.array("t_start", "t_end")).alias("t"), "t_start")
    heights = interp_clamped(edges, altitude, KEY, "t", "agl", "seq", out="h", split=split)
    ground = heights.groupBy(*keys).agg(
        F.max(F.when(F.col("t") == F.col("t_start"), F.col("h"))).alias("_h0"),
        F.max(F.when(F.col("t") != F.col("t_start"), F.col("h"))).alias("_h1"))
    last = runs.groupBy(*keys).agg(F.max("idx").alias("_last"))
    runs = null_safe_join(null_safe_join(runs, ground, keys, "left"), last, keys, "left")
    kind = (
        F.when((F.col("idx") == 0) & (F.col("kind") == "CLIMB") & (F.col("_h0") < fixed.GROUND_AGL_M),
               F.lit("TAKEOFF"))
        .when((F.col("idx") == F.col("_last")) & (F.col("kind") == "DESCENT")
              & (F.col("_h1") < fixed.GROUND_AGL_M * 3), F.lit("LAND"))
        .otherwise(F.col("kind")))
    runs = runs.withColumn("kind", kind).withColumn("t", (F.col("t_start") + F.col("t_end")) * 0.5)
    runs = interval_lookup(runs, modes, KEY, "t", ["mode"], "idx", out="_mode", split=split)
    mode = F.col("_mode.mode")
    override = (F.when(mode.isin(*fixed.RTL_MODES), F.lit("RTL"))
                .when(mode.isin(*fixed.LAND_MODES) & F.col("kind").isin("DESCENT", "HOVER"), F.lit("LAND"))
                .otherwise(F.col("kind")))
    named = runs.withColumn("kind", override).select(*keys, "idx", "kind", "t_start", "t_end")
    merged = change_segments(
        named.withColumnRenamed("t_start", "t").select(*keys, "idx", "kind", "t"), keys, "t",
        ["idx", "t"], "kind", flown_regions, end="t_end", split=split)
    inside = merged.select(*keys, "idx", "kind", "t_start", "t_end").unionByName(blank)

    bounds = regions.groupBy(*KEY).agg(
        F.min_by("t_start", "region").alias("_first"), F.max_by("t_end", "region").alias("_last"))
    logs = null_safe_join(span, bounds, KEY, "left")
    far = F.lit(1 << 62)
    pre = logs.where(F.col("_first") > F.col("t_first")).select(
        *KEY, F.lit(-1).cast("bigint").alias("region"), F.lit(0).cast("bigint").alias("idx"),
        F.lit("PRE_ARM").alias("kind"), F.col("t_first").alias("t_start"), F.col("_first").alias("t_end"))
    post = logs.where(F.col("_last") < F.col("t_last")).select(
        *KEY, far.cast("bigint").alias("region"), F.lit(0).cast("bigint").alias("idx"),
        F.lit("POST").alias("kind"), F.col("_last").alias("t_start"), F.col("t_last").alias("t_end"))
    whole = logs.where(F.col("_first").isNull() & (F.col("t_last") > F.col("t_first"))).select(
        *KEY, F.lit(0).cast("bigint").alias("region"), F.lit(0).cast("bigint").alias("idx"),
        F.lit("FLIGHT").alias("kind"), F.col("t_first").alias("t_start"), F.col("t_last").alias("t_end"))
    every = inside.unionByName(pre).unionByName(post).unionByName(whole)
    return merge_slivers(cut(every), KEY, ["region", "idx"], shortest=fixed.MIN_PHASE_S, split=split)
