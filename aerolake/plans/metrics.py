"""Headline numbers of each log: duration, height, speed, distance, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.functions import columns as C
from aerolake.functions import fixed
from aerolake.operators.ordered import null_safe_join
from aerolake.plans.events import flight_events
from aerolake.plans.trajectory import best_trajectory, path_length
from aerolake.schema import KEY, has_number, number


def _is(msg: str, instance: int | None = None):
    same = F.col("instance").isNull() if instance is None else F.coalesce(
        F.col("instance") == instance, F.lit(False))
    return (F.col("msg") == msg) & same


def scalar_metrics(telemetry: DataFrame) -> DataFrame:
    """Everything that needs no row order, in one pass of conditional partial aggregates."""
    arm, ev = _is("ARM"), _is("EV") & has_number("Id")
    event = number("Id").cast("bigint")
    vector = has_number("VN") & has_number("VE") & has_number("VD")
    speed3 = C.speed_3d(number("VN"), number("VE"), number("VD"))
    aggs = [
        F.min("t").alias("_t0"), F.max("t").alias("_t1"),
        F.count_if(arm).alias("arm_count"), F.count_if(arm & F.col("t").isNotNull()).alias("_arm_n"),
        F.min(F.when(arm, F.col("t"))).alias("_arm0"), F.max(F.when(arm, F.col("t"))).alias("_arm1"),
        F.min(F.when(ev & event.isin(*fixed.ARMING_EVENT_IDS), F.col("t"))).alias("_ev0"),
        F.max(F.when(ev & (event == fixed.DISARMING_EVENT_ID), F.col("t"))).alias("_ev1"),
        F.max(F.when(_is("POS"), number("RelHomeAlt"))).alias("_agl"),
        F.max(F.when(_is("BARO", 0), number("Alt"))).alias("_b0"),
        F.max(F.when(_is("BARO"), number("Alt"))).alias("_b"),
        F.max(F.when(_is("BARO", 1), number("Alt"))).alias("_b1"),
        F.max(F.when(_is("SIM2"), -number("PD"))).alias("_sim"),
        F.max(F.when(_is("POS"), number("Alt"))).alias("_amsl"),
        F.max(F.when(_is("SIM2") & vector, speed3)).alias("_v3"),
        F.max(F.when(_is("GPS"), number("Spd", "GndSpd", "Spd3D"))).alias("_vg"),
        F.max(F.when(_is("GPS", 0), number("Spd", "GndSpd", "Spd3D"))).alias("_vg0"),
    ]
    rows = telemetry.groupBy(*KEY).agg(*aggs)
    armed = F.when(F.col("_arm_n") >= 2, F.col("_arm1") - F.col("_arm0"))
    switched = F.when(F.col("_ev1") - F.col("_ev0") > 0, F.col("_ev1") - F.col("_ev0"))
    span = F.coalesce(F.col("_t1") - F.col("_t0"), F.lit(0.0))
    altitude = F.coalesce("_agl", "_b0", "_b", "_b1", "_sim", "_amsl")
    speed = F.coalesce("_v3", "_vg", "_vg0")
    source = (F.when(F.col("_agl").isNotNull(), F.lit("AGL"))
              .when(F.coalesce("_b0", "_b", "_b1").isNotNull(), F.lit("BARO"))
              .when(F.col("_sim").isNotNull(), F.lit("SIM2"))
              .when(F.col("_amsl").isNotNull(), F.lit("AMSL")))
    return rows.select(
        *KEY, span.alias("span_s"), F.coalesce(armed, switched, span).alias("duration_s"),
        F.coalesce(altitude, F.lit(0.0)).alias("max_altitude_m"), source.alias("altitude_kind"),
        C.altitude_text(altitude).alias("altitude_text"),
        F.coalesce(speed, F.lit(0.0)).alias("max_speed_mps"), C.speed_text(speed).alias("speed_text"),
        "arm_count")


def flight_metrics(telemetry: DataFrame, events: DataFrame | None = None,
                   split: bool | None = None) -> DataFrame:
    events = flight_events(telemetry) if events is None else events
    counts = events.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_events"), F.count_if(F.col("type") == "MODE").alias("_modes"))
    lengths = path_length(best_trajectory(telemetry, split), split=split)
    rows = null_safe_join(scalar_metrics(telemetry), counts, KEY, "left")
    rows = null_safe_join(rows, lengths, KEY, "left")
    return rows.withColumns({
        "duration_text": C.minutes_seconds(F.col("duration_s")),
        "distance_text": C.distance_text(F.col("distance_m")),
        "distance_m": F.coalesce("distance_m", F.lit(0.0)),
        "event_count": F.coalesce("_events", F.lit(0)),
        "mode_change_count": F.coalesce("_modes", F.lit(0)),
    }).drop("_events", "_modes")
