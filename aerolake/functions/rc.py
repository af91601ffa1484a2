"""RC channel settings from parameters, and stick normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import fixed
from aerolake.functions.columns import clip

MAX_CHANNEL = 16


def rc_config(params: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and axis: channel, pmin, pmax, ptrim, dz, reversed.

    ``params`` has (keys, name, value), one row per name. The few RC names of a key are folded
    into one map by an aggregate, so everything after it is row-local.
    """
    wanted = F.col("name").rlike(r"^(RCMAP_(ROLL|PITCH|YAW|THROTTLE)|RC\d+_(MIN|MAX|TRIM|DZ|REVERSED|REV))$")
    usable = F.when(wanted & ~F.isnan("value"), F.struct("name", "value"))
    packed = params.groupBy(*keys).agg(F.map_from_entries(F.collect_list(usable)).alias("_p"))
    axes = F.explode(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.lit(a.upper()).alias("tag"),
                 F.lit(fixed.RC_DEFAULT_CHANNEL[a]).alias("default")) for a in fixed.RC_AXES]))
    rows = packed.withColumn("_a", axes)
    mapped = F.col("_p")[F.concat(F.lit("RCMAP_"), F.col("_a.tag"))].cast("bigint")
    channel = F.when(mapped.between(1, MAX_CHANNEL), mapped).otherwise(F.col("_a.default"))
    rows = rows.select(*keys, F.col("_a.axis").alias("axis"), channel.cast("int").alias("channel"), "_p")

    def setting(suffix: str) -> Column:
        return F.col("_p")[F.concat(F.lit("RC"), F.col("channel").cast("string"), F.lit(suffix))]

    low = F.coalesce(setting("_MIN"), F.lit(fixed.RC_DEFAULT_MIN))
    high = F.coalesce(setting("_MAX"), F.lit(fixed.RC_DEFAULT_MAX))
    sane = low < high
    rows = rows.withColumns({
        "pmin": F.when(sane, low).otherwise(F.lit(fixed.RC_DEFAULT_MIN)),
        "pmax": F.when(sane, high).otherwise(F.lit(fixed.RC_DEFAULT_MAX)),
        "_trim": F.coalesce(setting("_TRIM"), F.lit(fixed.RC_DEFAULT_TRIM)),
        "dz": F.greatest(F.coalesce(setting("_DZ"), F.lit(0.0)), F.lit(0.0)),
        "reversed": F.when(setting("_REVERSED").isNotNull(),
                           setting("_REVERSED").cast("bigint") == 1)
        .otherwise(F.coalesce(setting("_REV") < 0, F.lit(False))),
    })
    trim = F.when(F.col("_trim").between(F.col("pmin"), F.col("pmax")), F.col("_trim")).otherwise(
        (F.col("pmin") + F.col("pmax")) / 2.0)
    return rows.withColumn("ptrim", trim).select(
        *keys, "axis", "channel", "pmin", "pmax", "ptrim", "dz", "reversed")


def default_config(df: DataFrame, keys: list[str]) -> DataFrame:
    """The settings of keys without any parameter."""
    empty = df.select(*keys).distinct().withColumn("name", F.lit("")).withColumn("value", F.lit(0.0))
    return rc_config(empty, keys)


def stick_position(axis: Column, pwm: Column, pmin: Column, pmax: Column, ptrim: Column, dz: Column,
                   reverse: Column) -> Column:
    """Pulse width to intent: throttle 0..1, other axes -1..1 around the trim's dead zone."""
    level = clip((pwm - pmin) / (pmax - pmin), 0.0, 1.0)
    throttle = F.when(reverse, 1.0 - level).otherwise(level)
    off = pwm - ptrim
    reach = F.when(off > 0, pmax - ptrim).otherwise(ptrim - pmin) - dz
    travel = F.when(reach <= 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), (F.abs(off) - dz) / F.when(reach > 0, reach)))
    side = F.signum(off) * F.when(reverse, F.lit(-1.0)).otherwise(F.lit(1.0))
    centred = F.when(F.abs(off) <= dz, F.lit(0.0)).otherwise(side * travel)
    return F.when(pwm.isNotNull(), F.when(axis == "throttle", throttle).otherwise(centred))


def stick_simple(axis: Column, pwm: Column, pmin: Column, pmax: Column, ptrim: Column) -> Column:
    """The variant used by pilot statistics: symmetric half range, no dead zone, no reversal."""
    span = F.greatest(pmax - pmin, F.lit(1.0))
    half = F.greatest((pmax - pmin) / 2.0, F.lit(1.0))
    return F.when(axis == "throttle", clip((pwm - pmin) / span, 0.0, 1.0)).otherwise(
        clip((pwm - ptrim) / half, -1.0, 1.0))
