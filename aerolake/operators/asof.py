"""As-of joins: value lookups at arbitrary times, for many cursors and signals in one shuffle.

Cursors and samples are unioned, ordered once per key and looked up by filling; see
``ordered.py`` for hot keys. ``keys`` may contain the signal name, so a whole watch list is
one call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.operators.ordered import Ordered

_CURSOR, _SAMPLE, _KIND, _SEQ = "_cursor", "_sample", "_kind", "_order"


def bracket(cursors: DataFrame, samples: DataFrame, keys: Sequence[str], ts: str, order: str,
            payload: Sequence[str], exact: str = "upper", sides: Sequence[str] = ("lower", "upper"),
            split: bool | None = None) -> DataFrame:
    """Cursors plus ``lower`` / ``upper``: structs (t, seq, payload...) of the nearest samples.

    ``exact="upper"``: lower has time < cursor, upper is the first sample at or after it.
    ``exact="lower"``: lower is the last sample at or before the cursor, upper has a later time.
    """
    cursor_first = exact == "upper"
    left = cursors.select(
        *keys, F.col(ts).cast("double").alias("_t"),
        F.lit(0 if cursor_first else 1).alias(_KIND), F.lit(None).cast("bigint").alias(_SEQ),
        F.struct(*[F.col(c) for c in cursors.columns]).alias(_CURSOR),
    )
    right = samples.select(
        *keys, F.col(ts).cast("double").alias("_t"),
        F.lit(1 if cursor_first else 0).alias(_KIND), F.col(order).cast("bigint").alias(_SEQ),
        F.struct(F.col(ts).cast("double").alias("t"), F.col(order).cast("bigint").alias("seq"),
                 *[F.col(c) for c in payload]).alias(_SAMPLE),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    ordered = Ordered(both, keys, ["_t", _KIND, _SEQ], split)
    wanted = {}
    if "lower" in sides:
        wanted["last"] = {"lower": F.col(_SAMPLE)}
    if "upper" in sides:
        wanted["following"] = {"upper": F.col(_SAMPLE)}
    found = ordered.add(**wanted).where(F.col(_CURSOR).isNotNull())
    return found.select(f"{_CURSOR}.*", *sides)


def linear_value(t: Column, lower: Column, upper: Column, value: str = "v") -> Column:
    """Linear lookup over an ``exact="upper"`` bracket; NULL outside the samples' range.

    A missing value on one side gives the other side's value, on both sides NULL.
    """
    lo, hi = lower[value], upper[value]
    return (
        F.when(upper.isNull(), F.lit(None).cast("double"))
        .when(lower.isNull(), F.when(upper["t"] == t, hi))
        .when((upper["t"] == t) & hi.isNotNull(), hi)
        .when(lo.isNull(), hi)
        .when(hi.isNull(), lo)
        .otherwise(lo + (hi - lo) * (t - lower["t"]) / (upper["t"] - lower["t"]))
    )


def clamped_value(t: Column, lower: Column, upper: Column, value: str = "v") -> Column:
    """Interpolation over an ``exact="lower"`` bracket that holds the edge values outside."""
    lo, hi = lower[value], upper[value]
    slope = (hi - lo) / (upper["t"] - lower["t"])
    return (
        F.when(lower.isNull(), hi)
        .when(upper.isNull() | (lower["t"] == t), lo)
        .otherwise(slope * (t - lower["t"]) + lo)
    )


def sample_struct(t: Column, lower: Column, upper: Column, value: str = "v") -> Column:
    """Value with provenance: interpolated flag, sample time or the two bracket times."""
    inside = upper.isNotNull() & (lower.isNotNull() | (upper["t"] == t))
    exact = inside & (lower.isNull() | ((upper["t"] == t) & upper[value].isNotNull()))
    between = inside & ~exact
    return F.struct(
        linear_value(t, lower, upper, value).alias("value"),
        t.alias("t"),
        F.coalesce(between, F.lit(False)).alias("interpolated"),
        F.when(exact, upper["t"]).alias("sample_t"),
        F.when(between, F.array(lower["t"], upper["t"])).alias("bracket"),
    )


def _as_v(samples: DataFrame, keys, ts, order, value) -> DataFrame:
    return samples.select(*keys, ts, order, F.col(value).cast("double").alias("v"))


def asof_linear(cursors, samples, keys, ts, value, order, out="value", split=None) -> DataFrame:
    found = bracket(cursors, _as_v(samples, keys, ts, order, value), keys, ts, order, ["v"],
                    split=split)
    result = linear_value(F.col(ts).cast("double"), F.col("lower"), F.col("upper"))
    return found.withColumn(out, result).drop("lower", "upper")


def asof_sample(cursors, samples, keys, ts, value, order, out="sample", split=None) -> DataFrame:
    found = bracket(cursors, _as_v(samples, keys, ts, order, value), keys, ts, order, ["v"],
                    split=split)
    result = sample_struct(F.col(ts).cast("double"), F.col("lower"), F.col("upper"))
    return found.withColumn(out, result).drop("lower", "upper")


def asof_hold(cursors, samples, keys, ts, payload: Sequence[str], order, out="held",
              split=None) -> DataFrame:
    """Last sample at or before each cursor as a struct; its missing values stay missing."""
    found = bracket(cursors, samples, keys, ts, order, payload, exact="lower", sides=["lower"],
                    split=split)
    return found.withColumnRenamed("lower", out)


def asof_forward(cursors, samples, keys, ts, payload: Sequence[str], order, out="found",
                 clamp=True, split=None) -> DataFrame:
    """First sample at or after each cursor; past the end the last sample when ``clamp``."""
    sides = ["lower", "upper"] if clamp else ["upper"]
    found = bracket(cursors, samples, keys, ts, order, payload, sides=sides, split=split)
    pick = F.coalesce("upper", "lower") if clamp else F.col("upper")
    return found.withColumn(out, pick).drop("lower", "upper")


def interp_clamped(cursors, samples, keys, ts, value, order, out="value", split=None) -> DataFrame:
    clean = _as_v(samples, keys, ts, order, value).where(F.col("v").isNotNull())
    found = bracket(cursors, clean, keys, ts, order, ["v"], exact="lower", split=split)
    result = clamped_value(F.col(ts).cast("double"), F.col("lower"), F.col("upper"))
    return found.withColumn(out, result).drop("lower", "upper")


def sample_index(cursors, samples, keys, ts, order, out_t="sample_t", out_index="index",
                 split=None) -> DataFrame:
    """Time and 0-based position of the sample at or before each cursor."""
    ranked = Ordered(samples.select(*keys, ts, order), keys, [ts, order], split).add(position="_n")
    held = asof_hold(cursors, ranked, keys, ts, ["_n"], order, out="_held", split=split)
    return held.withColumns({
        out_t: F.col("_held.t"), out_index: F.col("_held._n") - 1}).drop("_held")


def step_event(cursors, events, keys, ts, order, direction: str, slack=1e-6, payload=(),
               out="event", split=None) -> DataFrame:
    """Nearest event later than t + slack ("next") or earlier than t - slack ("previous").

    The cursor is moved by the slack first, so the lookup stays one as-of join.
    """
    if direction == "next":
        moved = cursors.withColumn("_at", F.col(ts)).withColumn(ts, F.col(ts) + slack)
        found = bracket(moved, events, keys, ts, order, payload, exact="lower", sides=["upper"],
                        split=split).withColumnRenamed("upper", out)
    else:
        moved = cursors.withColumn("_at", F.col(ts)).withColumn(ts, F.col(ts) - slack)
        found = bracket(moved, events, keys, ts, order, payload, exact="upper", sides=["lower"],
                        split=split).withColumnRenamed("lower", out)
    return found.withColumn(ts, F.col("_at")).drop("_at")


def nearest_event(cursors, events, keys, ts, order, payload, out="event", within: float | None = None,
                  ties: str = "first", split=None) -> DataFrame:
    """Event with the smallest time distance, optionally at most ``within`` seconds away.

    The nearest event is one of four: the last and the first row of the times next below and
    next at-or-above the cursor. Events of one time are reduced to their first and last row
    beforehand, so that each side of the bracket carries both tie choices.
    """
    row = F.struct(F.col(ts).cast("double").alias("t"), F.col(order).cast("bigint").alias("seq"),
                   *[F.col(c) for c in payload])
    per_time = events.groupBy(*keys, ts).agg(
        F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"),
        F.min(order).alias("_first_seq"))
    found = bracket(cursors, per_time, keys, ts, "_first_seq", ["first", "last"], split=split)
    t = F.col(ts).cast("double")
    pick = "first" if ties == "first" else "last"
    low, high = F.col("lower")[pick], F.col("upper")[pick]
    low_gap, high_gap = t - F.col("lower.t"), F.col("upper.t") - t
    prefer_low = low_gap < high_gap if ties == "last" else low_gap <= high_gap
    best = (F.when(F.col("lower").isNull(), high).when(F.col("upper").isNull(), low)
            .when(prefer_low, low).otherwise(high))
    found = found.withColumn(out, best)
    if within is not None:
        found = found.withColumn(out, F.when(F.abs(F.col(out)["t"] - t) <= within, F.col(out)))
    return found.drop("lower", "upper")
