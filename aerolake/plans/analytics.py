"""Flight analytics over the armed windows: tracking, smoothness, landing, oscillation,
saturation, findings, scorecard, verdict and the report that joins them, one row per log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import columns as C
from aerolake.functions import fixed
from aerolake.functions.rc import default_config, rc_config, stick_simple
from aerolake.operators.asof import interp_clamped
from aerolake.operators.intervals import few_windows, within_windows
from aerolake.operators.ordered import Ordered, null_safe_join
from aerolake.operators.spectrum import dominant_peaks
from aerolake.plans.health import anomalies, parameters
from aerolake.plans.timeline import altitude_series, arm_regions, log_span, message_sizes
from aerolake.session import cut, rows_per_task
from aerolake.schema import KEY, any_number, number, plain, records

AXIS = [*KEY, "axis"]


def armed_windows(telemetry: DataFrame, span: DataFrame | None = None, split: bool | None = None) -> DataFrame:
    """(log_id, idx, t_start, t_end): arm regions, or the whole log where there are none."""
    span = log_span(telemetry) if span is None else span
    regions = arm_regions(telemetry, span, split).drop("source")
    have = regions.select(F.col("log_id").alias("_have")).distinct()
    rest = span.join(have, F.col("log_id") == F.col("_have"), "left_anti").where(F.col("t_last") > F.col("t_first"))
    whole = rest.select(*KEY, F.lit(0).cast("bigint").alias("idx"), F.col("t_first").alias("t_start"),
                        F.col("t_last").alias("t_end"))
    return regions.unionByName(whole)


def armed_totals(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*KEY).agg(
        F.sum(F.col("t_end") - F.col("t_start")).alias("armed_s"), F.count(F.lit(1)).alias("flight_count"),
        F.max_by("t_end", "idx").alias("last_end"))


def in_windows(rows: DataFrame, windows: DataFrame, split: bool | None = None,
               few: bool | None = None) -> DataFrame:
    return within_windows(rows, windows, KEY, "t", small=few, split=split)


def attitude_errors(telemetry: DataFrame, windows: DataFrame, split: bool | None = None,
                    gaps: bool | None = None, few: bool | None = None) -> DataFrame:
    """(log_id, axis, seq, t, act, des) inside the armed windows.

    Demand and response come from one record, so they pair row by row; only where a demand is
    missing it is interpolated from its neighbours. ``gaps=False`` states that none is missing
    and leaves that join out; None looks, over all windows and what lies between them, which is one narrow pass.
    """
    timed = plain(telemetry, "ATT").where(F.col("t").isNotNull())
    if gaps is None:
        missing = [any_number(act) & any_number(des) & number(act).isNotNull() & number(des).isNull() for act, des in fixed.ATTITUDE_COLUMNS.values()]
        gaps = not timed.where(reduce(Column.__or__, missing)).isEmpty()
    axes = F.explode(F.array(*[
        F.struct(F.lit(axis).alias("axis"), number(act).alias("act"), number(des).alias("des"),
                 (any_number(act) & any_number(des)).alias("has"))
        for axis, (act, des) in fixed.ATTITUDE_COLUMNS.items()]))
    rows = in_windows(timed, windows, split, few)
    rows = rows.select(*KEY, "seq", "t", axes.alias("_a")).select(*KEY, "seq", "t", "_a.*")
    rows = rows.where("has").drop("has")
    incomplete = rows.where(F.col("act").isNotNull() & F.col("des").isNull())
    paired = rows.where(F.col("act").isNotNull() & F.col("des").isNotNull())
    if gaps:
        demands = rows.where(F.col("des").isNotNull())
        filled = interp_clamped(incomplete.drop("des"), demands, AXIS, "t", "des", "seq", out="des", split=split)
        paired = paired.unionByName(filled.where(F.col("des").isNotNull()).select(*paired.columns))
        counts = rows.groupBy(*AXIS).agg(F.count("act").alias("_a"), F.count("des").alias("_d"))
        enough = counts.where((F.col("_a") >= 2) & (F.col("_d") >= 2))
    else:
        counts = paired.groupBy(*AXIS).agg(F.count(F.lit(1)).alias("_a"))
        enough = counts.where(F.col("_a") >= 2)
    return null_safe_join(paired, enough.select(*AXIS), AXIS, "left_semi")


def tracking(errors: DataFrame) -> DataFrame:
    err = F.abs(C.angle_diff(F.col("act"), F.col("des")))
    tolerance = C.pick(F.col("axis"), fixed.TRACK_TOLERANCE_DEG)
    rows = errors.select(*AXIS, err.alias("e"), tolerance.alias("tol"))
    grouped = rows.groupBy(*AXIS).agg(
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms_deg"), F.max("e").alias("max_deg"),
        (F.avg((F.col("e") <= F.col("tol")).cast("double")) * 100.0).alias("pct_in_tol"),
        F.first("tol").alias("_tol"))
    score = C.clip(F.lit(100.0) * (F.lit(1.0) - F.col("rms_deg") / (F.lit(3.0) * F.col("_tol"))), 0.0, 100.0)
    return grouped.withColumn("score", score).drop("_tol")


def stick_series(telemetry: DataFrame, windows: DataFrame, split: bool | None = None,
                 few: bool | None = None, logs: DataFrame | None = None) -> DataFrame:
    """(log_id, axis, seq, t, stick) of roll, pitch and yaw, for axes with at least 3 readings.

    ``logs``: the logs that have records with a time, if they are known.
    """
    config = rc_config(parameters(telemetry), KEY)
    logs = telemetry.select(*KEY).distinct() if logs is None else logs
    bare = null_safe_join(logs, config.select(*KEY).distinct(), KEY, "left_anti")
    config = config.unionByName(default_config(bare, KEY)).where(F.col("axis") != "throttle")
    rows = in_windows(plain(telemetry, "RCIN").where(F.col("t").isNotNull()), windows, split, few)
    rows = rows.select(*KEY, "seq", "t", "ints", "reals")
    rows = null_safe_join(rows, config, KEY, "inner")
    name = F.concat(F.lit("C"), F.col("channel").cast("string"))
    pwm = F.coalesce(F.col("reals")[name], F.col("ints")[name].cast("double"))
    stick = stick_simple(F.col("axis"), pwm, F.col("pmin"), F.col("pmax"), F.col("ptrim"))
    rows = rows.where(pwm.isNotNull()).select(*AXIS, "seq", "t", stick.alias("stick"))
    counts = rows.groupBy(*AXIS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 3)
    return null_safe_join(rows, counts.select(*AXIS), AXIS, "left_semi")


def rates(series: DataFrame, keys: list[str], value: str, split: bool | None = None) -> DataFrame:
    """Change per second between neighbouring rows; steps without time passing are dropped."""
    steps = Ordered(series, keys, ["t", "seq"], split).add(prev={"_p": F.struct(F.col("t"), F.col(value).alias("v"))})
    dt = F.col("t") - F.col("_p.t")
    rate = F.when(dt > 0, (F.col(value) - F.col("_p.v")) / dt)
    return steps.withColumn("rate", rate).where(F.col("rate").isNotNull()).drop("_p")


def reversal_counts(rated: DataFrame, keys: list[str], deadband: float = 0.05,
                    split: bool | None = None) -> DataFrame:
    """Sign changes of the rate, ignoring rates inside the dead band."""
    moving = rated.where(F.abs("rate") > deadband).withColumn("_s", F.signum("rate"))
    signs = Ordered(moving, keys, ["t", "seq"], split).add(prev={"_q": F.col("_s")})
    return signs.groupBy(*keys).agg(F.count_if(F.col("_q") != F.col("_s")).alias("reversals"))


def smoothness(sticks: DataFrame, totals: DataFrame, split: bool | None = None) -> DataFrame:
    rated = rates(sticks, AXIS, "stick", split)
    activity = rated.groupBy(*AXIS).agg(F.avg(F.abs("rate")).alias("activity"))
    turns = reversal_counts(rated, AXIS, split=split)
    rows = null_safe_join(null_safe_join(activity, turns, AXIS, "left"), totals, KEY, "left")
    per_s = F.coalesce("reversals", F.lit(0)) / F.greatest(F.coalesce("armed_s", F.lit(0.0)), F.lit(1e-6))
    rows = rows.withColumn("reversals_per_s", per_s)
    return rows.select(*AXIS, "activity", "reversals_per_s", C.linear_score(F.col("reversals_per_s"), 2.0).alias("score"))


def yaw_discipline(errors: DataFrame, sticks: DataFrame, logs: DataFrame) -> DataFrame:
    diff = C.angle_diff(F.col("act"), F.col("des"))
    held = errors.where(F.col("axis") == "yaw").groupBy(*KEY).agg(F.sqrt(F.avg(diff * diff)).alias("yaw_rms"))
    used = sticks.where(F.col("axis") == "yaw").groupBy(*KEY).agg(
        F.avg(F.abs("stick")).alias("yaw_activity"), F.count_if(F.abs("stick") > 0.5).alias("_large"))
    rows = null_safe_join(null_safe_join(logs, held, KEY, "left"), used, KEY, "left")
    parts = (C.linear_score(F.col("yaw_rms"), 3 * fixed.TRACK_TOLERANCE_DEG["yaw"]), C.linear_score(F.col("yaw_activity"), 0.5))
    return rows.select(*KEY, "yaw_rms", "yaw_activity", F.coalesce("_large", F.lit(0)).alias("large_corrections"),
                       C.mean_of(*parts).alias("yaw_score"))


def vertical_rates(telemetry: DataFrame, windows: DataFrame, profile: DataFrame,
                   split: bool | None = None, few: bool | None = None) -> DataFrame:
    """(log_id, t, vs): climb rate inside the windows from the first usable source, else from height."""
    rank = (F.when((F.col("msg") == "BARO") & (F.col("instance") == 0), F.lit(0))
            .when((F.col("msg") == "BARO") & F.col("instance").isNull(), F.lit(1))
            .when((F.col("msg") == "CTUN") & F.col("instance").isNull(), F.lit(2)))
    rows = records(telemetry, "BARO", "CTUN").where(any_number("CRt") & F.col("t").isNotNull())
    rows = rows.select(*KEY, "seq", "t", rank.alias("rank"), number("CRt").alias("vs"))
    rows = in_windows(rows.where(F.col("rank").isNotNull() & F.col("vs").isNotNull()), windows, split, few)
    best = (rows.groupBy(*KEY, "rank").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
            .groupBy(*KEY).agg(F.min("rank").alias("rank")))
    direct = null_safe_join(rows, best, [*KEY, "rank"], "left_semi").select(*KEY, "t", "vs")
    bare = null_safe_join(profile, best.select(*KEY), KEY, "left_anti")
    steps = Ordered(bare.select(*KEY, "seq", "t", "agl"), KEY, ["seq"], split).add(prev={"_p": F.struct("t", "agl")})
    slope = (F.col("agl") - F.col("_p.agl")) / F.greatest(F.col("t") - F.col("_p.t"), F.lit(1e-3))
    derived = steps.where(F.col("_p").isNotNull()).select(*KEY, "t", slope.alias("vs"))
    return direct.unionByName(derived)


def landing(telemetry: DataFrame, windows: DataFrame, totals: DataFrame, split: bool | None = None,
            few: bool | None = None) -> DataFrame:
    """Touchdown after the last airborne sample, and the steepest descent just before it."""
    # All rows of the height series, read five times below.
    profile = cut(altitude_series(telemetry))
    sizes = profile.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 3)
    flown = null_safe_join(null_safe_join(profile, sizes, KEY, "left_semi"), totals, KEY, "inner")
    flown = flown.where(F.col("t") <= F.col("last_end")).select(*KEY, "seq", "t", "agl")
    airborne = flown.where(F.col("agl") > 3.0).groupBy(*KEY).agg(F.max("seq").alias("_air"))
    after = null_safe_join(flown, airborne, KEY, "inner").where((F.col("seq") > F.col("_air")) & (F.col("agl") < 1.0))
    touch = after.groupBy(*KEY).agg(F.min_by("t", "seq").alias("touchdown_t"))
    speeds = null_safe_join(vertical_rates(telemetry, windows, profile, split, few), touch, KEY, "inner")
    near = speeds.where((F.col("t") >= F.col("touchdown_t") - 3.0) & (F.col("t") <= F.col("touchdown_t") + 0.25))
    worst = near.groupBy(*KEY).agg(F.abs(F.least(F.min("vs"), F.lit(0.0))).alias("touchdown_rate"))
    rows = null_safe_join(null_safe_join(totals.select(*KEY), touch, KEY, "left"), worst, KEY, "left")
    return rows.select(
        *KEY, F.col("touchdown_t").isNotNull().alias("landed"), "touchdown_t", "touchdown_rate",
        C.landing_class(F.col("touchdown_rate")).alias("landing_class"),
        C.landing_score(F.col("touchdown_rate")).alias("landing_score"))


def oscillations(errors: DataFrame, logs: DataFrame, long_series: bool | None = None) -> DataFrame:
    """Concentrated spectral peak of the attitude error, per log and axis."""
    series = errors.select(*AXIS, "seq", "t", C.angle_diff(F.col("act"), F.col("des")).alias("v"))
    peaks = dominant_peaks(series, AXIS, fixed.OSC_RATE_HZ, fixed.OSC_MIN_HZ, fixed.OSC_MAX_HZ, long_series)
    axes = F.explode(F.array(*[F.lit(a) for a in fixed.ATTITUDE_COLUMNS]))
    rows = null_safe_join(logs.select(*KEY, axes.alias("axis")), peaks, AXIS, "left")
    amp = F.sqrt("peak_power") * 2.0 / F.col("n") / 0.5
    rows = rows.withColumns({"amp": amp, "_share": F.col("peak_power") / F.col("ac_power")})
    hit = F.coalesce((F.col("amp") >= fixed.OSC_AMP_WARN) & (F.col("_share") >= fixed.OSC_CONCENTRATION), F.lit(False))
    severity = (F.when(~hit, F.lit("OK")).when(F.col("amp") >= fixed.OSC_AMP_CRIT, F.lit("CRITICAL"))
                .otherwise(F.lit("WARNING")))
    return rows.select(
        *AXIS, hit.alias("detected"),
        F.when(hit | (F.col("amp") >= fixed.OSC_AMP_WARN), F.col("freq")).alias("freq_hz"),
        F.when(hit | (F.col("amp") >= 0.5), F.col("amp")).alias("amplitude_deg"), severity.alias("severity"))


def saturation(telemetry: DataFrame, windows: DataFrame, logs: DataFrame, split: bool | None = None,
               few: bool | None = None) -> DataFrame:
    """Share of armed time at the limits: worst motor, worst controller output, throttle."""
    settings = parameters(telemetry).where(F.col("name").isin("MOT_PWM_MIN", "MOT_PWM_MAX"))
    limits = settings.groupBy(*KEY).agg(
        F.max(F.when(F.col("name") == "MOT_PWM_MIN", F.col("value"))).alias("_lo"),
        F.max(F.when(F.col("name") == "MOT_PWM_MAX", F.col("value"))).alias("_hi"))
    rows = records(telemetry, "RCOU", "RATE", "CTUN").where(F.col("instance").isNull() & F.col("t").isNotNull())
    rows = null_safe_join(in_windows(rows, windows, split, few), limits, KEY, "left")
    real = F.coalesce((F.col("_lo") != 0) & (F.col("_hi") != 0) & (F.col("_hi") > F.col("_lo")), F.lit(False))
    low, high = F.when(real, F.col("_lo")).otherwise(1000.0), F.when(real, F.col("_hi")).otherwise(2000.0)
    margin = F.lit(fixed.PWM_MARGIN) * (high - low)

    def channel(kind: str, msg: str, name: str, full) -> Column:
        value = number(name)
        return F.when((F.col("msg") == msg) & value.isNotNull(), F.struct(
            F.lit(kind).alias("kind"), F.lit(name).alias("channel"), full(value).alias("full")))

    at_limit = lambda v: (v >= high - margin) | (v <= low + margin)
    options = [channel("motor", "RCOU", c, at_limit) for c in ("C1", "C2", "C3", "C4")]
    options += [channel("output", "RATE", c, lambda v: F.abs(v) >= fixed.OUTPUT_SATURATED) for c in ("ROut", "POut", "YOut")]
    options += [channel("throttle", "CTUN", "ThO", lambda v: v >= fixed.OUTPUT_SATURATED)]
    long = rows.select(*KEY, F.explode(F.array_compact(F.array(*options))).alias("_c")).select(*KEY, "_c.*")
    shares = long.groupBy(*KEY, "kind", "channel").agg((F.avg(F.col("full").cast("double")) * 100.0).alias("pct"))
    worst = shares.groupBy(*KEY).agg(*[
        F.max(F.when(F.col("kind") == k, F.col("pct"))).alias(f"{k}_pct") for k in ("motor", "output", "throttle")])
    rows = null_safe_join(logs, worst, KEY, "left")
    top = F.greatest("motor_pct", "output_pct", "throttle_pct")
    share = top / 100.0
    severity = (F.when(share >= fixed.SATURATED_FRACTION_CRIT, F.lit("CRITICAL"))
                .when(share >= fixed.SATURATED_FRACTION_WARN, F.lit("WARNING")).otherwise(F.lit("OK")))
    score = F.coalesce(C.linear_score(share, fixed.SATURATED_FRACTION_CRIT), F.lit(100.0))
    return rows.select(*KEY, "motor_pct", "output_pct", "throttle_pct", severity.alias("saturation_severity"),
                       score.alias("saturation_score"))


FINDING_ORDER = ["severity_rank", "t_sort", "rule", "rule_seq"]


def findings(oscillation: DataFrame, track: DataFrame, saturated: DataFrame, landed: DataFrame,
             yaw: DataFrame, anomaly: DataFrame) -> DataFrame:
    """All automated findings, numbered per log by severity, then time, then rule."""
    title = F.initcap("axis")
    axis_rank = C.pick(F.col("axis"), {a: i for i, a in enumerate(fixed.ATTITUDE_COLUMNS)})
    pair = F.array(F.concat(F.lit("ATT."), title), F.concat(F.lit("ATT.Des"), title))

    def rule(rows: DataFrame, number_: int, severity, category, title_, detail, evidence, t=None, seq=None):
        return rows.select(
            *KEY, severity.alias("severity"), category.alias("category"), title_.alias("title"),
            detail.alias("detail"), (t if t is not None else F.lit(None).cast("double")).alias("t_start"),
            evidence.alias("evidence"), F.lit(number_).alias("rule"),
            (seq if seq is not None else F.lit(0)).cast("bigint").alias("rule_seq"))

    lit = F.lit
    parts = [
        rule(oscillation.where("detected"), 0, F.col("severity"), lit("OSCILLATION"),
             F.concat(title, lit(" oscillation")),
             F.concat(lit("Sustained "), C.fixed_text(F.col("freq_hz"), 1), lit(" Hz oscillation, amplitude "),
                      C.fixed_text(F.col("amplitude_deg"), 1), lit("°")), pair, seq=axis_rank),
        rule(track.where(F.col("score") < 60), 1, lit("WARNING"), lit("TRACKING"),
             F.concat(lit("Poor "), F.col("axis"), lit(" tracking")),
             F.concat(title, lit(" demand-vs-response RMS "), C.fixed_text(F.col("rms_deg"), 1), lit("°, only "),
                      C.fixed_text(F.col("pct_in_tol"), 0), lit("% in tolerance")), pair, seq=axis_rank),
        rule(saturated.where(F.col("saturation_severity") != "OK"), 2, F.col("saturation_severity"), lit("SATURATION"),
             lit("Controller / actuator saturation"),
             F.concat(lit("Saturated "), C.fixed_text(F.greatest("motor_pct", "output_pct", "throttle_pct"), 0),
                      lit("% of armed time (motors "), C.fixed_text(F.coalesce("motor_pct", lit(0.0)), 0),
                      lit("%, output "), C.fixed_text(F.coalesce("output_pct", lit(0.0)), 0), lit("%)")),
             F.array(lit("RCOU.C1-4"), lit("RATE.ROut/POut/YOut"))),
        rule(landed.where(F.col("landed") & F.col("landing_class").isin("HARD", "SEVERE")), 3,
             F.when(F.col("landing_class") == "SEVERE", lit("CRITICAL")).otherwise(lit("WARNING")), lit("LANDING"),
             F.concat(F.initcap("landing_class"), lit(" landing")),
             F.concat(lit("Touchdown descent rate "), C.fixed_text(F.col("touchdown_rate"), 1), lit(" m/s")),
             F.array(lit("BARO.CRt"), lit("POS.RelHomeAlt")), t=F.col("touchdown_t")),
        rule(yaw.where(F.col("yaw_score") < 60), 4, lit("WARNING"), lit("YAW"), lit("Excessive yaw correction"),
             F.concat(lit("Yaw discipline score "), C.fixed_text(F.col("yaw_score"), 0), lit(" ("),
                      F.col("large_corrections").cast("string"), lit(" large yaw inputs)")),
             F.array(lit("ATT.Yaw"), lit("ATT.DesYaw"), lit("RCIN(yaw)"))),
        anomaly.select(
            *KEY, "severity", "category", F.concat("category", lit(" anomaly")).alias("title"),
            F.col("message").alias("detail"), F.col("t").alias("t_start"), F.array("category").alias("evidence"),
            (F.col("rule") + 5).alias("rule"), "rule_seq"),
    ]
    every = reduce(DataFrame.unionByName, parts)
    order = C.pick(F.col("severity"), {"CRITICAL": 0, "ERROR": 1, "WARNING": 2, "INFO": 3}, F.lit(9))
    return every.withColumns({"severity_rank": order, "t_sort": F.coalesce("t_start", F.lit(0.0))})


def ranked_findings(found: DataFrame, split: bool | None = None) -> DataFrame:
    return Ordered(found, KEY, FINDING_ORDER, split).add(position="finding_no").drop("severity_rank", "t_sort", "rule", "rule_seq")


def top_findings(found: DataFrame, n: int = 20) -> DataFrame:
    from aerolake.operators.stats import top_per_key
    return top_per_key(found, KEY, [F.col(c) for c in FINDING_ORDER], n, rank="finding_no")


def scorecard(logs: DataFrame, track: DataFrame, smooth: DataFrame, yaw: DataFrame, landed: DataFrame) -> DataFrame:
    """Category scores of each log, their mean and its grade."""
    t = track.groupBy(*KEY).agg(F.avg("score").alias("tracking_score"))
    s = smooth.groupBy(*KEY).agg(F.avg("score").alias("smoothness_score"))
    rows = null_safe_join(null_safe_join(logs, t, KEY, "left"), s, KEY, "left")
    rows = null_safe_join(rows, yaw.select(*KEY, "yaw_score"), KEY, "left")
    rows = null_safe_join(rows, landed.select(*KEY, "landing_score", "landing_class"), KEY, "left")
    overall = C.mean_of(*[F.col(c) for c in ("tracking_score", "smoothness_score", "yaw_score", "landing_score")])
    return rows.withColumn("pilot_score", overall).withColumn("pilot_grade", C.letter_grade(F.col("pilot_score")))


def category_list() -> Column:
    def one(name: str, score: str, detail: Column) -> Column:
        return F.when(F.col(score).isNotNull(), F.struct(
            F.lit(name).alias("name"), F.col(score).alias("score"), C.letter_grade(F.col(score)).alias("grade"),
            detail.alias("detail")))
    return F.array_compact(F.array(
        one("Attitude tracking", "tracking_score", F.lit("demand vs response")),
        one("Control smoothness", "smoothness_score", F.lit("pilot input activity")),
        one("Yaw discipline", "yaw_score", F.lit("heading hold + restraint")),
        one("Landing quality", "landing_score", F.col("landing_class"))))


def quality(card: DataFrame, totals: DataFrame, oscillation: DataFrame, saturated: DataFrame,
            found: DataFrame) -> DataFrame:
    """Weighted verdict per log; any critical finding caps the score."""
    stable = oscillation.groupBy(*KEY).agg(F.min(
        F.when(~F.col("detected"), F.lit(100.0)).when(F.col("severity") == "CRITICAL", F.lit(40.0))
        .otherwise(F.lit(70.0))).alias("stability"))
    critical = found.groupBy(*KEY).agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("_crit"), F.count(F.lit(1)).alias("_found"))
    rows = card
    for part in (totals.select(*KEY, "armed_s", "flight_count"), stable,
                 saturated.select(*KEY, "saturation_score", "saturation_severity"), critical):
        rows = null_safe_join(rows, part, KEY, "left")
    crit = F.coalesce("_crit", F.lit(0))
    w = fixed.QUALITY_WEIGHTS
    pilot = F.col("pilot_score")
    total = (F.col("tracking_score") * w["tracking"] + F.col("stability") * w["stability"]
             + F.col("saturation_score") * w["saturation"] + F.coalesce(pilot * w["pilot"], F.lit(0.0)))
    weight = w["tracking"] + w["stability"] + w["saturation"] + F.when(pilot.isNull(), 0.0).otherwise(w["pilot"])
    raw = total / weight
    no_data = (F.coalesce("armed_s", F.lit(0.0)) <= 0) | F.col("tracking_score").isNull()
    score = F.when(~no_data, F.when(crit > 0, F.least(raw, F.lit(fixed.CRITICAL_CAP))).otherwise(raw))
    rows = rows.withColumn("quality_score", score)
    headline = None
    for floor, _, line in fixed.QUALITY_BANDS:
        hit = F.col("quality_score") >= floor
        headline = F.when(hit, F.lit(line)) if headline is None else headline.when(hit, F.lit(line))
    verdict = F.coalesce(C.bands(F.col("quality_score"), fixed.QUALITY_BANDS, fixed.QUALITY_WORST[0]), F.lit(fixed.QUALITY_NO_DATA[0]))
    factors = F.array_compact(F.array(
        F.concat(F.lit("tracking "), C.fixed_text(F.col("tracking_score"), 0)),
        F.when(F.col("stability") < 100, F.lit("oscillation detected")),
        F.when(F.col("saturation_severity") != "OK", F.lit("saturation")),
        F.when(crit > 0, F.concat(crit.cast("string"), F.lit(" critical finding(s)")))))
    return rows.select(
        *card.columns, F.coalesce("armed_s", F.lit(0.0)).alias("armed_s"),
        F.coalesce("flight_count", F.lit(0)).alias("flight_count"), "stability", "saturation_score",
        "saturation_severity", crit.alias("critical_findings"), F.coalesce("_found", F.lit(0)).alias("finding_count"),
        "quality_score", verdict.alias("verdict"),
        F.when(F.col("quality_score").isNull(), F.lit(fixed.QUALITY_NO_DATA[1]))
        .otherwise(headline.otherwise(F.lit(fixed.QUALITY_WORST[1]))).alias("headline"),
        F.when(F.col("quality_score").isNull(), F.array().cast("array<string>")).otherwise(factors).alias("factors"))


class FlightAnalytics:
    """The report's parts as lazily built DataFrames over one telemetry table.

    One action at the start measures whether some log needs the split plans. ``share``
    writes the part tables to the checkpoint folder, because the later parts read them several times
    and their plans would otherwise be repeated inside each other: the armed attitude errors and
    sticks, and tables of a few rows per log.
    """

    def __init__(self, telemetry: DataFrame, split: bool | None = None, share: bool = True):
        keep = cut if share else (lambda frame: frame)
        self.telemetry = telemetry
        sizes = keep(message_sizes(telemetry))
        self.split = (sizes.agg(F.max("n")).first()[0] or 0) > rows_per_task(telemetry.sparkSession) if split is None else split
        self.span = keep(sizes.groupBy(*KEY).agg(F.min("t_first").alias("t_first"), F.max("t_last").alias("t_last")).where(F.col("t_first").isNotNull()))
        self.logs = self.span.select(*KEY)
        self.windows = keep(armed_windows(telemetry, self.span, self.split))
        self.few = few_windows(self.windows, KEY)
        self.totals = keep(armed_totals(self.windows))
        self.errors = keep(attitude_errors(telemetry, self.windows, self.split, few=self.few))
        self.sticks = keep(stick_series(telemetry, self.windows, self.split, few=self.few, logs=self.logs))
        self.tracking = keep(tracking(self.errors))
        self.smoothness = keep(smoothness(self.sticks, self.totals, self.split))
        self.yaw = keep(yaw_discipline(self.errors, self.sticks, self.logs))
        self.landing = keep(landing(telemetry, self.windows, self.totals, self.split, few=self.few))
        self.oscillations = keep(oscillations(self.errors, self.logs))
        self.saturation = keep(saturation(telemetry, self.windows, self.logs, self.split, few=self.few))
        self.anomalies = keep(anomalies(telemetry, self.span))
        self.findings = keep(findings(self.oscillations, self.tracking, self.saturation, self.landing,
                                      self.yaw, self.anomalies))
        self.scorecard = keep(scorecard(self.logs, self.tracking, self.smoothness, self.yaw, self.landing))
        self.quality = quality(self.scorecard, self.totals, self.oscillations, self.saturation, self.findings)

    def report(self) -> DataFrame:
        """One row per log. Findings stay a table of their own: a log may have any number."""
        def by_axis(frame: DataFrame, name: str, *columns: str) -> DataFrame:
            rank = C.pick(F.col("axis"), {a: i for i, a in enumerate(fixed.ATTITUDE_COLUMNS)})
            entry = F.struct(rank.alias("_i"), "axis", *columns)
            packed = F.transform(F.array_sort(F.collect_list(entry)), lambda s: s.dropFields("_i"))
            return frame.groupBy(*KEY).agg(packed.alias(name))

        rows = self.quality.withColumn("categories", category_list())
        parts = [
            by_axis(self.tracking, "tracking", "rms_deg", "max_deg", "pct_in_tol", "score"),
            by_axis(self.smoothness, "smoothness", "activity", "reversals_per_s", "score"),
            by_axis(self.oscillations, "oscillations", "detected", "freq_hz", "amplitude_deg", "severity"),
            self.yaw.drop("yaw_score"), self.landing.drop("landing_class", "landing_score"),
            self.saturation.drop("saturation_severity", "saturation_score"),
        ]
        for part in parts:
            rows = null_safe_join(rows, part, KEY, "left")
        return rows
