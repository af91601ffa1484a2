"""Firmware, frame, estimator and GPS health, parameters, and the anomaly rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import columns as C
from aerolake.functions import fixed
from aerolake.operators.ordered import null_safe_join
from aerolake.schema import KEY, any_number, has_number, number, plain, records, text

FIRMWARE_WORDS = ("ArduCopter", "ArduPlane", "ArduRover")
VEHICLE_WORDS = ("ArduCopter", "ArduPlane", "ArduRover", "ArduSub", "ArduBlimp")
INSTANCES_4 = (None, 0, 1, 2, 3)


def parameters(telemetry: DataFrame) -> DataFrame:
    """(log_id, name, value): the last readable value of every parameter."""
    name = text("Name", "name")
    value = F.coalesce(number("Value", "value"), text("Value", "value").try_cast("double"))
    rows = plain(telemetry, "PARM").select(*KEY, "seq", name.alias("name"), value.alias("value"))
    usable = rows.where(F.col("name").isNotNull() & F.col("value").isNotNull())
    return usable.groupBy(*KEY, "name").agg(F.max_by("value", "seq").alias("value"))


def _contains_any(column: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [column.contains(w) for w in words])


def firmware_and_frame(telemetry: DataFrame) -> DataFrame:
    """Firmware text, build and frame, from messages or else from the version record."""
    rows = telemetry.where(F.col("msg").isin("MSG", "VER") & F.col("instance").isNull())
    is_msg = F.col("msg") == "MSG"
    body, alt = text("Message"), text("Msg")
    version = F.min_by(text("FWS"), F.when(F.col("msg") == "VER", F.col("seq")))

    def first_with(column: Column, condition: Column) -> Column:
        return F.min_by(column, F.when(is_msg & condition, F.col("seq")))

    found = rows.groupBy(*KEY).agg(
        first_with(body, _contains_any(body, FIRMWARE_WORDS)).alias("_fw"),
        first_with(alt, _contains_any(alt, FIRMWARE_WORDS)).alias("_fw2"),
        first_with(body, body.contains("Frame:")).alias("_fr"),
        first_with(alt, alt.contains("Frame:")).alias("_fr2"), version.alias("_ver"))
    full = F.coalesce(F.col("_fw2"), F.col("_fw"), F.trim("_ver"), F.lit(""))
    named = F.trim(F.regexp_replace(F.coalesce("_fr2", "_fr"), "Frame:", ""))
    kind = None
    for word in VEHICLE_WORDS:
        hit = F.col("_ver").contains(word)
        kind = F.when(hit, F.lit(word)) if kind is None else kind.when(hit, F.lit(word))
    frame = F.coalesce(F.when(named != "", named), kind, F.lit("UNKNOWN"))
    name = C.firmware_name(full)
    return found.select(
        *KEY, F.when(name != "", name).otherwise(F.lit("UNKNOWN")).alias("firmware"),
        C.firmware_build(full).alias("build"), frame.alias("frame"))


def estimator_health(telemetry: DataFrame) -> DataFrame:
    rows = records(telemetry, "XKF4").where(any_number("FS", "fs"))
    worst = rows.groupBy(*KEY).agg(F.max(number("FS", "fs").cast("bigint")).alias("_m"))
    logs = telemetry.select(*KEY).distinct()
    joined = null_safe_join(logs, worst, KEY, "left")
    status = (F.when(F.col("_m").isNull(), F.lit("NO DATA")).when(F.col("_m") > 0, F.lit("WARN"))
              .otherwise(F.lit("OK")))
    detail = (F.when(F.col("_m").isNull(), F.lit(""))
              .when(F.col("_m") > 0, F.concat(F.lit("Filter status > 0 (max="), F.col("_m").cast("string"), F.lit(")")))
              .otherwise(F.lit("All FS = 0")))
    return joined.select(*KEY, status.alias("ekf_status"), detail.alias("ekf_detail"))


def _instance_rank(instances) -> Column:
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(instances))):
        same = F.col("instance").isNull() if instances[i] is None else (F.col("instance") == instances[i])
        rank = F.when(F.coalesce(same, F.lit(False)), F.lit(i)).otherwise(rank)
    return rank


def first_instance(telemetry: DataFrame, msg: str, instances=INSTANCES_4) -> DataFrame:
    """Records of the first instance of a message each log has."""
    rows = records(telemetry, msg).withColumn("_rank", _instance_rank(instances)).where(F.col("_rank").isNotNull())
    best = rows.groupBy(*KEY).agg(F.min("_rank").alias("_rank"))
    return null_safe_join(rows, best, [*KEY, "_rank"], "left_semi").drop("_rank")


def gps_health(telemetry: DataFrame) -> DataFrame:
    """Last GPS reading of the first instance; simulated logs without GPS count as fine."""
    last = first_instance(telemetry, "GPS").groupBy(*KEY).agg(F.max_by(F.struct(
        number("Status", "status", "GStatus").cast("bigint").alias("status"),
        number("NSats", "NSat", "Sats").cast("bigint").alias("sats"),
        number("HDop", "Hdop", "hdop").alias("hdop")), "seq").alias("_g"))
    logs = telemetry.groupBy(*KEY).agg(
        F.max(F.col("msg").isin("SIM2", "SIM") & F.col("instance").isNull()).alias("_sim"))
    joined = null_safe_join(logs, last, KEY, "left")
    missing, sim = F.col("_g").isNull(), F.col("_sim")
    status = F.coalesce(F.col("_g.status"), F.lit(0))
    return joined.select(
        *KEY,
        F.when(missing & sim, F.lit("SITL")).when(missing, F.lit("NO DATA"))
        .otherwise(C.gps_fix_name(status)).alias("gps_fix"),
        F.coalesce("_g.sats", F.lit(0)).alias("gps_sats"),
        F.coalesce("_g.hdop", F.lit(0.0)).alias("gps_hdop"),
        (missing & sim).alias("is_sitl"),
        F.when(missing & sim, F.lit("OK")).when(missing, F.lit("NO DATA"))
        .when(status >= 3, F.lit("OK")).otherwise(F.lit("WARN")).alias("gps_status"))


def health(telemetry: DataFrame) -> DataFrame:
    rows = null_safe_join(estimator_health(telemetry), gps_health(telemetry), KEY, "left")
    rows = null_safe_join(rows, firmware_and_frame(telemetry), KEY, "left")
    return rows.withColumns({
        "firmware": F.coalesce("firmware", F.lit("UNKNOWN")), "build": F.coalesce("build", F.lit("")),
        "frame": F.coalesce("frame", F.lit("UNKNOWN"))})


# -- anomalies ---------------------------------------------------------------------------------

def _first_hit(rows: DataFrame, by: list[str], condition: Column, value: Column, pick: str) -> DataFrame:
    """Per group: time of the first row that meets the condition and the extreme value among them."""
    hits = rows.where(condition)
    best = {"first": F.min_by(value, "seq"), "max": F.max(value), "min": F.min(value)}[pick]
    return hits.groupBy(*by).agg(F.min_by("t", "seq").alias("t"), best.alias("value"))


def _anomaly(rows: DataFrame, severity: str, category: str, rule: int, message: Column, order: Column | None = None) -> DataFrame:
    return rows.select(*KEY, "t", F.lit(severity).alias("severity"), F.lit(category).alias("category"),
                       message.alias("message"), F.lit(rule).alias("rule"),
                       (order if order is not None else F.lit(0)).cast("bigint").alias("rule_seq"))


def anomalies(telemetry: DataFrame, span: DataFrame | None = None, all_batteries: bool = False) -> DataFrame:
    """Rule hits (log_id, t, t_rel, severity, category, message); order (t, rule, rule_seq).

    Every rule is a filter and a partial aggregate, so hot logs are reduced before the shuffle.
    """
    timed = telemetry.where(F.col("t").isNotNull())
    # Estimator faults: the first one of every instance.
    ekf_rank = _instance_rank(INSTANCES_4)
    ekf_rows = records(timed, "XKF4").where(any_number("FS", "fs")).withColumn("_rank", ekf_rank)
    ekf = _first_hit(ekf_rows.where(F.col("_rank").isNotNull()), [*KEY, "_rank"],
                     number("FS", "fs") > 0, number("FS", "fs"), "first")
    found = [_anomaly(ekf, "ERROR", "EKF", 0, F.concat(
        F.lit("EKF filter fault FS="), F.col("value").cast("bigint").cast("string")), F.col("_rank"))]
    # GPS quality and vibration: the first instance only.
    gps = first_instance(timed, "GPS")
    dop, sats = number("HDop", "Hdop", "hdop"), number("NSats", "NSat")
    found.append(_anomaly(_first_hit(gps, KEY, dop > 2.5, dop, "max"), "WARNING", "GPS", 1,
                          F.concat(F.lit("Poor GPS HDOP="), C.fixed_text(F.col("value"), 2))))
    found.append(_anomaly(_first_hit(gps, KEY, sats < 6, sats, "min"), "WARNING", "GPS", 2,
                          F.concat(F.lit("Low GPS sats="), F.col("value").cast("bigint").cast("string"))))
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("axis"), number(a).alias("v"))
                               for i, a in enumerate(("VibeX", "VibeY", "VibeZ"))]))
    vibe = first_instance(timed, "VIBE").select(*KEY, "seq", "t", axes.alias("_a")).select(*KEY, "seq", "t", "_a.*")
    shaken = _first_hit(vibe, [*KEY, "i", "axis"], F.col("v") > 30.0, F.col("v"), "max")
    found.append(_anomaly(shaken, "WARNING", "VIBE", 3, F.concat(
        F.lit("High vibration "), F.col("axis"), F.lit(" "), C.fixed_text(F.col("value"), 1), F.lit(" m/s²")), F.col("i")))
    # Battery: below 85 % of the log's own maximum, if that is a real voltage.
    battery = records(timed, "BAT") if all_batteries else plain(timed, "BAT")
    battery = battery.select(*KEY, "instance", "seq", "t", number("Volt", "VoltR").alias("v"))
    peak = battery.groupBy(*KEY, "instance").agg(F.max("v").alias("_vmax")).where(F.col("_vmax") > 4.0)
    with_peak = null_safe_join(battery, peak, [*KEY, "instance"], "inner")
    low = _first_hit(with_peak, [*KEY, "instance"], F.col("v") < F.col("_vmax") * 0.85, F.col("v"), "min")
    found.append(_anomaly(low, "WARNING", "POWER", 4, F.concat(
        F.lit("Low battery "), C.fixed_text(F.col("value"), 1), F.lit(" V")), F.coalesce("instance", F.lit(-1))))
    # Every subsystem error.
    def code(*names: str) -> Column:
        return F.when(any_number(*names), number(*names).cast("bigint").cast("string")).otherwise(F.lit("?"))
    errors = plain(timed, "ERR")
    found.append(_anomaly(errors, "ERROR", "ERR", 5, F.concat(
        F.lit("Subsys="), code("Subsys", "SubSys", "Sub"), F.lit(" ECode="), code("ECode", "ecode", "Ecode")), F.col("seq")))

    hits = reduce(DataFrame.unionByName, found)
    span = timed.groupBy(*KEY).agg(F.min("t").alias("t_first")) if span is None else span
    joined = null_safe_join(hits, span.select(*KEY, "t_first"), KEY, "left")
    return joined.withColumn("t_rel", F.col("t") - F.col("t_first")).drop("t_first")
