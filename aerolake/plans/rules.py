"""Rules as a table: limits on readings that are data, joined to telemetry and judged by one plan.

A rule names a message, a reading by the spellings of its column, a comparison with a limit, which instances it is
for, which of the readings that meet it is told, and how. Rules may come from any source with the columns of
``RULES``; another rule is another row, and nothing is generated per rule. Telemetry is read once: each record meets
the rules of its message (a broadcast of at most ``MAX_BROADCAST`` rows, beyond that a join by message), and one
partial aggregate per log, rule and instance is all that is shuffled. Limits that are a share of the log's own
greatest reading take that from one aggregate more.

Defined results: a record without a time, and a reading that is NULL or absent, meets no rule, but for comparison
``any``, which every record of the message meets; a rule with NULL in message, comparison or pick meets nothing; of
readings at one place the one of the smallest seq is the first; an empty table of rules or telemetry gives no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import columns as C
from aerolake.operators.ordered import null_safe_join
from aerolake.plans.health import INSTANCES_4, _instance_rank
from aerolake.schema import KEY

#: ``scope``: first (the first instance a log has), ranked (known instances apart), each (all instances apart), plain
#: (records without an instance). ``compare``: gt, ge, lt, le, any. ``share``: ``bound`` is a share of the greatest reading,
#: if that is above ``least``. ``pick``: the value told, first, max or min, or ``every`` for a hit per record.
#: ``digits`` NULL: a whole number. ``more``: further readings of the record, for ``every``. ``place`` orders hits of one rule.
RULES = ("rule int, place int, msg string, columns array<string>, scope string, compare string, bound double, share boolean, least double, pick string, "
         "severity string, category string, before string, digits int, after string, more array<struct<before:string,columns:array<string>>>")
MAX_BROADCAST = 10_000
MAX_DIGITS = 6


def standard_rules(spark: SparkSession) -> DataFrame:
    """The rules of ``health.anomalies``."""
    def rule(number, place, msg, columns, scope, compare, bound, pick, severity, category, before, digits=None, after="", share=False, least=None, more=()):
        return (number, place, msg, columns, scope, compare, bound, share, least, pick, severity, category, before, digits, after, list(more))

    shaken = [rule(3, i, "VIBE", [axis], "first", "gt", 30.0, "max", "WARNING", "VIBE", f"High vibration {axis} ", 1, " m/s²") for i, axis in enumerate(("VibeX", "VibeY", "VibeZ"))]
    return spark.createDataFrame([
        rule(0, 0, "XKF4", ["FS", "fs"], "ranked", "gt", 0.0, "first", "ERROR", "EKF", "EKF filter fault FS="),
        rule(1, 0, "GPS", ["HDop", "Hdop", "hdop"], "first", "gt", 2.5, "max", "WARNING", "GPS", "Poor GPS HDOP=", 2),
        rule(2, 0, "GPS", ["NSats", "NSat"], "first", "lt", 6.0, "min", "WARNING", "GPS", "Low GPS sats="),
        *shaken,
        rule(4, -1, "BAT", ["Volt", "VoltR"], "plain", "lt", 0.85, "min", "WARNING", "POWER", "Low battery ", 1, " V", share=True, least=4.0),
        rule(5, 0, "ERR", ["Subsys", "SubSys", "Sub"], "plain", "any", None, "every", "ERROR", "ERR", "Subsys=", more=[(" ECode=", ["ECode", "ecode", "Ecode"])]),
    ], RULES)


def _spelling(columns: Column) -> Column:
    """The first of the spellings that the record has; NULL if none."""
    def known(kind: str, c: Column) -> Column:
        return F.coalesce(F.map_contains_key(kind, c), F.lit(False))

    return F.get(F.filter(columns, lambda c: known("reals", c) | known("ints", c)), F.lit(0))


def _reading(name: Column) -> Column:
    return F.coalesce(F.col("reals")[name], F.col("ints")[name].cast("double"))


def _whole(columns: Column) -> Column:
    """The reading as a whole number, a question mark if the record has none."""
    name = _spelling(columns)
    return F.when(name.isNull(), F.lit("?")).otherwise(_reading(name).cast("bigint").cast("string"))


def _meets(value: Column, bound: Column) -> Column:
    compare = F.col("compare")
    tests = {"gt": value > bound, "ge": value >= bound, "lt": value < bound, "le": value <= bound, "any": F.lit(True)}
    return F.coalesce(reduce(lambda rest, name: F.when(compare == name, tests[name]).otherwise(rest), tests, F.lit(False)), F.lit(False))


def _told(value: Column) -> Column:
    text = value.cast("bigint").cast("string")
    for digits in range(MAX_DIGITS + 1):
        text = F.when(F.col("digits") == digits, C.fixed_text(value, digits)).otherwise(text)
    return text


def readings(telemetry: DataFrame, rules: DataFrame) -> DataFrame:
    """A row per record and rule of its message: the rule's columns, the reading and the group it is judged in."""
    few = rules.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    facts = rules.select(F.struct(*rules.columns).alias("r"), F.col("msg").alias("_msg")).where("_msg IS NOT NULL")
    timed = telemetry.where(F.col("t").isNotNull())
    met = timed.join(F.broadcast(facts) if few else facts, F.col("msg") == F.col("_msg"))
    met = met.select(*KEY, "instance", "seq", "t", "ints", "reals", "r.*").withColumn("_rank", _instance_rank(INSTANCES_4))
    group = F.when(F.col("scope").isin("first", "ranked"), F.col("_rank")).when(F.col("scope") == "each", F.coalesce("instance", F.lit(-1))).otherwise(F.lit(0))
    taken = (F.when(F.col("scope").isin("first", "ranked"), F.col("_rank").isNotNull()).when(F.col("scope") == "each", F.lit(True))
             .when(F.col("scope") == "plain", F.col("instance").isNull()).otherwise(F.lit(False)))
    more = F.array_join(F.transform("more", lambda m: F.concat(m["before"], _whole(m["columns"]))), "")
    every = F.when(F.col("pick") == "every", F.concat("before", _whole(F.col("columns")), F.coalesce(more, F.lit("")), F.coalesce("after", F.lit(""))))
    return met.where(taken).withColumns({"value": _reading(_spelling(F.col("columns"))), "grp": group, "line": every})


def rule_hits(telemetry: DataFrame, rules: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """(log_id, t, severity, category, message, rule, rule_seq, t_rel) of all hits; order (t, rule, rule_seq)."""
    rows = readings(telemetry, rules)
    keys = [*KEY, "rule", "place", "grp"]
    shared = F.coalesce("share", F.lit(False))
    fixed = rows.where(~shared).withColumn("limit", F.col("bound"))
    relative = rows.where(shared)
    peaks = relative.groupBy(*keys).agg(F.max("value").alias("_peak"))
    relative = null_safe_join(relative, peaks, keys, "inner").where(F.col("_peak") > F.coalesce("least", F.lit(float("-inf")))).withColumn("limit", F.col("_peak") * F.col("bound")).drop("_peak")
    judged = fixed.unionByName(relative).withColumn("hit", _meets(F.col("value"), F.col("limit")))

    out = ["t", "severity", "category", "message", "rule", "rule_seq"]
    single = judged.where(F.col("hit") & (F.col("pick") == "every")).select(*KEY, "t", "severity", "category", F.col("line").alias("message"), "rule", F.col("seq").alias("rule_seq"))

    texts = ["scope", "pick", "severity", "category", "before", "digits", "after"]
    at = F.when(F.col("hit"), F.col("seq"))
    told = F.when(F.col("hit"), F.col("value"))
    groups = judged.where(F.col("pick") != "every").groupBy(*keys, *texts).agg(
        F.count(at).alias("hits"), F.min_by("t", at).alias("t"), F.min_by("value", at).alias("_first"), F.max(told).alias("_max"), F.min(told).alias("_min"))
    # The first instance is the first that the log has, whether it meets the rule or not.
    least = groups.where("scope = 'first'").groupBy(*KEY, "rule", "place").agg(F.min("grp").alias("grp"))
    first = null_safe_join(groups.where("scope = 'first'"), least, keys, "left_semi")
    found = groups.where("scope <> 'first'").unionByName(first).where("hits > 0")
    value = F.when(F.col("pick") == "first", F.col("_first")).when(F.col("pick") == "max", F.col("_max")).when(F.col("pick") == "min", F.col("_min"))
    order = F.when(F.col("scope").isin("ranked", "each"), F.col("grp")).otherwise(F.col("place"))
    found = found.select(*KEY, "t", "severity", "category", F.concat("before", _told(value), F.coalesce("after", F.lit(""))).alias("message"), "rule", order.cast("bigint").alias("rule_seq"))

    hits = found.select(*KEY, *out).unionByName(single.select(*KEY, *out))
    span = telemetry.where("t IS NOT NULL").groupBy(*KEY).agg(F.min("t").alias("t_first")) if span is None else span
    return null_safe_join(hits, span.select(*KEY, "t_first"), KEY, "left").withColumn("t_rel", F.col("t") - F.col("t_first")).drop("t_first")
