"""The signal catalogue, its search, presets, and the signals behind a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import columns as C
from aerolake.functions import fixed
from aerolake.operators.intervals import pairs_in_windows, within_windows
from aerolake.operators.ordered import null_safe_join
from aerolake.operators.setops import minus_keys
from aerolake.schema import KEY


def message_columns(telemetry: DataFrame) -> DataFrame:
    """Distinct numeric columns of each log's messages; duplicates fall away before the shuffle."""
    empty = F.array().cast("array<string>")
    names = F.array_union(F.coalesce(F.map_keys("reals"), empty), F.coalesce(F.map_keys("ints"), empty))
    sets = telemetry.select(*KEY, "msg", "instance", names.alias("_names")).distinct()
    return sets.select(*KEY, "msg", "instance", F.explode("_names").alias("col")).distinct()


def signal_catalog(telemetry: DataFrame) -> DataFrame:
    rows = message_columns(telemetry).where(~F.col("col").isin("TimeUS", "TimeS"))
    return rows.select(
        *KEY, C.message_group(F.col("msg")).alias("group"), "msg", "instance",
        C.signal_key(F.col("msg"), F.col("instance")).alias("key"), "col", C.unit_of(F.col("col")).alias("unit"))


def search_signals(catalog: DataFrame, needle: str) -> DataFrame:
    label = F.lower(F.concat("key", F.lit("."), "col"))
    return catalog.where(label.contains(needle.strip().lower()))


def preset_table(spark) -> DataFrame:
    rows = [(name, i, msg, col) for name, pairs in fixed.PLOT_PRESETS.items() for i, (msg, col) in enumerate(pairs)]
    return spark.createDataFrame(rows, "preset string, pos int, msg string, col string")


def ungrouped_messages(telemetry: DataFrame) -> DataFrame:
    """Messages of each log that belong to no named group."""
    names = [(m,) for members in fixed.MESSAGE_GROUPS.values() for m in members]
    grouped = telemetry.sparkSession.createDataFrame(names, "msg string")
    return minus_keys(telemetry.select(*KEY, "msg").distinct(), grouped, ["msg"])


def resolve_signals(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Attach to (log_id, msg, col) the record source that has it: the plain message or else its
    first instance. Instances compare as text, as their keys do."""
    keys = catalog.select(*KEY, "msg", "instance", "col")
    rank = F.when(F.col("instance").isNull(), F.lit("")).otherwise(C.signal_key(F.col("msg"), F.col("instance")))
    chosen = keys.groupBy(*KEY, "msg").agg(F.min(F.struct(rank.alias("r"), "instance")).alias("_s"))
    chosen = chosen.select(*KEY, "msg", F.col("_s.instance").alias("instance"))
    available = null_safe_join(keys, chosen, [*KEY, "msg", "instance"], "left_semi")
    return null_safe_join(wanted, available, [*KEY, "msg", "col"], "inner")


def finding_signals(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """(log_id, finding_no, msg, col, instance) of the plottable evidence of every finding.

    Evidence of the form ``MSG.col`` names its signals; without any, the category's list is used.
    """
    pattern = r"^([A-Za-z0-9]+)\.([A-Za-z0-9_]+)$"
    named = F.filter("evidence", lambda e: e.rlike(pattern))
    pairs = F.transform(named, lambda e: F.struct(
        F.regexp_extract(e, pattern, 1).alias("msg"), F.regexp_extract(e, pattern, 2).alias("col")))
    fallback: Column = F.array().cast("array<struct<msg:string,col:string>>")
    for category, signals in fixed.CATEGORY_SIGNALS.items():
        listed = F.array(*[F.struct(F.lit(m).alias("msg"), F.lit(c).alias("col")) for m, c in signals])
        fallback = F.when(F.col("category") == category, listed).otherwise(fallback)
    chosen = F.when(F.size(named) > 0, pairs).otherwise(fallback)
    wanted = findings.select(*KEY, "finding_no", F.explode(chosen).alias("_p")).select(*KEY, "finding_no", "_p.msg", "_p.col")
    return resolve_signals(catalog, wanted)


def finding_preset(category: Column) -> Column:
    return C.pick(category, fixed.CATEGORY_PRESET)


def signal_spans(telemetry: DataFrame, signals: DataFrame) -> DataFrame:
    """(log_id, finding_no, t_first, t_last): times of the records that hold the signals of a finding."""
    source = [*KEY, "msg", "instance"]
    spans = telemetry.where(F.col("t").isNotNull()).groupBy(*source).agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    met = null_safe_join(signals.select(*source, "finding_no").distinct(), spans, source, "inner")
    return met.groupBy(*KEY, "finding_no").agg(F.min("t_first").alias("t_first"), F.max("t_last").alias("t_last"))


def evidence_windows(findings: DataFrame, spans: DataFrame, around: float = 6.0) -> DataFrame:
    """Plot window of each finding: its time plus and minus ``around``, else the span of its own signals
    (``signal_spans``), else the first second of the log."""
    on = [*KEY, "finding_no"]
    rows = null_safe_join(findings, spans.select(*on, "t_first", "t_last"), on, "left")
    timed = F.col("t_start").isNotNull()
    start = F.when(timed, F.col("t_start") - around).otherwise(F.coalesce("t_first", F.lit(0.0)))
    end = F.when(timed, F.col("t_start") + around).otherwise(F.coalesce("t_last", F.lit(1.0)))
    rows = rows.withColumns({"w_start": start, "w_end": end})
    return rows.withColumn("w_end", F.when(F.col("w_end") <= F.col("w_start"), F.col("w_start") + 1.0)
                           .otherwise(F.col("w_end"))).drop("t_first", "t_last")


def evidence_readings(telemetry: DataFrame, signals: DataFrame, windows: DataFrame) -> DataFrame:
    """(log_id, finding_no, msg, instance, col, seq, t, value): what is plotted for every finding.

    ``signals`` comes from ``finding_signals``, ``windows`` from ``evidence_windows``. Findings may stand seconds apart, so
    their windows overlap; a reading is told once for each of them. Records meet windows before they are taken apart
    into readings, and only the columns of the finding are taken out of them. Readings that are NULL are left out.
    """
    source = [*KEY, "msg", "instance"]
    wanted = signals.groupBy(*source, "finding_no").agg(F.collect_set("col").alias("_cols"))
    asked = null_safe_join(wanted, windows.select(*KEY, "finding_no", "w_start", "w_end"), [*KEY, "finding_no"], "inner")
    records = telemetry.select(*source, "seq", "t", "ints", "reals")
    met = pairs_in_windows(records, asked, source, "t", "w_start", "w_end")
    value = lambda c: F.coalesce(F.col("reals")[c], F.col("ints")[c].cast("double"))
    taken = F.filter(F.transform("_cols", lambda c: F.struct(c.alias("col"), value(c).alias("value"))), lambda r: r["value"].isNotNull())
    rows = met.select(*KEY, "finding_no", "msg", "instance", "seq", "t", F.explode(taken).alias("_r"))
    return rows.select(*KEY, "finding_no", "msg", "instance", "_r.col", "seq", "t", "_r.value")


def visible_signals_table(signals: DataFrame, views: DataFrame, wanted: list[str]) -> DataFrame:
    """Signals side by side by position: row i has the i-th reading of every wanted signal.

    ``signals`` is (log_id, key, seq, t, value). The pivot has a fixed column list; shorter
    signals end in NULL.
    """
    from aerolake.operators.ordered import Ordered

    rows = signals.where(F.col("key").isin(*wanted))
    inside = within_windows(rows, views, KEY, "t", "view_start", "view_end")
    placed = Ordered(inside, [*KEY, "key"], ["t", "seq"]).add(position="row")
    columns = []
    for key in wanted:
        mine = F.col("key") == key
        columns += [F.max(F.when(mine, F.col("t"))).alias(f"{key}_t"), F.max(F.when(mine, F.col("value"))).alias(key)]
    return placed.groupBy(*KEY, "row").agg(*columns)


def message_keys(telemetry: DataFrame) -> DataFrame:
    """(log_id, keys): the names of a log's messages, with instance numbers, in order; a few dozen at most."""
    key = F.when(F.col("instance").isNull(), F.col("msg")).otherwise(F.concat("msg", F.lit("["), F.col("instance").cast("string"), F.lit("]")))
    return telemetry.groupBy(*KEY).agg(F.sort_array(F.collect_set(key)).alias("keys"))


def write_signals_csv(table: DataFrame, path: str, buckets: int = 256) -> None:
    """CSV files in a folder per bucket of logs, rows of a log in order; the log stays a column."""
    placed = table.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)))
    spread = placed.repartitionByRange("bucket", *KEY, "row").sortWithinPartitions("bucket", *KEY, "row")
    spread.write.mode("overwrite").partitionBy("bucket").option("header", True).csv(path)
