"""Structured Streaming over a landing zone: decode, alerts, rolling statistics, live arm regions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from aerolake.functions import fixed
from aerolake.schema import any_number, number
from aerolake.plans.timeline import arm_regions
from aerolake.sources.decode import decode_logs

#: Most files per message that one micro-batch adds to the lake.
FILES_PER_MESSAGE = 8


def arriving_logs(spark: SparkSession, path: str, glob: str = "*.BIN", files_per_batch: int = 64) -> DataFrame:
    """Stream of newly landed log files, a bounded number per micro-batch."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob)
             .option("maxFilesPerTrigger", files_per_batch).load(path))
    return files.select(F.col("path").alias("log_id"), "modificationTime", "length", "content")


def ingest(spark: SparkSession, path: str, lake: str, checkpoint: str, glob: str = "*.BIN"):
    """Decode whatever has landed and append it to the lake, then stop; exactly once per file."""
    rows = decode_logs(arriving_logs(spark, path, glob))
    # One message's rows of a micro-batch go to a few tasks, not to a file per task.
    rows = rows.repartition("msg", F.pmod(F.xxhash64("log_id"), F.lit(FILES_PER_MESSAGE)))
    return (rows.writeStream.format("parquet").option("path", lake).option("checkpointLocation", checkpoint)
            .partitionBy("msg").trigger(availableNow=True).start())


def event_time(telemetry: DataFrame, epoch: str = "1970-01-01") -> DataFrame:
    """Add ``at``: the record's time as a timestamp, counted from ``epoch``."""
    return telemetry.withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("bigint") + F.unix_micros(F.lit(epoch).cast("timestamp"))))


def live_alerts(telemetry: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """Threshold alerts per record; a rule fires once per log and minute while data stays in order."""
    msg = F.col("msg")
    rules = [
        ("EKF", "ERROR", (msg == "XKF4") & (number("FS", "fs") > 0)),
        ("GPS_HDOP", "WARNING", (msg == "GPS") & (number("HDop", "Hdop", "hdop") > 2.5)),
        ("GPS_SATS", "WARNING", (msg == "GPS") & (number("NSats", "NSat") < 6)),
        *[(f"VIBE_{a[-1]}", "WARNING", (msg == "VIBE") & (number(a) > 30.0)) for a in ("VibeX", "VibeY", "VibeZ")],
        ("ERR", "ERROR", msg == "ERR"),
    ]
    hits = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, hit in rules]))
    rows = telemetry.withWatermark("at", delay).select("log_id", "at", "t", F.explode(hits).alias("_h"))
    fired = rows.select("log_id", "at", "t", "_h.rule", "_h.severity", F.date_trunc("minute", "at").alias("minute"))
    return fired.dropDuplicatesWithinWatermark(["log_id", "rule", "minute"])


def rolling_stats(signal: DataFrame, by: list[str], value: str, width: str = "10 seconds", slide: str | None = None,
                  delay: str = "30 seconds") -> DataFrame:
    """Windowed minimum, maximum, mean, deviation and count; late rows within ``delay`` count."""
    frame = F.window("at", width, slide) if slide else F.window("at", width)
    v = F.col(value).cast("double")
    grouped = signal.withWatermark("at", delay).where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, frame.alias("w"))
    stats = grouped.agg(F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.stddev_pop(v).alias("v_std"), F.count(v).alias("n"))
    return stats.select(*by, F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "v_min", "v_max", "v_mean", "v_std", "n")


def _arm_tracker() -> StatefulProcessor:
    # Defined inside a function so that it travels to the workers by value.
    import pandas as pd

    class ArmTracker(StatefulProcessor):
        """State per log: the start of the open region, if any."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._open = handle.getValueState("open", "t_start double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            start = self._open.get()[0] if self._open.exists() else None
            closed = []
            for row in sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: (r.t, r.seq)):
                if row.armed and start is None:
                    start = row.t
                elif not row.armed and start is not None:
                    closed.append((key[0], start, row.t))
                    start = None
            if start is None:
                self._open.clear()
            else:
                self._open.update((float(start),))
            if closed:
                yield pd.DataFrame(closed, columns=["log_id", "t_start", "t_end"])

        def close(self) -> None:
            pass

    return ArmTracker()


def live_arm_regions(telemetry: DataFrame) -> DataFrame:
    """Armed regions, emitted as they close; only arming records reach the state store."""
    rows = telemetry.where((F.col("msg") == "ARM") & any_number(*fixed.ARM_STATE))
    rows = rows.select("log_id", "seq", "t", (number(*fixed.ARM_STATE).cast("bigint") == 1).alias("armed"))
    return rows.groupBy("log_id").transformWithStateInPandas(
        statefulProcessor=_arm_tracker(), outputStructType="log_id string, t_start double, t_end double",
        outputMode="Append", timeMode="None")


def remaining_windows(signal: DataFrame, emitted: DataFrame, by: list[str], value: str, width: str = "10 seconds",
                      slide: str | None = None) -> DataFrame:
    """The windows that were still open when a stream ended: a batch pass over what it read, after the last emitted end.

    A stream emits windows in the order of their ends, so what it kept back are those that end later.
    """
    last = emitted.agg(F.max("w_end")).first()[0]
    rows = signal if last is None else signal.where(F.col("at") >= F.lit(last) - F.expr(f"INTERVAL {width}"))
    frame = F.window("at", width, slide) if slide else F.window("at", width)
    v = F.col(value).cast("double")
    grouped = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, frame.alias("w"))
    stats = grouped.agg(F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.stddev_pop(v).alias("v_std"), F.count(v).alias("n"))
    stats = stats.select(*by, F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "v_min", "v_max", "v_mean", "v_std", "n")
    return stats if last is None else stats.where(F.col("w_end") > F.lit(last))


def remaining_regions(telemetry: DataFrame, span: DataFrame, emitted: DataFrame, split: bool | None = None) -> DataFrame:
    """The armed regions a stream has not closed, ended by their log's end, from a batch pass over what it read."""
    regions = arm_regions(telemetry, span, split).select("log_id", "t_start", "t_end")
    return regions.join(emitted.select("log_id", "t_start"), ["log_id", "t_start"], "left_anti")
