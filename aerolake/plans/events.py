"""The unified event table, its search, and review state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import columns as C
from aerolake.functions import fixed
from aerolake.operators.ordered import null_safe_join
from aerolake.schema import KEY, any_number, has_text, number, records, text

EVENT_MESSAGES = ("MSG", "EV", "ERR", "ARM", "MODE")
EVENT_ORDER = ["t", "source_rank", "seq"]


def flight_events(telemetry: DataFrame) -> DataFrame:
    """(log_id, seq, t, severity, type, message, source_rank) of all event records.

    Every record gives at most one event, so one pass with a CASE per message type replaces a
    union of five scans. The stable order within a log is (t, source_rank, seq).
    """
    msg = F.col("msg")
    whole = lambda value: value.cast("bigint").cast("string")
    body = text(*fixed.MESSAGE_TEXT)
    has_body = has_text("Message") | has_text("Msg")
    armed = number(*fixed.ARM_STATE).cast("bigint") == 1
    method = number(*fixed.ARM_METHOD)
    disarm = F.when(any_number(*fixed.ARM_METHOD), F.concat(
        F.lit("Disarmed (method="), whole(method), F.lit(")"))).otherwise(F.lit("Disarmed"))
    subsystem = C.subsystem_name(number(*fixed.ERROR_SUBSYSTEM))
    usable = (
        ((msg == "MSG") & has_body)
        | ((msg == "EV") & any_number(*fixed.EVENT_ID))
        | ((msg == "ERR") & any_number(*fixed.ERROR_SUBSYSTEM) & any_number(*fixed.ERROR_CODE))
        | ((msg == "ARM") & any_number(*fixed.ARM_STATE))
        | ((msg == "MODE") & any_number(*fixed.MODE_NUMBER))
    )
    severity = (
        F.when(msg == "MSG", C.keyword_severity(body)).when(msg == "ERR", F.lit("ERROR"))
        .when((msg == "ARM") & ~armed, F.lit("WARNING")).otherwise(F.lit("INFO"))
    )
    message = (
        F.when(msg == "MSG", body)
        .when(msg == "EV", C.event_name(number(*fixed.EVENT_ID)))
        .when(msg == "ERR", F.concat(F.lit("ERR: "), subsystem, F.lit(" code="),
                                     whole(number(*fixed.ERROR_CODE))))
        .when(msg == "ARM", F.when(armed, F.lit("Armed")).otherwise(disarm))
        .otherwise(F.concat(F.lit("Mode: "), C.mode_name(number(*fixed.MODE_NUMBER))))
    )
    rank = C.pick(msg, {m: i for i, m in enumerate(EVENT_MESSAGES)})
    rows = records(telemetry, *EVENT_MESSAGES).where(
        F.col("instance").isNull() & F.col("t").isNotNull() & usable)
    return rows.select(*KEY, "seq", "t", severity.alias("severity"), msg.alias("type"),
                       message.alias("message"), rank.alias("source_rank"))


def with_event_position(events: DataFrame) -> DataFrame:
    """Add one ascending number that stands for (source_rank, seq) as a tie breaker at one time."""
    return events.withColumn("ord", F.col("source_rank") * F.lit(1 << 48) + F.col("seq"))


def event_filter(severity: str | None = None, kind: str | None = None,
                 search: str | None = None) -> Column:
    """Condition of the event list: severity, type and a case-blind search in text or type."""
    keep = F.lit(True)
    if severity:
        keep = keep & (F.col("severity") == severity)
    if kind:
        keep = keep & (F.col("type") == kind)
    needle = (search or "").strip().lower()
    if needle:
        keep = keep & (F.lower("message").contains(needle) | F.lower("type").contains(needle))
    return keep


def event_search_counts(events: DataFrame, severity=None, kind=None, search=None) -> DataFrame:
    keep = event_filter(severity, kind, search)
    return events.groupBy(*KEY).agg(F.count_if(keep).alias("shown"), F.count(F.lit(1)).alias("total"))


def event_types(events: DataFrame) -> DataFrame:
    return events.select(*KEY, "type").distinct()


def with_review(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Events with their latest review; ``reviews`` is append-only (log_id, type, seq, at, status, notes)."""
    latest = reviews.groupBy("log_id", "type", "seq").agg(
        F.max_by(F.struct("status", "notes"), F.col("at")).alias("_r"))
    joined = null_safe_join(events, latest, ["log_id", "type", "seq"], "left")
    return joined.withColumns({
        "status": F.coalesce("_r.status", F.lit("OPEN")),
        "notes": F.coalesce("_r.notes", F.lit("")),
    }).drop("_r")


def fault_summary(anomalies: DataFrame) -> DataFrame:
    """Counts of errors and warnings per log and the card text."""
    counts = anomalies.groupBy(*KEY).agg(
        F.count_if(F.col("severity").isin("ERROR", "CRITICAL")).alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"))

    def plural(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, F.lit("S")).otherwise(F.lit("")))

    card = (F.when(F.col("errors") > 0, plural(F.col("errors"), "ERROR"))
            .when(F.col("warnings") > 0, plural(F.col("warnings"), "WARNING"))
            .otherwise(F.lit("CLEAN")))
    return counts.withColumn("card", card)
