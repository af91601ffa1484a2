"""Evidence, geography, exports and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aerolake.operators.ordered import Ordered
from aerolake.plans import analytics, catalog, evidence, metrics
from aerolake.plans import health as H
from aerolake.plans import snapshot as S
from aerolake.plans.trajectory import best_trajectory
from aerolake.session import cut, shared_folder
from aerolake.sources import aviation, integrity
from aerolake.streaming import landing
from suite.fleet import EV, SPAN, events, lake, named, of_type, records_of, span, telemetry
from suite.flights import ANOMALIES, TRACK, TRACK_MESSAGES
from suite.logs import BASE, log_files
from suite.registry import query, table
from suite.reports import REPORT_MESSAGES

KEY = ["log_id"]


def _numbered_anomalies(spark, folder):
    found = H.anomalies(telemetry(spark, folder, "XKF4", "GPS", "VIBE", "BAT", "ERR"), span(spark, folder))
    ranked = Ordered(found, KEY, ["t", "rule", "rule_seq"]).add(position="finding_no")
    return ranked.select("log_id", "finding_no", "category", F.col("t").alias("t_start"), F.array("category").alias("evidence"))


EVIDENCE_MESSAGES = ("XKF4", "GPS", "VIBE", "BAT", "ERR")
EVIDENCE = """m AS (SELECT * FROM (VALUES ('EKF', 'XKF4', 'SV', 0), ('EKF', 'XKF4', 'SP', 0), ('EKF', 'XKF4', 'SH', 0), ('EKF', 'XKF4', 'SM', 0), ('GPS', 'GPS', 'NSats', 0), ('GPS', 'GPS', 'HDop', 0),
  ('VIBE', 'VIBE', 'VibeX', NULL), ('VIBE', 'VIBE', 'VibeY', NULL), ('VIBE', 'VIBE', 'VibeZ', NULL), ('POWER', 'BAT', 'Volt', NULL), ('POWER', 'BAT', 'Curr', NULL)) x(category, msg, col, inst))"""
READINGS = """rd AS (SELECT log_id, seq, t, x.msg, x.col, CASE x.col WHEN 'SV' THEN value % 1.5 WHEN 'SP' THEN k / 80.0::DOUBLE WHEN 'SH' THEN 0.3 WHEN 'SM' THEN value % 0.9::DOUBLE WHEN 'NSats' THEN k % 20 WHEN 'HDop' THEN value % 4
  WHEN 'VibeX' THEN value % 45 WHEN 'VibeY' THEN k / 2.5::DOUBLE WHEN 'VibeZ' THEN value % 20 WHEN 'Volt' THEN 10 + k / 30.0::DOUBLE ELSE value % 40 END AS value
  FROM ev JOIN (SELECT DISTINCT msg, col FROM m) x ON ev.event_type = CASE x.msg WHEN 'GPS' THEN 'click' ELSE 'error' END)"""


def _evidence(spark, folder, timed=True):
    """(telemetry, findings, their signals) of the anomalies; without their times if asked so."""
    found = cut(_numbered_anomalies(spark, folder))
    if not timed:
        found = found.withColumn("t_start", F.lit(None).cast("double"))
    rows = lake(spark, folder, *EVIDENCE_MESSAGES)
    return rows, found, cut(catalog.finding_signals(found, catalog.signal_catalog(rows)))


@query("evidence_windows", f"""WITH {ANOMALIES} SELECT h.log_id, h.category, h.t - 6.0 AS w_start, h.t + 6.0 AS w_end FROM hits h""")
def evidence_windows(spark, folder):
    rows, found, signals = _evidence(spark, folder)
    return catalog.evidence_windows(found, catalog.signal_spans(rows, signals)).select("log_id", "category", "w_start", "w_end")


@query("trend_windows", f"""WITH {ANOMALIES}, s AS (SELECT log_id, event_type, min(t) AS a, max(t) AS b FROM ev GROUP BY 1, 2)
SELECT h.log_id, h.category, CASE WHEN h.category = 'ERR' THEN 0.0 ELSE s.a END AS w_start, CASE WHEN h.category = 'ERR' THEN 1.0 WHEN s.b <= s.a THEN s.a + 1.0 ELSE s.b END AS w_end
FROM hits h JOIN s ON s.log_id = h.log_id AND s.event_type = CASE h.category WHEN 'GPS' THEN 'click' ELSE 'error' END""")
def trend_windows(spark, folder):
    """Windows of the same findings when they have no time: the span of what each finding's signals cover."""
    rows, found, signals = _evidence(spark, folder, timed=False)
    return catalog.evidence_windows(found, catalog.signal_spans(rows, signals)).select("log_id", "category", "w_start", "w_end")


@query("evidence_readings", f"""WITH {ANOMALIES}, {EVIDENCE}, {READINGS} SELECT h.log_id, h.category, h.t AS t_start, rd.msg, rd.col, rd.seq, rd.t, round(rd.value, 9) AS value
FROM hits h JOIN m ON m.category = h.category JOIN rd ON rd.log_id = h.log_id AND rd.msg = m.msg AND rd.col = m.col AND rd.t BETWEEN h.t - 6.0 AND h.t + 6.0""")
def evidence_readings(spark, folder):
    rows, found, signals = _evidence(spark, folder)
    windows = catalog.evidence_windows(found, catalog.signal_spans(rows, signals))
    readings = catalog.evidence_readings(rows, signals, windows)
    named = readings.join(found.select("log_id", "finding_no", "category", "t_start"), ["log_id", "finding_no"])
    return named.select("log_id", "category", "t_start", "msg", "col", "seq", "t", F.round("value", 9).alias("value"))


@query("finding_signals", f"""WITH {ANOMALIES}, {EVIDENCE}
SELECT h.log_id, h.category, m.msg, m.col, CAST(m.inst AS INTEGER) AS "instance", count(*) AS n FROM hits h JOIN m ON m.category = h.category GROUP BY ALL""")
def finding_signals(spark, folder):
    rows = telemetry(spark, folder, *EVIDENCE_MESSAGES)
    found = _numbered_anomalies(spark, folder)
    signals = catalog.finding_signals(found, catalog.signal_catalog(rows))
    return signals.join(found.select("log_id", "finding_no", "category"), ["log_id", "finding_no"]).groupBy(
        "log_id", "category", "msg", "col", "instance").agg(F.count(F.lit(1)).alias("n"))


def _near_home(spark, folder):
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        k.alias("row"), F.col("s_name").alias("ident"), F.col("s_name").alias("name"), (F.lit(-37) + (k * 53 % 400) / 100.0).alias("lat"),
        (F.lit(147) + (k * 77 % 400) / 100.0).alias("lon"))


@query("geo_facts", f"""WITH {TRACK}, air AS (SELECT s_suppkey AS rid, s_name AS ident, -37 + (s_suppkey * 53 % 400) / 100.0::DOUBLE AS lat, 147 + (s_suppkey * 77 % 400) / 100.0::DOUBLE AS lon FROM supplier),
h AS (SELECT log_id, any_value(lat0) AS lat, any_value(lng0) AS lon FROM track GROUP BY log_id),
d AS (SELECT h.log_id, a.ident, a.rid, sqrt((6378137.0 * cos(radians(h.lat)) * radians(a.lon - h.lon)) ** 2 + (6378137.0 * radians(a.lat - h.lat)) ** 2) AS m FROM h JOIN air a
  ON a.lat BETWEEN h.lat - 1 AND h.lat + 1 AND a.lon BETWEEN h.lon - 1 AND h.lon + 1),
n AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY m, rid) AS r FROM d)
SELECT h.log_id, round(h.lat, 7) AS lat, round(h.lon, 7) AS lon, n.ident, round(n.m, 2) AS airport_m, n.ident AS airport_ident, round(n.m, 2) AS runway_m FROM h LEFT JOIN n ON n.log_id = h.log_id AND n.r = 1""")
def geo_facts(spark, folder):
    found = _geography(spark, folder)
    return found.select("log_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "ident", F.round("airport_m", 2).alias("airport_m"),
                        "airport_ident", F.round("runway_m", 2).alias("runway_m"))


def _geography(spark, folder):
    places = _near_home(spark, folder)
    strips = places.select(F.col("ident").alias("airport_ident"), F.lit("10/28").alias("designator"), F.col("lat").alias("le_lat"), F.col("lon").alias("le_lon"),
                           F.col("lat").alias("he_lat"), F.col("lon").alias("he_lon"), "row")
    return aviation.geo_facts(cut(best_trajectory(lake(spark, folder, *TRACK_MESSAGES))), places, strips)


@query("snapshot_store", f"""WITH {EV}, s AS (SELECT log_id, seq AS cursor, 1 AS n_at, FALSE AS deleted, 'OPEN' AS status FROM ev WHERE event_type = 'error'
  UNION ALL SELECT log_id, seq, 2, k % 5 = 0, 'REVIEWED' FROM ev WHERE event_type = 'error' AND k % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY log_id, cursor ORDER BY n_at DESC) AS r FROM s)
SELECT log_id, cursor, status FROM n WHERE r = 1 AND NOT deleted""")
def snapshot_store(spark, folder):
    rows = of_type(events(spark, folder), "error").select("log_id", F.col("seq").alias("cursor"), "k")
    added = rows.withColumns({"at": F.lit(1), "deleted": F.lit(False), "status": F.lit("OPEN")})
    changed = rows.where("k % 2 = 0").withColumns({"at": F.lit(2), "deleted": F.col("k") % 5 == 0, "status": F.lit("REVIEWED")})
    return S.latest_snapshots(added.unionByName(changed).drop("k"))


#: From the state that weighs most; a flight whose files differ has the worst of their states.
STATES = ("INVALID", "CORRUPTED", "WRONG_KEY", "PARTIAL", "UNSIGNED", "UNKNOWN", "VERIFIED")


def _verified(spark, folder):
    """(log_id, state, basis, device_id) of every flight; a user's events may fill several files."""
    files = integrity.verify_logs(log_files(spark, folder)).withColumn("file", F.col("log_id")).withColumn("log_id", F.substring_index("log_id", "-", 1))
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    return files.groupBy("log_id").agg(F.min_by(F.struct("state", "basis", "device_id"), F.struct(rank, "file")).alias("v")).select("log_id", "v.*")


def _report_parts(spark, folder):
    """The tables that a report is made of: meta, report, findings, snapshots, verified, geo."""
    parts = analytics.FlightAnalytics(cut(telemetry(spark, folder, *REPORT_MESSAGES)))
    verified = cut(_verified(spark, folder))
    known = H.firmware_and_frame(telemetry(spark, folder, "MSG")).withColumn("frame_type", F.when(F.col("frame") != "UNKNOWN", F.col("frame")))
    meta = parts.span.join(known, "log_id", "left").join(verified.select("log_id", F.col("device_id").alias("serial_number")), "log_id", "left")
    marks = of_type(events(spark, folder), "error").select("log_id", F.col("seq").alias("cursor"), "t")
    taken = S.snapshots(lake(spark, folder), marks, verified)
    geo = _geography(spark, folder).select("log_id", "lat", "lon", "ident", "name", "airport_m", "designator", "airport_ident", "runway_m")
    report = parts.report()
    logs = parts.span.select("log_id")
    return cut(meta), cut(report), cut(analytics.ranked_findings(parts.findings)), cut(taken), logs.join(verified.select("log_id", "state", "basis"), "log_id"), cut(geo)


@query("report_documents")
def report_documents(spark, folder):
    return evidence.report_json(*_report_parts(spark, folder))


@query("report_blocks")
def report_blocks(spark, folder):
    """The Markdown reports with all their sections, over the same parts as the JSON documents."""
    return evidence.report_markdown(*_report_parts(spark, folder))


@query("log_meta", f"""WITH {BASE}, l AS (SELECT log_id, any_value(user_id) % 5 AS c, 178 + 57 * count(*) AS n, min(us) / 1e6 AS a, max(us) / 1e6 AS b FROM e GROUP BY log_id)
SELECT log_id, CASE c WHEN 0 THEN n WHEN 4 THEN 34 ELSE 64 + n + 44 * ((n + 511) // 512) + CASE WHEN c = 2 THEN 0 ELSE 101 END END AS file_size, CASE WHEN c = 4 THEN 0 ELSE a END AS t_min, CASE WHEN c = 4 THEN 0 ELSE b END AS t_max,
  CASE WHEN c = 4 THEN 0 ELSE b - a END AS duration_s, 0.0::DOUBLE AS max_altitude_m, CASE WHEN c IN (1, 2, 3) THEN '4.5' ELSE '—' END AS firmware, '—' AS frame,
  CASE WHEN c IN (1, 2, 3) THEN '0x1234' ELSE '—' END AS device_id, CASE WHEN c IN (1, 2, 3) THEN '0x1234' ELSE '—' END AS serial_number, CASE WHEN c IN (1, 2, 3) THEN 7 ELSE 0 END AS log_counter FROM l""")
def log_meta(spark, folder):
    from aerolake.plans.timeline import log_span
    from aerolake.sources.decode import decode_logs

    files = cut(log_files(spark, folder))
    rows = cut(decode_logs(files))  # decoded once, read by four parts
    return integrity.log_meta(files, integrity.verify_logs(files), metrics.scalar_metrics(rows), log_span(rows), H.health(rows))


def _stream(spark, folder):
    schema = table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def _run(spark, rows, mode: str = "append"):
    """Run a stream over what is there and return what it wrote."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query_ = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query("stream_rolling_stats", """WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS s, value FROM events)
SELECT event_type, epoch(s)::BIGINT AS w_start, min(value) AS v_min, max(value) AS v_max, round(avg(value), 6) AS v_mean, count(*) AS n FROM w GROUP BY event_type, s""")
def stream_rolling_stats(spark, folder):
    done = _run(spark, landing.rolling_stats(_stream(spark, folder), ["event_type"], "value", "1 hour"))
    given = table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    done = done.unionByName(landing.remaining_windows(given, done, ["event_type"], "value", "1 hour"))
    return done.select("event_type", F.unix_seconds("w_start").alias("w_start"), "v_min", "v_max", F.round("v_mean", 6).alias("v_mean"), "n")


@query("stream_arm_regions", f"""WITH {EV}, a AS (SELECT log_id, seq, t, event_type = 'signup' AS is_on FROM ev WHERE event_type IN ('signup', 'purchase')),
b AS (SELECT *, lag(is_on) OVER (PARTITION BY log_id ORDER BY t, seq) AS was FROM a), c AS (SELECT *, lead(t) OVER (PARTITION BY log_id ORDER BY t, seq) AS nt FROM b WHERE is_on <> coalesce(was, FALSE))
SELECT c.log_id, c.t AS t_start, coalesce(c.nt, e.t_end) AS t_end FROM c JOIN (SELECT log_id, max(t) AS t_end FROM a GROUP BY log_id) e ON e.log_id = c.log_id WHERE is_on""")
def stream_arm_regions(spark, folder):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        armed = F.when(F.col("event_type") == "signup", F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        from suite.fleet import MICROS

        def records(given):
            return given.where("event_type IN ('signup', 'purchase')").select(
                F.col("user_id").cast("string").alias("log_id"), F.lit("ARM").alias("msg"), F.lit(None).cast("int").alias("instance"), F.col("event_id").alias("seq"),
                (F.expr(MICROS) / F.lit(1e10)).alias("t"), F.create_map(F.lit("ArmState"), armed).alias("ints"), F.create_map().cast("map<string,double>").alias("reals"))

        closed = _run(spark, landing.live_arm_regions(records(_stream(spark, folder))))
        batch = records(table(spark, folder, "events"))
        span = batch.groupBy("log_id").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))
        return closed.unionByName(landing.remaining_regions(batch, span, closed))
    finally:
        spark.conf.set(key, before)


@query("stream_alerts", f"""WITH {EV}, a AS (SELECT log_id, t, 'ERROR' AS severity, 'EKF' AS rule FROM ev WHERE event_type = 'error' AND k % 4 = 0 AND k % 3 > 0
  UNION ALL SELECT log_id, t, 'WARNING', 'GPS_HDOP' FROM ev WHERE event_type = 'click' AND value % 4 > 2.5 UNION ALL SELECT log_id, t, 'WARNING', 'GPS_SATS' FROM ev WHERE event_type = 'click' AND k % 20 < 6
  UNION ALL SELECT log_id, t, 'WARNING', 'VIBE_X' FROM ev WHERE event_type = 'error' AND value % 45 > 30 UNION ALL SELECT log_id, t, 'WARNING', 'VIBE_Y' FROM ev WHERE event_type = 'error' AND k / 2.5::DOUBLE > 30
  UNION ALL SELECT log_id, t, 'ERROR', 'ERR' FROM ev WHERE event_type = 'error')
SELECT DISTINCT log_id, rule, severity, CAST(floor(t / 60) AS BIGINT) * 60 AS "minute" FROM a""")
def stream_alerts(spark, folder):
    """Live alerts over the streamed records; which record of a minute fires is open, that one does is not."""
    rows = landing.event_time(records_of(named(_stream(spark, folder)), "XKF4", "GPS", "VIBE", "ERR"))
    fired = _run(spark, landing.live_alerts(rows))
    return fired.select("log_id", "rule", "severity", F.unix_seconds("minute").alias("minute"))


@query("markdown_heads", f"""WITH {EV}, m AS (SELECT log_id, arg_min(k, seq) FILTER (WHERE k % 5 = 1) AS fk, count(*) FILTER (WHERE k % 5 = 2) AS nf, count(*) AS n, any_value(user_id) AS u FROM ev WHERE event_type = 'error' GROUP BY log_id)
SELECT log_id, '# Investigation Evidence' || chr(10) || chr(10) || '**Log:** ' || log_id || '  ' || chr(10) || '**Aircraft:** unit ' || u || ' · ' || CASE WHEN fk IS NULL THEN 'UNKNOWN' ELSE 'ArduCopter V4.5.' || (fk % 7) END || ' · '
  || CASE WHEN nf > 0 THEN 'QUAD/X' ELSE '—' END || '  ' || chr(10) || '**Verification:** ' || CASE u % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'WRONG KEY' ELSE 'UNKNOWN' END || '  ' || chr(10)
  || CASE WHEN u % 4 > 0 THEN '**Assessment:** GOOD (' || (80 + u % 4) || '/100)  ' || chr(10) ELSE '' END || '**Snapshots:** ' || n || chr(10) || chr(10) || '---' || chr(10) AS text FROM m""")
def markdown_heads(spark, folder):
    faults = of_type(events(spark, folder), "error")
    known = H.firmware_and_frame(telemetry(spark, folder, "MSG"))
    number = F.col("log_id").cast("bigint")
    meta = known.select("log_id", F.concat(F.lit("unit "), "log_id").alias("serial_number"), "firmware", F.when(F.col("frame") != "UNKNOWN", F.col("frame")).alias("frame_type"))
    verified = known.select("log_id", F.when(number % 3 == 0, "VERIFIED").when(number % 3 == 1, "WRONG_KEY").otherwise("UNKNOWN").alias("state"), F.array().cast("array<string>").alias("basis"))
    report = known.select("log_id", F.lit("GOOD").alias("verdict"), F.when(number % 4 > 0, (80 + number % 4).cast("double")).alias("quality_score"))
    marks = faults.select("log_id", F.col("seq").alias("cursor"))
    return evidence.header_markdown(meta, report, verified, marks).select("log_id", "text")


@query("json_flights", f"""WITH {EV}, m AS (SELECT log_id, arg_min(k, seq) FILTER (WHERE k % 5 = 1) AS fk, count(*) AS n, any_value(user_id) AS u FROM ev WHERE event_type = 'error' GROUP BY log_id)
SELECT log_id, 'unit ' || u AS serial_number, CASE WHEN fk IS NULL THEN 'UNKNOWN' ELSE 'ArduCopter V4.5.' || (fk % 7) END AS firmware, CASE u % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'WRONG_KEY' ELSE 'UNKNOWN' END AS verification_state,
  CASE u % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'WRONG KEY' ELSE 'UNKNOWN' END AS label, n AS snapshot_count, n AS snapshots_held FROM m""")
def json_flights(spark, folder):
    """Fields read back from the JSON documents; all parts of a log are counted."""
    known = H.firmware_and_frame(telemetry(spark, folder, "MSG"))
    number = F.col("log_id").cast("bigint")
    meta = known.select("log_id", F.concat(F.lit("unit "), "log_id").alias("serial_number"), "firmware", F.col("frame").alias("frame_type"))
    verified = known.select("log_id", F.when(number % 3 == 0, "VERIFIED").when(number % 3 == 1, "WRONG_KEY").otherwise("UNKNOWN").alias("state"), F.array().cast("array<string>").alias("basis"))
    marks = of_type(events(spark, folder), "error").select("log_id", F.col("seq").alias("cursor"), "t")
    none = marks.where("false").select("log_id", F.col("cursor").alias("finding_no"))
    documents = evidence.report_json(meta, known.select("log_id", F.lit("GOOD").alias("verdict")), none, marks, verified)
    read = lambda path: F.get_json_object("json", path)
    held = F.size(F.from_json(read("$.snapshots"), "array<struct<cursor:bigint>>"))
    return documents.groupBy("log_id").agg(
        *[F.max(read(f"$.flight.{c}")).alias(c) for c in ("serial_number", "firmware", "verification_state")], F.max(read("$.flight.verification.label")).alias("label"),
        F.max(read("$.snapshot_count")).cast("bigint").alias("snapshot_count"), F.sum(F.when(held > 0, held)).alias("snapshots_held"))
