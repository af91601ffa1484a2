"""Timeline, events, metrics, health and trajectory of the derived fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.operators import intervals, stats
from aerolake.plans import events as E
from aerolake.plans import health as H
from aerolake.plans import metrics, timeline, trajectory
from suite.fleet import EV, EVENTS, MODES, REGIONS, SPAN, events, lake, span, telemetry
from suite.registry import ORACLES, query

KEY = ["log_id"]


@query("armed_signal_stats", f"""WITH {REGIONS},
i AS (SELECT e.log_id, e.event_type, e.value FROM ev e WHERE EXISTS (SELECT 1 FROM regions r WHERE r.log_id = e.log_id AND e.t BETWEEN r.t_start AND r.t_end))
SELECT log_id, event_type, min(value) AS v_min, max(value) AS v_max, round(avg(value), 6) AS v_mean, round(stddev_pop(value), 6) AS v_std,
  count(value) AS n FROM i GROUP BY log_id, event_type""")
def armed_signal_stats(spark, folder):
    regions = timeline.arm_regions(telemetry(spark, folder, "ARM", "EV"), span(spark, folder))
    inside = intervals.within_windows(events(spark, folder), regions, KEY, "t")
    found = stats.signal_stats(inside, ["log_id", "event_type"], "value")
    return found.withColumns({"v_mean": F.round("v_mean", 6), "v_std": F.round("v_std", 6)})


@query("arm_regions", f"WITH {REGIONS} SELECT log_id, idx, t_start, t_end, source FROM regions")
def arm_regions(spark, folder):
    return timeline.arm_regions(telemetry(spark, folder, "ARM", "EV"), span(spark, folder))


@query("mode_segments", f"WITH {EV}, {SPAN}, {MODES} SELECT log_id, idx, mode_num, mode, t_start, t_end FROM modes")
def mode_segments(spark, folder):
    return timeline.mode_segments(telemetry(spark, folder, "MODE"), span(spark, folder))


@query("unified_events", f"WITH {EV}, {EVENTS} SELECT log_id, seq, t, severity, type, message, source_rank FROM events_all")
def unified_events(spark, folder):
    return E.flight_events(telemetry(spark, folder, *E.EVENT_MESSAGES))


@query("event_search", f"""WITH {EV}, {EVENTS} SELECT log_id, count(*) FILTER (WHERE severity = 'ERROR'
  AND (contains(lower(message), 'gps') OR contains(lower(type), 'gps'))) AS shown, count(*) AS total FROM events_all GROUP BY log_id""")
def event_search(spark, folder):
    found = E.flight_events(telemetry(spark, folder, *E.EVENT_MESSAGES))
    return E.event_search_counts(found, severity="ERROR", search="GPS")


@query("event_types", f"WITH {EV}, {EVENTS} SELECT DISTINCT log_id, type FROM events_all")
def event_types(spark, folder):
    return E.event_types(E.flight_events(telemetry(spark, folder, *E.EVENT_MESSAGES)))


@query("conversation_severity", """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'fail|error|crash|critical')
  THEN 'CRITICAL' ELSE 'INFO' END AS severity FROM conversations""")
def conversation_severity(spark, folder):
    from aerolake.functions.columns import keyword_severity
    from suite.registry import table
    rows = table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", keyword_severity(F.col("text")).alias("severity"))


FLIGHTS = f"""{REGIONS}, {MODES}, {EVENTS},
evc AS (SELECT r.log_id, r.idx, count(e.t) AS event_count FROM regions r LEFT JOIN events_all e
  ON e.log_id = r.log_id AND e.t >= r.t_start AND e.t <= r.t_end GROUP BY r.log_id, r.idx),
mdc AS (SELECT r.log_id, r.idx, count(DISTINCT m.mode_num) AS mode_count FROM regions r LEFT JOIN modes m
  ON m.log_id = r.log_id AND m.t_start < r.t_end AND m.t_end > r.t_start GROUP BY r.log_id, r.idx),
agl AS (SELECT log_id, seq, t, value % 30 AS agl FROM ev WHERE event_type = 'click'),
pk AS (SELECT r.log_id, r.idx, max(a.agl) AS peak FROM regions r JOIN agl a ON a.log_id = r.log_id AND a.t BETWEEN r.t_start AND r.t_end GROUP BY 1, 2),
flights AS (SELECT r.log_id, r.idx AS flight_index, r.t_start, r.t_end, r.t_end - r.t_start AS duration, coalesce(pk.peak, 0.0) AS peak_agl,
  evc.event_count, mdc.mode_count, r.source FROM regions r JOIN evc ON evc.log_id = r.log_id AND evc.idx = r.idx
  JOIN mdc ON mdc.log_id = r.log_id AND mdc.idx = r.idx LEFT JOIN pk ON pk.log_id = r.log_id AND pk.idx = r.idx)"""
FLIGHT_MESSAGES = (*E.EVENT_MESSAGES, "POS")


def _flights(spark, folder):
    rows, spans = lake(spark, folder, *FLIGHT_MESSAGES), span(spark, folder)
    split = timeline.fleet_split(rows)
    found = E.flight_events(rows)
    regions = timeline.arm_regions(rows, spans, split)
    modes = timeline.mode_segments(rows, spans, split)
    return spans, found, timeline.flight_windows(rows, regions, found, modes, split=split)


@query("flight_windows", f"WITH {FLIGHTS} SELECT * FROM flights")
def flight_windows(spark, folder):
    return _flights(spark, folder)[2]


@query("log_summary", f"""WITH {FLIGHTS},
a AS (SELECT log_id, count(*) AS n, sum(duration) AS s, max(peak_agl) AS p FROM flights GROUP BY log_id),
b AS (SELECT log_id, count(*) AS n FROM events_all GROUP BY log_id)
SELECT s.log_id, s.t_first, s.t_last, coalesce(a.n, 0) AS flight_count, round(coalesce(a.s, 0), 6) AS armed_total_s,
  coalesce(a.p, 0) AS peak_agl_m, coalesce(b.n, 0) AS event_total FROM span s LEFT JOIN a ON a.log_id = s.log_id LEFT JOIN b ON b.log_id = s.log_id""")
def log_summary(spark, folder):
    spans, found, flights = _flights(spark, folder)
    rows = timeline.log_summary(spans, flights, found)
    return rows.withColumn("armed_total_s", F.round("armed_total_s", 6))


@query("altitude_profile", f"""WITH {EV}, a AS (SELECT log_id, seq, t, value % 30 AS agl, row_number() OVER (PARTITION BY log_id ORDER BY seq) - 1 AS i,
  count(*) OVER (PARTITION BY log_id) AS n FROM ev WHERE event_type = 'click'),
p AS (SELECT DISTINCT a.log_id, CAST(trunc(CASE WHEN j = 7 THEN n - 1 ELSE j * ((n - 1) / 7.0::DOUBLE) END) AS BIGINT) AS i
  FROM (SELECT DISTINCT log_id, n FROM a) a CROSS JOIN range(8) r(j))
SELECT a.log_id, a.seq, a.t, a.agl, 'POS.RelHomeAlt' AS source FROM a WHERE n <= 8 OR EXISTS (SELECT 1 FROM p WHERE p.log_id = a.log_id AND p.i = a.i)""")
def altitude_profile(spark, folder):
    return timeline.altitude_profile(telemetry(spark, folder, "POS", "BARO"), 8)


@query("message_ranges", f"""WITH {EV} SELECT log_id, 'ATT' AS msg, CAST(NULL AS INTEGER) AS "instance", min(t) AS t_min, max(t) AS t_max FROM ev WHERE event_type = 'view' GROUP BY log_id
UNION ALL SELECT log_id, 'GPS', 0, min(t), max(t) FROM ev WHERE event_type = 'click' GROUP BY log_id""")
def message_ranges(spark, folder):
    return timeline.message_range(telemetry(spark, folder, "ATT", "GPS"))


# Origin of the derived tracks: the first GPS position of each log (latitudes are never near zero).
TRACK = f"""{EV},
p AS (SELECT log_id, seq, t, -35 + k * 0.0001::DOUBLE AS lat, 149 + (value % 10) * 0.0001::DOUBLE AS lng, 600 + value % 30 AS alt, value % 30 AS rel
  FROM ev WHERE event_type = 'click'),
o AS (SELECT log_id, arg_min(lat, seq) AS lat0, arg_min(lng, seq) AS lng0, arg_min(alt, seq) AS alt0 FROM p GROUP BY log_id),
q AS (SELECT p.*, lat0, lng0, 6378137.0 * cos(radians(lat0)) * radians(lng - lng0) AS east, 6378137.0 * radians(lat - lat0) AS north, alt - alt0 AS up0 FROM p JOIN o ON o.log_id = p.log_id),
ok AS (SELECT log_id FROM q GROUP BY log_id HAVING max(sqrt(east * east + north * north)) >= 1.0),
vary AS (SELECT log_id FROM p GROUP BY log_id HAVING max(rel) - min(rel) >= 1.0),
track AS (SELECT q.log_id, q.seq, q.t, q.east, q.north, CASE WHEN v.log_id IS NULL THEN q.up0 ELSE q.rel END AS up, q.lat0, q.lng0,
  CASE WHEN v.log_id IS NULL THEN 'GPS[0].Alt' ELSE 'POS.RelHomeAlt' END AS alt_source
  FROM q JOIN ok ON ok.log_id = q.log_id LEFT JOIN vary v ON v.log_id = q.log_id)"""
TRACK_MESSAGES = ("GPS", "POS", "BARO")


def _track(spark, folder):
    return trajectory.best_trajectory(lake(spark, folder, *TRACK_MESSAGES))


@query("best_trajectory", f"""WITH {TRACK} SELECT log_id, seq, t, round(east, 5) AS east, round(north, 5) AS north, round(up, 6) AS up,
  round(lat0, 8) AS lat0, round(lng0, 8) AS lng0, 'GPS[0]' AS pos_source, alt_source FROM track""")
def best_trajectory(spark, folder):
    rows = _track(spark, folder)
    return rows.select("log_id", "seq", "t", F.round("east", 5).alias("east"), F.round("north", 5).alias("north"), F.round("up", 6).alias("up"),
                       F.round("origin.lat", 8).alias("lat0"), F.round("origin.lng", 8).alias("lng0"), "pos_source", "alt_source")


@query("path_length", f"""WITH {TRACK}, s AS (SELECT log_id, sqrt((east - lag(east) OVER w) ** 2 + (north - lag(north) OVER w) ** 2) AS step
  FROM track WINDOW w AS (PARTITION BY log_id ORDER BY seq))
SELECT log_id, round(sum(step), 4) AS distance_m FROM s GROUP BY log_id HAVING count(step) > 0""")
def path_length(spark, folder):
    return trajectory.path_length(_track(spark, folder)).withColumn("distance_m", F.round("distance_m", 4))


@query("track_extent", f"""WITH {TRACK} SELECT log_id, round(min(east), 4) AS e_min, round(max(east), 4) AS e_max, round(min(north), 4) AS n_min, round(max(north), 4) AS n_max,
  round(min(up), 6) AS u_min, round(max(up), 6) AS u_max, greatest(max(east) - min(east), max(north) - min(north), max(up) - min(up)) < 1 AS stationary,
  round(any_value(lat0) + degrees((min(north) - 2000) / 6378137.0), 7) AS lat_a, round(any_value(lat0) + degrees((max(north) + 2000) / 6378137.0), 7) AS lat_b,
  round(any_value(lng0) + degrees((min(east) - 2000) / (6378137.0 * cos(radians(any_value(lat0))))), 7) AS lon_a,
  round(any_value(lng0) + degrees((max(east) + 2000) / (6378137.0 * cos(radians(any_value(lat0))))), 7) AS lon_b FROM track GROUP BY log_id""")
def track_extent(spark, folder):
    box = trajectory.track_extent(_track(spark, folder))
    digits = {c: 4 for c in ("e_min", "e_max", "n_min", "n_max")} | {"u_min": 6, "u_max": 6} | {c: 7 for c in ("lat_a", "lat_b", "lon_a", "lon_b")}
    return box.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("events_on_track", f"""WITH {TRACK}, {EVENTS},
b AS (SELECT e.log_id, e.seq, e.type, e.severity, e.t, n.east, n.north FROM events_all e ASOF LEFT JOIN track n ON n.log_id = e.log_id AND n.t >= e.t),
l AS (SELECT log_id, arg_max(east, t) AS east, arg_max(north, t) AS north FROM track GROUP BY log_id)
SELECT b.log_id, b.seq, b.type, b.severity, round(coalesce(b.east, l.east), 5) AS east, round(coalesce(b.north, l.north), 5) AS north
FROM b LEFT JOIN l ON l.log_id = b.log_id""")
def events_on_track(spark, folder):
    found = E.flight_events(telemetry(spark, folder, *E.EVENT_MESSAGES))
    placed = trajectory.events_on_track(found, _track(spark, folder))
    return placed.select("log_id", "seq", "type", "severity", F.round("east", 5).alias("east"), F.round("north", 5).alias("north"))


@query("tile_density", f"""WITH {TRACK},
ll AS (SELECT log_id, up, lat0 + degrees(north / 6378137.0) AS lat, lng0 + degrees(east / (6378137.0 * cos(radians(lat0)))) AS lon FROM track),
x AS (SELECT log_id, up, CAST(trunc((lon + 180.0) / 360.0 * 262144) AS BIGINT) AS x,
  CAST(trunc((1.0 - asinh(tan(radians(greatest(least(lat, 85.05112878), -85.05112878)))) / pi()) / 2.0 * 262144) AS BIGINT) AS y FROM ll)
SELECT x, y, 18 AS z, count(*) AS positions, count(DISTINCT log_id) AS logs, round(avg(up), 3) AS mean_up,
  round(x / 262144.0::DOUBLE * 360.0 - 180.0, 9) AS lon_w, round(degrees(atan(sinh(pi() * (1.0 - 2.0 * y / 262144.0::DOUBLE)))), 9) AS lat_n FROM x GROUP BY x, y""")
def tile_density(spark, folder):
    tiles = trajectory.tile_density(_track(spark, folder), 18)
    return tiles.select("x", "y", "z", "positions", "logs", F.round("mean_up", 3).alias("mean_up"),
                        F.round("bounds.lon_w", 9).alias("lon_w"), F.round("bounds.lat_n", 9).alias("lat_n"))


@query("scalar_metrics", f"""WITH {EV}, {SPAN},
a AS (SELECT log_id, count(*) AS n, max(t) - min(t) AS d FROM ev WHERE event_type IN ('signup', 'purchase') AND user_id % 7 <> 0 GROUP BY log_id),
v AS (SELECT log_id, max(t) FILTER (WHERE k % 30 = 11) - min(t) FILTER (WHERE k % 30 IN (10, 15)) AS d FROM ev WHERE event_type = 'error' GROUP BY log_id),
c AS (SELECT log_id, max(value % 30) AS alt, max(value % 15) AS spd FROM ev WHERE event_type = 'click' GROUP BY log_id)
SELECT s.log_id, s.t_last - s.t_first AS span_s, coalesce(CASE WHEN a.n >= 2 THEN a.d END, CASE WHEN v.d > 0 THEN v.d END, s.t_last - s.t_first) AS duration_s,
  coalesce(c.alt, 0) AS max_altitude_m, CASE WHEN c.alt IS NOT NULL THEN 'AGL' END AS altitude_kind, coalesce(c.spd, 0) AS max_speed_mps, coalesce(a.n, 0) AS arm_count
FROM span s LEFT JOIN a ON a.log_id = s.log_id LEFT JOIN v ON v.log_id = s.log_id LEFT JOIN c ON c.log_id = s.log_id""")
def scalar_metrics(spark, folder):
    return metrics.scalar_metrics(telemetry(spark, folder)).drop("altitude_text", "speed_text")


@query("flight_metrics")
def flight_metrics(spark, folder):
    return metrics.flight_metrics(lake(spark, folder))


@query("metric_values", f"""SELECT m.*, coalesce(p.distance_m, 0) AS distance_m, coalesce(c.n, 0) AS event_count, coalesce(c.modes, 0) AS mode_change_count,
  CAST(floor(m.duration_s / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(m.duration_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS duration_text
FROM ({ORACLES["scalar_metrics"]}) m LEFT JOIN ({ORACLES["path_length"]}) p ON p.log_id = m.log_id
LEFT JOIN (SELECT log_id, count(*) AS n, count(*) FILTER (WHERE type = 'MODE') AS modes FROM ({ORACLES["unified_events"]}) GROUP BY log_id) c ON c.log_id = m.log_id""")
def metric_values(spark, folder):
    found = metrics.flight_metrics(lake(spark, folder))
    return found.drop("altitude_text", "speed_text", "distance_text").withColumn("distance_m", F.round("distance_m", 4))


@query("parameters", f"""WITH {EV}, p AS (SELECT log_id, seq, CASE k % 8 WHEN 0 THEN 'RCMAP_ROLL' WHEN 1 THEN 'RC1_MIN' WHEN 2 THEN 'RC1_MAX' WHEN 3 THEN 'RC1_TRIM'
  WHEN 4 THEN 'RC1_DZ' WHEN 5 THEN 'MOT_PWM_MIN' WHEN 6 THEN 'RC1_REVERSED' ELSE 'MOT_PWM_MAX' END AS name,
  CAST(CASE k % 8 WHEN 0 THEN 1 + k % 4 WHEN 1 THEN 1000 + k WHEN 2 THEN 1900 + k WHEN 3 THEN 1450 + k WHEN 4 THEN k % 30 WHEN 5 THEN 1000 + k WHEN 6 THEN k % 2 ELSE 1900 + k END AS DOUBLE) AS value
  FROM ev WHERE event_type = 'signup')
SELECT log_id, name, arg_max(value, seq) AS value FROM p GROUP BY log_id, name""")
def parameters(spark, folder):
    return H.parameters(telemetry(spark, folder, "PARM"))


@query("firmware_and_frame", f"""WITH {EV}, m AS (SELECT log_id, arg_min(k, seq) FILTER (WHERE k % 5 = 1) AS fk, count(*) FILTER (WHERE k % 5 = 2) AS nf FROM ev WHERE event_type = 'error' GROUP BY log_id)
SELECT log_id, CASE WHEN fk IS NULL THEN 'UNKNOWN' ELSE 'ArduCopter V4.5.' || (fk % 7) END AS firmware, CASE WHEN fk IS NULL THEN '' ELSE 'abc' || fk END AS build,
  CASE WHEN nf > 0 THEN 'QUAD/X' ELSE 'UNKNOWN' END AS frame FROM m""")
def firmware_and_frame(spark, folder):
    return H.firmware_and_frame(telemetry(spark, folder, "MSG"))


@query("health", f"""WITH {EV}, l AS (SELECT DISTINCT log_id FROM ev WHERE event_type IN ('error', 'click')),
x AS (SELECT log_id, max(CASE WHEN k % 4 = 0 THEN k % 3 ELSE 0 END) AS m FROM ev WHERE event_type = 'error' GROUP BY log_id),
g AS (SELECT log_id, arg_max(k, seq) AS k, arg_max(value % 4, seq) AS hdop FROM ev WHERE event_type = 'click' GROUP BY log_id),
m AS (SELECT log_id, arg_min(k, seq) FILTER (WHERE k % 5 = 1) AS fk, count(*) FILTER (WHERE k % 5 = 2) AS nf FROM ev WHERE event_type = 'error' GROUP BY log_id)
SELECT l.log_id, CASE WHEN x.m IS NULL THEN 'NO DATA' WHEN x.m > 0 THEN 'WARN' ELSE 'OK' END AS ekf_status,
  CASE WHEN x.m IS NULL THEN '' WHEN x.m > 0 THEN 'Filter status > 0 (max=' || x.m || ')' ELSE 'All FS = 0' END AS ekf_detail,
  CASE WHEN g.k IS NULL THEN 'NO DATA' ELSE list_extract(['NO_GPS', 'NO_FIX', '2D_FIX', '3D_FIX', 'DGPS', 'RTK_FLOAT', 'RTK_FIXED'], CAST(g.k % 7 AS INTEGER) + 1) END AS gps_fix,
  coalesce(g.k % 20, 0) AS gps_sats, coalesce(g.hdop, 0.0) AS gps_hdop, FALSE AS is_sitl,
  CASE WHEN g.k IS NULL THEN 'NO DATA' WHEN g.k % 7 >= 3 THEN 'OK' ELSE 'WARN' END AS gps_status,
  CASE WHEN fk IS NULL THEN 'UNKNOWN' ELSE 'ArduCopter V4.5.' || (fk % 7) END AS firmware, CASE WHEN fk IS NULL THEN '' ELSE 'abc' || fk END AS build,
  CASE WHEN coalesce(nf, 0) > 0 THEN 'QUAD/X' ELSE 'UNKNOWN' END AS frame
FROM l LEFT JOIN x ON x.log_id = l.log_id LEFT JOIN g ON g.log_id = l.log_id LEFT JOIN m ON m.log_id = l.log_id""")
def health(spark, folder):
    return H.health(telemetry(spark, folder, "XKF4", "GPS", "MSG"))


ANOMALIES = f"""{EV}, {SPAN}, er AS (SELECT * FROM ev WHERE event_type = 'error'), cl AS (SELECT * FROM ev WHERE event_type = 'click'),
vm AS (SELECT log_id, max(10 + k / 30.0::DOUBLE) AS vmax FROM er GROUP BY log_id),
hits AS (
  SELECT log_id, min(t) AS t, 'ERROR' AS severity, 'EKF' AS category, 'EKF filter fault FS=' || arg_min(k % 3, seq) AS message FROM er WHERE k % 4 = 0 AND k % 3 > 0 GROUP BY log_id
  UNION ALL SELECT log_id, min(t), 'WARNING', 'GPS', 'Poor GPS HDOP=' || printf('%.2f', max(value % 4)) FROM cl WHERE value % 4 > 2.5 GROUP BY log_id
  UNION ALL SELECT log_id, min(t), 'WARNING', 'GPS', 'Low GPS sats=' || min(k % 20) FROM cl WHERE k % 20 < 6 GROUP BY log_id
  UNION ALL SELECT log_id, min(t), 'WARNING', 'VIBE', 'VibeX' FROM er WHERE value % 45 > 30 GROUP BY log_id
  UNION ALL SELECT log_id, min(t), 'WARNING', 'VIBE', 'VibeY' FROM er WHERE k / 2.5::DOUBLE > 30 GROUP BY log_id
  UNION ALL SELECT e.log_id, min(t), 'WARNING', 'POWER', 'Low battery' FROM er e JOIN vm ON vm.log_id = e.log_id WHERE vmax > 4 AND 10 + k / 30.0::DOUBLE < vmax * 0.85::DOUBLE GROUP BY e.log_id
  UNION ALL SELECT log_id, t, 'ERROR', 'ERR', 'Subsys=' || (k % 20) || ' ECode=' || (k % 4) FROM er)"""


@query("anomalies", f"""WITH {ANOMALIES} SELECT h.log_id, h.t, h.t - s.t_first AS t_rel, h.severity, h.category, h.message FROM hits h JOIN span s ON s.log_id = h.log_id""")
def anomalies(spark, folder):
    found = H.anomalies(telemetry(spark, folder, "XKF4", "GPS", "VIBE", "BAT", "ERR"), span(spark, folder))
    # Texts with rounded readings are compared by their leading words.
    short = (F.when(F.col("category") == "VIBE", F.regexp_extract("message", "Vibe[XYZ]", 0))
             .when(F.col("category") == "POWER", F.lit("Low battery")).otherwise(F.col("message")))
    return found.select("log_id", "t", "t_rel", "severity", "category", short.alias("message"))


@query("fault_summary", f"""WITH {ANOMALIES}, c AS (SELECT log_id, count(*) FILTER (WHERE severity IN ('ERROR', 'CRITICAL')) AS errors,
  count(*) FILTER (WHERE severity = 'WARNING') AS warnings FROM hits GROUP BY log_id)
SELECT *, CASE WHEN errors > 0 THEN errors || ' ERROR' || CASE WHEN errors > 1 THEN 'S' ELSE '' END
  WHEN warnings > 0 THEN warnings || ' WARNING' || CASE WHEN warnings > 1 THEN 'S' ELSE '' END ELSE 'CLEAN' END AS card FROM c""")
def fault_summary(spark, folder):
    found = H.anomalies(telemetry(spark, folder, "XKF4", "GPS", "VIBE", "BAT", "ERR"), span(spark, folder))
    return E.fault_summary(found)


@query("event_review", f"""WITH {EV}, {EVENTS}, rv AS (SELECT log_id, seq, arg_max(CASE k % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'REVIEWED' ELSE 'FLAGGED' END, n) AS status, max(n) AS n
  FROM (SELECT log_id, seq, k, 1 AS n FROM ev WHERE event_type = 'error' AND k % 2 = 0 UNION ALL SELECT log_id, seq, k + 1, 2 FROM ev WHERE event_type = 'error' AND k % 4 = 0) GROUP BY 1, 2)
SELECT e.log_id, e.type, e.seq, coalesce(rv.status, 'OPEN') AS status, coalesce('note ' || rv.n, '') AS notes FROM events_all e
LEFT JOIN rv ON e.type = 'ERR' AND rv.log_id = e.log_id AND rv.seq = e.seq""")
def event_review(spark, folder):
    base = events(spark, folder).where("event_type = 'error'")
    first = base.where("k % 2 = 0").withColumn("n", F.lit(1))
    second = base.where("k % 4 = 0").withColumn("n", F.lit(2)).withColumn("k", F.col("k") + 1)
    status = F.expr("CASE k % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'REVIEWED' ELSE 'FLAGGED' END")
    reviews = first.unionByName(second).select("log_id", F.lit("ERR").alias("type"), "seq", F.col("n").alias("at"), status.alias("status"),
                                               F.concat(F.lit("note "), F.col("n").cast("string")).alias("notes"))
    found = E.with_review(E.flight_events(telemetry(spark, folder, *E.EVENT_MESSAGES)), reviews)
    return found.select("log_id", "type", "seq", "status", "notes")
