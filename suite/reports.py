"""Flight analytics, snapshots and reports of the derived fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.functions import fixed
from aerolake.operators.intervals import few_windows
from aerolake.plans import analytics as A
from aerolake.plans import health as H
from aerolake.plans import snapshot as S
from aerolake.plans import timeline
from aerolake.session import cut
from suite.fleet import EV, EVENTS, MODES, REGIONS, SPAN, events, lake, of_type, span, telemetry
from suite.flights import ANOMALIES
from suite.registry import query

KEY = ["log_id"]

WINDOWS = f"""{REGIONS}, windows AS (SELECT log_id, idx, t_start, t_end FROM regions UNION ALL
  SELECT log_id, 0, t_first, t_last FROM span WHERE log_id NOT IN (SELECT log_id FROM regions) AND t_last > t_first),
totals AS (SELECT log_id, sum(t_end - t_start) AS armed_s, count(*) AS flight_count, arg_max(t_end, idx) AS last_end FROM windows GROUP BY log_id),
inw AS (SELECT e.* FROM ev e WHERE EXISTS (SELECT 1 FROM windows w WHERE w.log_id = e.log_id AND e.t BETWEEN w.t_start AND w.t_end))"""
TRACKING = f"""{WINDOWS},
err0 AS (SELECT log_id, seq, t, k, value, unnest(['roll', 'pitch', 'yaw']) AS axis, unnest([value % 16 - 8, value % 10 - 5, value % 24 - 12]) AS e,
  unnest([0.6::DOUBLE * k - 30 + value % 16 - 8, 10 - 0.2::DOUBLE * k + value % 10 - 5, 3.6::DOUBLE * k + value % 24 - 12]) AS act,
  unnest([0.6::DOUBLE * k - 30, 10 - 0.2::DOUBLE * k, 3.6::DOUBLE * k]) AS des FROM inw WHERE event_type = 'view'),
err AS (SELECT *, (act - des + 180) - 360 * floor((act - des + 180) / 360) - 180 AS d FROM err0),
track AS (SELECT log_id, axis, sqrt(avg(d * d)) AS rms_deg, max(abs(d)) AS max_deg,
  avg(CASE WHEN abs(d) <= CASE WHEN axis = 'yaw' THEN 8.0 ELSE 5.0 END THEN 1.0 ELSE 0.0 END) * 100 AS pct_in_tol FROM err GROUP BY log_id, axis HAVING count(*) >= 2),
tracks AS (SELECT *, greatest(0.0, least(100.0, 100.0 * (1.0 - rms_deg / (3.0 * CASE WHEN axis = 'yaw' THEN 8.0 ELSE 5.0 END)))) AS score FROM track)"""


def _windows(spark, folder):
    rows = telemetry(spark, folder, "ARM", "EV")
    return cut(A.armed_windows(rows, span(spark, folder), timeline.fleet_split(rows)))


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("armed_windows", f"WITH {WINDOWS} SELECT log_id, idx, t_start, t_end FROM windows")
def armed_windows(spark, folder):
    return _windows(spark, folder)


@query("tracking", f"WITH {TRACKING} SELECT log_id, axis, round(rms_deg, 6) AS rms_deg, round(max_deg, 6) AS max_deg, round(pct_in_tol, 6) AS pct_in_tol, round(score, 6) AS score FROM tracks")
def tracking(spark, folder):
    errors = A.attitude_errors(telemetry(spark, folder, "ATT"), _windows(spark, folder))
    return _rounded(A.tracking(errors), 6, "rms_deg", "max_deg", "pct_in_tol", "score")


STICKS = f"""{WINDOWS}, pm AS (SELECT log_id, n, arg_max(v, seq) AS v FROM (SELECT log_id, seq, CASE k % 8 WHEN 0 THEN 'map' WHEN 1 THEN 'lo' WHEN 2 THEN 'hi' WHEN 3 THEN 'tr' ELSE 'x' END AS n,
    CAST(CASE k % 8 WHEN 0 THEN 1 + k % 4 WHEN 1 THEN 1000 + k WHEN 2 THEN 1900 + k WHEN 3 THEN 1450 + k ELSE 0 END AS DOUBLE) AS v FROM ev WHERE event_type = 'signup') GROUP BY log_id, n),
cf AS (SELECT l.log_id, coalesce(max(v) FILTER (WHERE n = 'map'), 1) AS map, coalesce(max(v) FILTER (WHERE n = 'lo'), 1000) AS lo, coalesce(max(v) FILTER (WHERE n = 'hi'), 2000) AS hi, coalesce(max(v) FILTER (WHERE n = 'tr'), 1500) AS tr
  FROM (SELECT DISTINCT log_id FROM ev WHERE event_type IN ('click', 'signup')) l LEFT JOIN pm ON pm.log_id = l.log_id GROUP BY l.log_id),
ax AS (SELECT log_id, axis, CASE axis WHEN 'roll' THEN CAST(map AS INTEGER) WHEN 'pitch' THEN 2 ELSE 4 END AS ch, lo, hi, tr FROM cf CROSS JOIN (VALUES ('roll'), ('pitch'), ('yaw')) a(axis)),
st0 AS (SELECT i.log_id, ax.axis, i.seq, i.t, 1000.0 + 10 * ((i.k * CASE ch WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 13 ELSE 29 END) % 100) AS pwm,
  CASE WHEN ch = 1 THEN lo ELSE 1000 END AS lo, CASE WHEN ch = 1 THEN hi ELSE 2000 END AS hi, CASE WHEN ch = 1 THEN tr ELSE 1500 END AS tr FROM inw i JOIN ax ON ax.log_id = i.log_id WHERE i.event_type = 'click'),
st AS (SELECT log_id, axis, seq, t, greatest(-1.0, least(1.0, (pwm - tr) / ((hi - lo) / 2))) AS n FROM st0 QUALIFY count(*) OVER (PARTITION BY log_id, axis) >= 3),
rt AS (SELECT log_id, axis, seq, t, (n - lag(n) OVER w) / (t - lag(t) OVER w) AS r FROM st WINDOW w AS (PARTITION BY log_id, axis ORDER BY t, seq)),
sg AS (SELECT log_id, axis, sign(r) AS s, lag(sign(r)) OVER (PARTITION BY log_id, axis ORDER BY t, seq) AS p FROM rt WHERE abs(r) > 0.05),
rv AS (SELECT log_id, axis, count(*) FILTER (WHERE s <> p) AS n FROM sg GROUP BY log_id, axis),
smooth0 AS (SELECT rt.log_id, rt.axis, avg(abs(r)) AS activity FROM rt WHERE r IS NOT NULL GROUP BY 1, 2),
smooth1 AS (SELECT s.log_id, s.axis, s.activity, coalesce(rv.n, 0) / greatest(coalesce(t.armed_s, 0), 1e-6) AS reversals_per_s FROM smooth0 s LEFT JOIN rv ON rv.log_id = s.log_id AND rv.axis = s.axis LEFT JOIN totals t ON t.log_id = s.log_id),
smooths AS (SELECT *, greatest(0.0, least(100.0, 100.0 * (1.0 - reversals_per_s / 2.0))) AS score FROM smooth1)"""


@query("smoothness", f"WITH {STICKS} SELECT log_id, axis, round(activity, 6) AS activity, round(reversals_per_s, 6) AS reversals_per_s, round(score, 6) AS score FROM smooths")
def smoothness(spark, folder):
    windows = _windows(spark, folder)
    sticks = A.stick_series(telemetry(spark, folder, "RCIN", "PARM"), windows)
    return _rounded(A.smoothness(sticks, A.armed_totals(windows)), 6, "activity", "reversals_per_s", "score")


YAW = f"""{STICKS}, {TRACKING[len(WINDOWS) + 1:]},
yh AS (SELECT log_id, sqrt(avg(d * d)) AS rms FROM err WHERE axis = 'yaw' AND log_id IN (SELECT log_id FROM track WHERE axis = 'yaw') GROUP BY log_id),
yu AS (SELECT log_id, avg(abs(n)) AS act, count(*) FILTER (WHERE abs(n) > 0.5) AS large FROM st WHERE axis = 'yaw' GROUP BY log_id),
yaw0 AS (SELECT s.log_id, yh.rms AS yaw_rms, yu.act AS yaw_activity, coalesce(yu.large, 0) AS large_corrections,
  greatest(0.0, least(100.0, 100 * (1 - yh.rms / 24.0))) AS a, greatest(0.0, least(100.0, 100 * (1 - yu.act / 0.5))) AS b FROM span s LEFT JOIN yh ON yh.log_id = s.log_id LEFT JOIN yu ON yu.log_id = s.log_id),
yaws AS (SELECT log_id, yaw_rms, yaw_activity, large_corrections, CASE WHEN yaw_rms IS NULL AND yaw_activity IS NULL THEN NULL WHEN yaw_rms IS NULL THEN b WHEN yaw_activity IS NULL THEN a ELSE (a + b) / 2 END AS yaw_score FROM yaw0)"""


@query("yaw_discipline", f"WITH {YAW} SELECT log_id, round(yaw_rms, 6) AS yaw_rms, round(yaw_activity, 6) AS yaw_activity, large_corrections, round(yaw_score, 6) AS yaw_score FROM yaws")
def yaw_discipline(spark, folder):
    rows, windows = telemetry(spark, folder, "ATT", "RCIN", "PARM"), _windows(spark, folder)
    found = A.yaw_discipline(A.attitude_errors(rows, windows), A.stick_series(rows, windows), span(spark, folder).select("log_id"))
    return _rounded(found, 6, "yaw_rms", "yaw_activity", "yaw_score")


LANDING = f"""agl AS (SELECT log_id, seq, t, value % 30 AS h, value % 6 - 3 AS crt FROM ev WHERE event_type = 'click' QUALIFY count(*) OVER (PARTITION BY log_id) >= 3),
fl AS (SELECT a.* FROM agl a JOIN totals t ON t.log_id = a.log_id WHERE a.t <= t.last_end),
air AS (SELECT log_id, max(seq) AS s FROM fl WHERE h > 3 GROUP BY log_id),
td AS (SELECT f.log_id, arg_min(f.t, f.seq) AS t FROM fl f JOIN air ON air.log_id = f.log_id WHERE f.seq > air.s AND f.h < 1 GROUP BY f.log_id),
okc AS (SELECT log_id FROM inw WHERE event_type = 'click' GROUP BY log_id HAVING count(*) > 1),
dv AS (SELECT log_id, t, (h - lag(h) OVER w) / greatest(t - lag(t) OVER w, 1e-3) AS vs FROM agl WINDOW w AS (PARTITION BY log_id ORDER BY seq)),
vs AS (SELECT i.log_id, i.t, i.value % 6 - 3 AS vs FROM inw i JOIN okc ON okc.log_id = i.log_id WHERE event_type = 'click' UNION ALL SELECT log_id, t, vs FROM dv WHERE vs IS NOT NULL AND log_id NOT IN (SELECT log_id FROM okc)),
rate AS (SELECT v.log_id, abs(least(min(v.vs), 0.0)) AS r FROM vs v JOIN td ON td.log_id = v.log_id WHERE v.t BETWEEN td.t - 3.0 AND td.t + 0.25 GROUP BY v.log_id),
lands AS (SELECT t.log_id, td.t IS NOT NULL AS landed, td.t AS touchdown_t, rate.r AS touchdown_rate, CASE WHEN rate.r IS NULL THEN 'UNKNOWN' WHEN rate.r < 1 THEN 'SMOOTH' WHEN rate.r < 2 THEN 'FIRM' WHEN rate.r < 3 THEN 'HARD' ELSE 'SEVERE' END AS landing_class,
  CASE WHEN rate.r IS NULL THEN NULL WHEN rate.r < 1 THEN 100.0 WHEN rate.r < 2 THEN 80.0 WHEN rate.r < 3 THEN 50.0 ELSE 20.0 END AS landing_score FROM totals t LEFT JOIN td ON td.log_id = t.log_id LEFT JOIN rate ON rate.log_id = t.log_id)"""


@query("landing", f"WITH {WINDOWS}, {LANDING} SELECT log_id, landed, touchdown_t, round(touchdown_rate, 6) AS touchdown_rate, landing_class, landing_score FROM lands")
def landing(spark, folder):
    windows = _windows(spark, folder)
    found = A.landing(lake(spark, folder, "POS", "BARO", "CTUN"), windows, A.armed_totals(windows))
    return _rounded(found, 6, "touchdown_rate")


SATURATION = """mo AS (SELECT log_id, n, arg_max(v, seq) AS v FROM (SELECT log_id, seq, k % 8 AS n, CAST(CASE k % 8 WHEN 5 THEN 1000 + k ELSE 1900 + k END AS DOUBLE) AS v FROM ev WHERE event_type = 'signup' AND k % 8 IN (5, 7)) GROUP BY log_id, n),
lim AS (SELECT s.log_id, max(v) FILTER (WHERE n = 5) AS a, max(v) FILTER (WHERE n = 7) AS b FROM span s LEFT JOIN mo ON mo.log_id = s.log_id GROUP BY s.log_id),
li AS (SELECT log_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND b > a THEN a ELSE 1000.0 END AS lo, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND b > a THEN b ELSE 2000.0 END AS hi FROM lim),
mm AS (SELECT i.log_id, c.c, avg(CASE WHEN 1000.0 + 10 * ((k * c.c) % 100) >= hi - 0.03::DOUBLE * (hi - lo) OR 1000.0 + 10 * ((k * c.c) % 100) <= lo + 0.03::DOUBLE * (hi - lo) THEN 1.0 ELSE 0.0 END) * 100 AS p
  FROM inw i JOIN li ON li.log_id = i.log_id CROSS JOIN (VALUES (3), (11), (17), (23)) c(c) WHERE event_type = 'click' GROUP BY 1, 2),
oo AS (SELECT log_id, greatest(avg(CASE WHEN k / 100.0::DOUBLE >= 0.95::DOUBLE THEN 1.0 ELSE 0.0 END), avg(CASE WHEN value % 1 >= 0.95::DOUBLE THEN 1.0 ELSE 0.0 END)) * 100 AS p FROM inw WHERE event_type = 'error' GROUP BY 1),
th AS (SELECT log_id, avg(CASE WHEN k / 100.0::DOUBLE >= 0.95::DOUBLE THEN 1.0 ELSE 0.0 END) * 100 AS p FROM inw WHERE event_type = 'view' GROUP BY 1),
sat0 AS (SELECT s.log_id, m.p AS motor_pct, oo.p AS output_pct, th.p AS throttle_pct, greatest(m.p, oo.p, th.p) / 100 AS w FROM span s LEFT JOIN (SELECT log_id, max(p) AS p FROM mm GROUP BY 1) m ON m.log_id = s.log_id
  LEFT JOIN oo ON oo.log_id = s.log_id LEFT JOIN th ON th.log_id = s.log_id),
sats AS (SELECT log_id, motor_pct, output_pct, throttle_pct, CASE WHEN w >= 0.2::DOUBLE THEN 'CRITICAL' WHEN w >= 0.05::DOUBLE THEN 'WARNING' ELSE 'OK' END AS saturation_severity,
  CASE WHEN w IS NULL THEN 100.0 ELSE greatest(0.0, least(100.0, 100.0 * (1.0 - w / 0.2))) END AS saturation_score FROM sat0)"""


@query("saturation", f"WITH {WINDOWS}, {SATURATION} SELECT log_id, round(motor_pct, 6) AS motor_pct, round(output_pct, 6) AS output_pct, round(throttle_pct, 6) AS throttle_pct, saturation_severity, round(saturation_score, 6) AS saturation_score FROM sats")
def saturation(spark, folder):
    rows = lake(spark, folder, "RCOU", "RATE", "CTUN", "PARM")
    found = A.saturation(rows, _windows(spark, folder), span(spark, folder).select("log_id"))
    return _rounded(found, 6, "motor_pct", "output_pct", "throttle_pct", "saturation_score")


@query("oscillations")
def oscillations(spark, folder):
    errors = A.attitude_errors(telemetry(spark, folder, "ATT"), _windows(spark, folder))
    return A.oscillations(errors, span(spark, folder).select("log_id"))


CARD = f"""{YAW}, {LANDING},
card AS (SELECT s.log_id, t.s AS tracking_score, m.s AS smoothness_score, y.yaw_score, l.landing_score, l.landing_class FROM span s LEFT JOIN (SELECT log_id, avg(score) AS s FROM tracks GROUP BY 1) t ON t.log_id = s.log_id
  LEFT JOIN (SELECT log_id, avg(score) AS s FROM smooths GROUP BY 1) m ON m.log_id = s.log_id LEFT JOIN yaws y ON y.log_id = s.log_id LEFT JOIN lands l ON l.log_id = s.log_id),
cards AS (SELECT *, list_avg(list_filter([tracking_score, smoothness_score, yaw_score, landing_score], lambda x: x IS NOT NULL)) AS pilot_score FROM card)"""


@query("scorecard", f"""WITH {CARD} SELECT log_id, round(tracking_score, 6) AS tracking_score, round(smoothness_score, 6) AS smoothness_score, round(yaw_score, 6) AS yaw_score, landing_score, landing_class,
  round(pilot_score, 6) AS pilot_score, CASE WHEN pilot_score >= 90 THEN 'A' WHEN pilot_score >= 80 THEN 'B' WHEN pilot_score >= 70 THEN 'C' WHEN pilot_score >= 60 THEN 'D' WHEN pilot_score IS NOT NULL THEN 'F' END AS pilot_grade FROM cards""")
def scorecard(spark, folder):
    rows, windows = lake(spark, folder, "ATT", "RCIN", "PARM", "POS", "BARO", "CTUN"), _windows(spark, folder)
    totals, logs, split = cut(A.armed_totals(windows)), cut(span(spark, folder)).select("log_id"), timeline.fleet_split(rows)
    errors, sticks = A.attitude_errors(rows, windows, split), A.stick_series(rows, windows, split)
    parts = A.tracking(errors), A.smoothness(sticks, totals, split), A.yaw_discipline(errors, sticks, logs), A.landing(rows, windows, totals, split)
    card = A.scorecard(logs, *[cut(part) for part in parts])
    return _rounded(card, 6, "tracking_score", "smoothness_score", "yaw_score", "pilot_score")


REPORT_MESSAGES = ("ARM", "EV", "ATT", "RCIN", "PARM", "POS", "BARO", "CTUN", "RCOU", "RATE", "XKF4", "GPS", "VIBE", "BAT", "ERR")


@query("flight_report")
def flight_report(spark, folder):
    return A.FlightAnalytics(lake(spark, folder, *REPORT_MESSAGES)).report()


@query("top_findings")
def top_findings(spark, folder):
    return A.top_findings(A.FlightAnalytics(lake(spark, folder, *REPORT_MESSAGES)).findings, 20)


PHASES = f"""{REGIONS}, {MODES}, agl AS (SELECT log_id, t, value % 30 AS v FROM ev WHERE event_type = 'click'),
sz AS (SELECT log_id, count(*) AS c FROM agl GROUP BY log_id),
rg AS (SELECT r.*, coalesce(sz.c, 0) >= 2 AND r.t_end > r.t_start AS flown, greatest(2, CAST(floor((t_end - t_start) / 0.5) AS BIGINT) + 1) AS n FROM regions r LEFT JOIN sz ON sz.log_id = r.log_id),
gd AS (SELECT log_id, idx, n, t_start, t_end, i, CASE WHEN i = n - 1 THEN t_end ELSE i * ((t_end - t_start) / (n - 1)) + t_start END AS t FROM (SELECT *, unnest(range(n)) AS i FROM rg WHERE flown)),
g1 AS (SELECT gd.*, a.t AS lt, a.v AS lv FROM gd ASOF LEFT JOIN agl a ON a.log_id = gd.log_id AND a.t <= gd.t),
g2 AS (SELECT g1.*, a.t AS ht, a.v AS hv FROM g1 ASOF LEFT JOIN agl a ON a.log_id = g1.log_id AND a.t > g1.t),
g3 AS (SELECT *, CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL OR lt = t THEN lv ELSE (hv - lv) / (ht - lt) * (t - lt) + lv END AS h FROM g2),
g4 AS (SELECT *, (coalesce(lead(h) OVER w, h) - coalesce(lag(h) OVER w, h)) / (coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t)) AS r FROM g3 WINDOW w AS (PARTITION BY log_id, idx ORDER BY i)),
g5 AS (SELECT *, CASE WHEN n <= 2 THEN r ELSE (coalesce(lag(r) OVER w, 0) + r + coalesce(lead(r) OVER w, 0)) / 3 END AS s FROM g4 WINDOW w AS (PARTITION BY log_id, idx ORDER BY i)),
g6 AS (SELECT *, CASE WHEN s > 0.3::DOUBLE THEN 'CLIMB' WHEN s < -0.3::DOUBLE THEN 'DESCENT' ELSE 'HOVER' END AS kind FROM g5),
g7 AS (SELECT *, lag(kind) OVER (PARTITION BY log_id, idx ORDER BY i) AS pk FROM g6),
s1 AS (SELECT log_id, idx, kind, t AS a, coalesce(lead(t) OVER (PARTITION BY log_id, idx ORDER BY i), t_end) AS b, row_number() OVER (PARTITION BY log_id, idx ORDER BY i) AS j,
  row_number() OVER (PARTITION BY log_id, idx ORDER BY i DESC) AS jr FROM g7 WHERE pk IS NULL OR pk <> kind),
e0 AS (SELECT log_id, idx, max(CASE WHEN i = 0 THEN h END) AS h0, max(CASE WHEN i = n - 1 THEN h END) AS h1 FROM g3 GROUP BY 1, 2),
s2 AS (SELECT s1.log_id, s1.idx, a, b, j, CASE WHEN j = 1 AND kind = 'CLIMB' AND h0 < 1 THEN 'TAKEOFF' WHEN jr = 1 AND kind = 'DESCENT' AND h1 < 3 THEN 'LAND' ELSE kind END AS kind FROM s1 JOIN e0 ON e0.log_id = s1.log_id AND e0.idx = s1.idx),
m1 AS (SELECT s2.log_id, s2.idx, s2.j, m.mode, row_number() OVER (PARTITION BY s2.log_id, s2.idx, s2.j ORDER BY m.idx) AS r FROM s2 JOIN modes m ON m.log_id = s2.log_id AND (a + b) * 0.5 BETWEEN m.t_start AND m.t_end),
s3 AS (SELECT s2.log_id, s2.idx, s2.j, a, b, CASE WHEN mode IN ('RTL', 'SMART_RTL', 'AUTO_RTL') THEN 'RTL' WHEN mode = 'LAND' AND kind IN ('DESCENT', 'HOVER') THEN 'LAND' ELSE kind END AS kind
  FROM s2 LEFT JOIN m1 ON m1.log_id = s2.log_id AND m1.idx = s2.idx AND m1.j = s2.j AND m1.r = 1),
s4 AS (SELECT *, lag(kind) OVER (PARTITION BY log_id, idx ORDER BY j) AS pk FROM s3),
s5 AS (SELECT s4.log_id, s4.idx, s4.j, s4.kind, a, coalesce(lead(a) OVER (PARTITION BY s4.log_id, s4.idx ORDER BY s4.j), rg.t_end) AS b FROM s4 JOIN rg ON rg.log_id = s4.log_id AND rg.idx = s4.idx WHERE pk IS NULL OR pk <> s4.kind),
bd AS (SELECT log_id, min_by(t_start, idx) AS a, max_by(t_end, idx) AS b FROM regions GROUP BY 1),
al AS (SELECT log_id, idx, j, kind, a, b FROM s5 UNION ALL SELECT log_id, idx, 0, 'FLIGHT', t_start, t_end FROM rg WHERE NOT flown
  UNION ALL SELECT s.log_id, -1, 0, 'PRE_ARM', t_first, bd.a FROM span s JOIN bd ON bd.log_id = s.log_id WHERE bd.a > t_first
  UNION ALL SELECT s.log_id, 1000000000, 0, 'POST', bd.b, t_last FROM span s JOIN bd ON bd.log_id = s.log_id WHERE bd.b < t_last
  UNION ALL SELECT log_id, 0, 0, 'FLIGHT', t_first, t_last FROM span WHERE log_id NOT IN (SELECT log_id FROM bd) AND t_last > t_first),
o1 AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY idx, j) AS o FROM al),
o2 AS (SELECT *, o = 1 OR b - a >= 0.05::DOUBLE AS kept FROM o1),
o3 AS (SELECT *, last_value(CASE WHEN kept THEN kind END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS cur FROM o2),
o4 AS (SELECT *, lag(cur) OVER (PARTITION BY log_id ORDER BY o) AS pc, lag(b) OVER (PARTITION BY log_id ORDER BY o) AS pb, last_value(b) OVER (PARTITION BY log_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM o3),
phases AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY o) - 1 AS idx, cur AS kind, a AS t_start, coalesce(lead(pb) OVER (PARTITION BY log_id ORDER BY o), fin) AS t_end FROM o4 WHERE pc IS NULL OR pc <> cur)"""


@query("phases", f"WITH {PHASES} SELECT log_id, idx, kind, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM phases")
def phases(spark, folder):
    rows = lake(spark, folder, "ARM", "EV", "MODE", "POS", "BARO")
    return _rounded(timeline.phases(rows, span=span(spark, folder)), 6, "t_start", "t_end")


@query("watchlist_values", f"""WITH {EV}, c AS (SELECT log_id, t, seq FROM ev WHERE event_type = 'view'),
s AS (SELECT log_id, t, 'BAT Volt' AS label, 10 + k / 30.0::DOUBLE AS v FROM ev WHERE event_type = 'error' UNION ALL SELECT log_id, t, 'BAT Curr', value % 40 FROM ev WHERE event_type = 'error'
  UNION ALL SELECT log_id, t, 'Vibe Z', value % 20 FROM ev WHERE event_type = 'error' UNION ALL SELECT log_id, t, 'Motor ' || j, 1000.0 + 10 * ((k * m) % 100) FROM ev CROSS JOIN (VALUES (1, 3), (2, 11), (3, 17), (4, 23)) x(j, m) WHERE event_type = 'click'),
cl AS (SELECT c.*, label FROM c CROSS JOIN (VALUES ('BAT Volt'), ('BAT Curr'), ('Motor 1'), ('Motor 2'), ('Motor 3'), ('Motor 4'), ('IMU AccZ'), ('Vibe Z')) l(label)),
b AS (SELECT cl.*, lo.t AS lt, lo.v AS lv FROM cl ASOF LEFT JOIN s lo ON lo.log_id = cl.log_id AND lo.label = cl.label AND lo.t < cl.t),
x AS (SELECT b.*, hi.t AS ht, hi.v AS hv FROM b ASOF LEFT JOIN s hi ON hi.log_id = b.log_id AND hi.label = b.label AND hi.t >= b.t)
SELECT log_id, seq AS cursor, label, round(CASE WHEN ht IS NULL THEN NULL WHEN ht = t THEN hv WHEN lt IS NULL THEN NULL ELSE lv + (hv - lv) * (t - lt) / (ht - lt) END, 8) AS value FROM x""")
def watchlist_values(spark, folder):
    marks = of_type(events(spark, folder), "view").select("log_id", F.col("seq").alias("cursor"), "t")
    rows = telemetry(spark, folder, "BAT", "RCOU", "IMU", "VIBE")
    return _rounded(S.watchlist_values(rows, marks), 8, "value")


def _panel(spark, folder):
    marks = of_type(events(spark, folder), "error").select("log_id", F.col("seq").alias("cursor"), "t")
    rows = lake(spark, folder, "ATT", "CTUN", "RCIN", "RCOU", "PARM", "POS", "BARO", "GPS", "XKF4", "XKF3")
    return S.instrument_panel(rows, marks)


def _linear(name, source, value, kind):
    return f"""{name}_s AS (SELECT log_id, t, {value} AS v FROM ev WHERE event_type = '{kind}'),
{name}_b AS (SELECT c.log_id, c.t, c.seq, lo.t AS lt, lo.v AS lv FROM {source} c ASOF LEFT JOIN {name}_s lo ON lo.log_id = c.log_id AND lo.t < c.t),
{name}_x AS (SELECT b.*, hi.t AS ht, hi.v AS hv FROM {name}_b b ASOF LEFT JOIN {name}_s hi ON hi.log_id = b.log_id AND hi.t >= b.t),
{name} AS (SELECT log_id, seq, CASE WHEN ht IS NULL THEN NULL WHEN ht = t THEN hv WHEN lt IS NULL THEN NULL ELSE lv + (hv - lv) * (t - lt) / (ht - lt) END AS v FROM {name}_x)"""


@query("cursor_diagnostics", f"""WITH {EV}, c AS (SELECT log_id, t, seq, k, value FROM ev WHERE event_type = 'error'), l AS (SELECT DISTINCT log_id FROM ev WHERE event_type = 'click'),
{_linear('crt', 'c', 'value % 6 - 3', 'click')}, {_linear('rel', 'c', 'value % 30', 'click')}, {_linear('spd', 'c', 'value % 15', 'click')}
, g AS (SELECT c.log_id, c.seq, s.k FROM c ASOF LEFT JOIN (SELECT log_id, t, k FROM ev WHERE event_type = 'click') s ON s.log_id = c.log_id AND s.t <= c.t),
e AS (SELECT *, greatest(value % 1.5, k / 80.0::DOUBLE, 0.3::DOUBLE, value % 0.9::DOUBLE) AS m, CASE WHEN k % 4 = 0 THEN k % 3 ELSE 0 END AS fs, sqrt((value % 3 - 1.5) ** 2 + (k / 50.0::DOUBLE - 1) ** 2) AS pd FROM c)
SELECT e.log_id, e.seq AS cursor, round(crt.v, 6) AS vertical_speed, round(rel.v, 6) AS altitude, round(spd.v, 6) AS ground_speed, CAST(g.k % 20 AS BIGINT) AS gps_sats, round(e.m, 6) AS ekf_ratio, e.fs AS ekf_faults,
  CASE WHEN fs <> 0 OR m >= 1 THEN 'CRITICAL' WHEN m >= 0.5 THEN 'CAUTION' ELSE 'OK' END AS ekf_state, round(pd, 6) AS position_gap, CASE WHEN pd >= 2 THEN 'CRITICAL' WHEN pd >= 0.5 THEN 'CAUTION' ELSE 'OK' END AS position_state
FROM e JOIN crt ON crt.log_id = e.log_id AND crt.seq = e.seq JOIN rel ON rel.log_id = e.log_id AND rel.seq = e.seq JOIN spd ON spd.log_id = e.log_id AND spd.seq = e.seq JOIN g ON g.log_id = e.log_id AND g.seq = e.seq""")
def cursor_diagnostics(spark, folder):
    panel = _panel(spark, folder).withColumns({"ekf": S.estimator_status(), "gap": S.position_divergence(), "climb": S.climb_rate()})
    r = lambda c, n: F.round(c, 6).alias(n)
    return panel.select(
        "log_id", "cursor", r(S.value_of("BARO[0].CRt"), "vertical_speed"), r(S.value_of("POS.RelHomeAlt"), "altitude"), r(S.value_of("GPS[0].Spd"), "ground_speed"),
        S.value_of("GPS[0].NSats").cast("bigint").alias("gps_sats"), r(F.col("ekf.ratio"), "ekf_ratio"), F.col("ekf.faults").alias("ekf_faults"), F.col("ekf.state").alias("ekf_state"),
        r(F.col("gap.value"), "position_gap"), F.col("gap.state").alias("position_state"))


@query("control_matrix", f"""WITH {EV}, c AS (SELECT log_id, t, seq FROM ev WHERE event_type = 'error'),
{_linear('ro', 'c', '0.6::DOUBLE * k - 30 + value % 16 - 8', 'view')}, {_linear('dr', 'c', '0.6::DOUBLE * k - 30', 'view')}, {_linear('pi', 'c', '10 - 0.2::DOUBLE * k + value % 10 - 5', 'view')}, {_linear('dp', 'c', '10 - 0.2::DOUBLE * k', 'view')},
{_linear('ya', 'c', '3.6::DOUBLE * k + value % 24 - 12', 'view')}, {_linear('dy', 'c', '3.6::DOUBLE * k', 'view')}, {_linear('th', 'c', 'k / 100.0::DOUBLE', 'view')}, {_linear('rc', 'c', '1000.0 + 10 * ((k * 17) % 100)', 'click')},
a AS (SELECT log_id, seq, 'roll' AS axis, dr.v AS demand, ro.v AS actual FROM ro JOIN dr USING (log_id, seq) UNION ALL SELECT log_id, seq, 'pitch', dp.v, pi.v FROM pi JOIN dp USING (log_id, seq)
  UNION ALL SELECT log_id, seq, 'yaw', dy.v, ya.v FROM ya JOIN dy USING (log_id, seq)),
d AS (SELECT *, abs((actual - demand + 180) - 360 * floor((actual - demand + 180) / 360) - 180) AS delta FROM a UNION ALL
  SELECT th.log_id, th.seq, 'throttle', th.v, (rc.v - 1000) / 1000, abs(th.v - (rc.v - 1000) / 1000) FROM th JOIN rc USING (log_id, seq))
SELECT log_id, seq AS cursor, axis, round(demand, 6) AS demand, round(actual, 6) AS actual, round(delta, 6) AS delta,
  CASE WHEN delta IS NULL THEN 'NONE' WHEN delta >= CASE WHEN axis = 'throttle' THEN 0.25::DOUBLE ELSE 20 END THEN 'CRITICAL' WHEN delta >= CASE WHEN axis = 'throttle' THEN 0.1::DOUBLE ELSE 8 END THEN 'CAUTION' ELSE 'NOMINAL' END AS band FROM d""")
def control_matrix(spark, folder):
    found = S.control_matrix(_panel(spark, folder)).drop("pilot")
    return _rounded(found, 6, "demand", "actual", "delta")


@query("control_matrix_pilot")
def control_matrix_pilot(spark, folder):
    """The same rows with the pilot's sticks, which the SQL of ``control_matrix`` does not state."""
    return _rounded(S.control_matrix(_panel(spark, folder)), 6, "pilot", "demand", "actual", "delta")


@query("snapshots")
def snapshots(spark, folder):
    marks = of_type(events(spark, folder), "error").select("log_id", F.col("seq").alias("cursor"), "t")
    return S.snapshots(lake(spark, folder), marks)


@query("telemetry_rows")
def telemetry_rows(spark, folder):
    marks = of_type(events(spark, folder), "error").select("log_id", F.col("seq").alias("cursor"), "t")
    return S.telemetry_rows(lake(spark, folder, "ATT", "MODE", "POS", "BARO", "GPS"), marks)


@query("motor_mean", f"""WITH {EV}, c AS (SELECT log_id, seq, t FROM ev WHERE event_type = 'error'), s AS (SELECT log_id, k % 3 AS inst, t, value % 100 AS v FROM ev WHERE event_type = 'click'),
x AS (SELECT c.*, m.inst FROM c JOIN (SELECT DISTINCT log_id, inst FROM s) m ON m.log_id = c.log_id),
lo AS (SELECT x.*, s.t AS lt, s.v AS lv FROM x ASOF LEFT JOIN s ON s.log_id = x.log_id AND s.inst = x.inst AND s.t <= x.t),
hi AS (SELECT lo.*, s.t AS ht, s.v AS hv FROM lo ASOF LEFT JOIN s ON s.log_id = lo.log_id AND s.inst = lo.inst AND s.t > lo.t)
SELECT log_id, seq AS cursor, round(avg(CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL OR lt = t THEN lv ELSE lv + (hv - lv) / (ht - lt) * (t - lt) END), 6) AS esc_avg FROM hi GROUP BY log_id, seq""")
def motor_mean(spark, folder):
    """Motor outputs of three instances, read off the clicks."""
    rows = of_type(events(spark, folder), "click").select(
        "log_id", F.lit("ESCX").alias("msg"), (F.col("k") % 3).cast("int").alias("instance"), "seq", "t", F.create_map().cast("map<string,bigint>").alias("ints"),
        F.create_map(F.lit("outpct"), F.col("value") % 100).alias("reals"), F.create_map().cast("map<string,string>").alias("texts"))
    marks = of_type(events(spark, folder), "error").select("log_id", F.col("seq").alias("cursor"), "t")
    return _rounded(S.motor_mean(rows, marks), 6, "esc_avg")


# -- findings and verdict over a given table of oscillations -----------------------------------------

OSC = """osc AS (SELECT s.log_id, a.axis, a.i, (CAST(s.log_id AS BIGINT) + a.i) % 4 = 0 AS detected, CASE WHEN CAST(s.log_id AS BIGINT) % 3 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity
  FROM span s CROSS JOIN (VALUES ('roll', 0), ('pitch', 1), ('yaw', 2)) a(axis, i))"""
FOUND = f"""{CARD}, {SATURATION}, {ANOMALIES[len(EV) + len(SPAN) + 4:]}, {OSC},
found AS (SELECT log_id, severity, 'OSCILLATION' AS category, upper(axis[1]) || axis[2:] || ' oscillation' AS title, NULL::DOUBLE AS t_start, 0 AS rule, i AS rule_seq FROM osc WHERE detected
  UNION ALL SELECT log_id, 'WARNING', 'TRACKING', 'Poor ' || axis || ' tracking', NULL, 1, CASE axis WHEN 'roll' THEN 0 WHEN 'pitch' THEN 1 ELSE 2 END FROM tracks WHERE score < 60
  UNION ALL SELECT log_id, saturation_severity, 'SATURATION', 'Controller / actuator saturation', NULL, 2, 0 FROM sats WHERE saturation_severity <> 'OK'
  UNION ALL SELECT log_id, CASE landing_class WHEN 'SEVERE' THEN 'CRITICAL' ELSE 'WARNING' END, 'LANDING', CASE landing_class WHEN 'SEVERE' THEN 'Severe landing' ELSE 'Hard landing' END, touchdown_t, 3, 0
    FROM lands WHERE landed AND landing_class IN ('HARD', 'SEVERE')
  UNION ALL SELECT log_id, 'WARNING', 'YAW', 'Excessive yaw correction', NULL, 4, 0 FROM yaws WHERE yaw_score < 60
  UNION ALL SELECT log_id, severity, category, category || ' anomaly', t, CASE WHEN category = 'EKF' THEN 5 WHEN message LIKE 'Poor GPS%' THEN 6 WHEN category = 'GPS' THEN 7 WHEN category = 'VIBE' THEN 8
    WHEN category = 'POWER' THEN 9 ELSE 10 END, CASE WHEN message = 'VibeY' THEN 1 ELSE 0 END FROM hits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 3 ELSE 9 END, coalesce(t_start, 0), rule, rule_seq) AS finding_no FROM found)"""


def _judged(spark, folder):
    """(card, totals, oscillations, saturation, findings) with oscillations derived from the log's name."""
    rows, windows = lake(spark, folder, *REPORT_MESSAGES), _windows(spark, folder)
    totals, spans, split = cut(A.armed_totals(windows)), cut(span(spark, folder)), timeline.fleet_split(rows)
    logs = spans.select("log_id")
    few = few_windows(windows, KEY)
    # Each is read by two parts or more, whose plans would repeat the search for the windows.
    errors, sticks = cut(A.attitude_errors(rows, windows, split, few=few)), cut(A.stick_series(rows, windows, split, few=few))
    track, smooth, landed = cut(A.tracking(errors)), cut(A.smoothness(sticks, totals, split)), cut(A.landing(rows, windows, totals, split, few=few))
    yaw, saturated = cut(A.yaw_discipline(errors, sticks, logs)), cut(A.saturation(rows, windows, logs, split, few=few))
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(i).alias("i")) for i, a in enumerate(("roll", "pitch", "yaw"))]))
    number = F.col("log_id").cast("bigint")
    osc = logs.select("log_id", axes.alias("a")).select("log_id", "a.axis", ((number + F.col("a.i")) % 4 == 0).alias("detected"), F.lit(2.5).alias("freq_hz"), F.lit(3.5).alias("amplitude_deg"),
                                                        F.when(number % 3 == 0, "CRITICAL").otherwise("WARNING").alias("severity"))
    found = cut(A.findings(osc, track, saturated, landed, yaw, H.anomalies(rows, spans)))
    return A.scorecard(logs, track, smooth, yaw, landed), totals, osc, saturated, found


@query("ranked_findings", f"WITH {FOUND} SELECT log_id, finding_no, severity, category, title, t_start FROM ranked")
def ranked_findings(spark, folder):
    return A.ranked_findings(_judged(spark, folder)[4]).select("log_id", "finding_no", "severity", "category", "title", "t_start")


@query("first_findings", f"WITH {FOUND} SELECT log_id, finding_no, severity, category, title, t_start FROM ranked WHERE finding_no <= 20")
def first_findings(spark, folder):
    return A.top_findings(_judged(spark, folder)[4], 20).select("log_id", F.col("finding_no").cast("bigint").alias("finding_no"), "severity", "category", "title", "t_start")


@query("quality_verdict", f"""WITH {FOUND}, stab AS (SELECT log_id, min(CASE WHEN NOT detected THEN 100.0 WHEN severity = 'CRITICAL' THEN 40.0 ELSE 70.0 END) AS stability FROM osc GROUP BY log_id),
n AS (SELECT log_id, count(*) FILTER (WHERE severity = 'CRITICAL') AS crit, count(*) AS n FROM found GROUP BY log_id),
q AS (SELECT c.log_id, coalesce(t.armed_s, 0) AS armed_s, coalesce(t.flight_count, 0) AS flight_count, coalesce(n.crit, 0) AS crit, coalesce(n.n, 0) AS n, b.stability, c.tracking_score, c.pilot_score, a.saturation_score,
  (c.tracking_score * 0.3 + b.stability * 0.25 + a.saturation_score * 0.15 + coalesce(c.pilot_score * 0.3, 0)) / (0.7 + CASE WHEN c.pilot_score IS NULL THEN 0 ELSE 0.3 END) AS raw
  FROM cards c LEFT JOIN totals t ON t.log_id = c.log_id LEFT JOIN stab b ON b.log_id = c.log_id LEFT JOIN sats a ON a.log_id = c.log_id LEFT JOIN n ON n.log_id = c.log_id),
s AS (SELECT *, CASE WHEN armed_s > 0 AND tracking_score IS NOT NULL THEN CASE WHEN crit > 0 THEN least(raw, 55.0) ELSE raw END END AS score FROM q)
SELECT log_id, round(score, 6) AS quality_score, CASE WHEN score IS NULL THEN 'NO DATA' WHEN score >= 85 THEN 'GOOD' WHEN score >= 70 THEN 'ACCEPTABLE' WHEN score >= 50 THEN 'MARGINAL' ELSE 'POOR' END AS verdict,
  crit AS critical_findings, n AS finding_count, flight_count, round(stability, 6) AS stability FROM s""")
def quality_verdict(spark, folder):
    rows = A.quality(*_judged(spark, folder))
    return rows.select("log_id", F.round("quality_score", 6).alias("quality_score"), "verdict", "critical_findings", "finding_count", "flight_count", F.round("stability", 6).alias("stability"))
