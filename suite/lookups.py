"""Value-at-time lookups, intervals and neighbours (samples are views, cursors are clicks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.operators import asof, intervals, resample
from suite.fleet import EV, EVENTS, MODES, REGIONS, SPAN, events, of_type, span, telemetry
from suite.registry import query

KEY = ["log_id"]

SAMPLES = f"""WITH {EV},
s AS (SELECT log_id, t, seq, CASE WHEN k % 5 = 0 THEN NULL ELSE value END AS v FROM ev WHERE event_type = 'view'),
c AS (SELECT log_id, t, seq FROM ev WHERE event_type = 'click'),
b AS (SELECT c.log_id, c.t, c.seq, lo.t AS lt, lo.v AS lv, lo.seq AS ls FROM c
  ASOF LEFT JOIN s lo ON lo.log_id = c.log_id AND lo.t < c.t),
x AS (SELECT b.*, hi.t AS ht, hi.v AS hv, hi.seq AS hs FROM b ASOF LEFT JOIN s hi ON hi.log_id = b.log_id AND hi.t >= b.t),
val AS (SELECT *, CASE WHEN hs IS NULL THEN NULL WHEN ls IS NULL THEN CASE WHEN ht = t THEN hv END
    WHEN ht = t AND hv IS NOT NULL THEN hv WHEN lv IS NULL THEN hv WHEN hv IS NULL THEN lv
    ELSE lv + (hv - lv) * (t - lt) / (ht - lt) END AS value FROM x)
"""


def samples(spark, folder):
    rows = of_type(events(spark, folder), "view")
    return rows.select("log_id", "t", "seq", F.when(F.col("k") % 5 != 0, F.col("value")).alias("v"))


def cursors(spark, folder):
    return of_type(events(spark, folder), "click").select("log_id", "t", F.col("seq").alias("cursor"))


@query("asof_linear", SAMPLES + "SELECT log_id, seq AS cursor, t, value FROM val")
def asof_linear(spark, folder):
    return asof.asof_linear(cursors(spark, folder), samples(spark, folder), KEY, "t", "v", "seq")


@query("asof_hold", f"""WITH {EV},
s AS (SELECT log_id, t, seq, CASE WHEN k % 5 = 0 THEN NULL ELSE value END AS v FROM ev WHERE event_type = 'view')
SELECT c.log_id, c.seq AS cursor, c.t, s.v AS value, s.t AS sample_t
FROM (SELECT * FROM ev WHERE event_type = 'click') c ASOF LEFT JOIN s ON s.log_id = c.log_id AND s.t <= c.t""")
def asof_hold(spark, folder):
    held = asof.asof_hold(cursors(spark, folder), samples(spark, folder), KEY, "t", ["v"], "seq")
    return held.select("log_id", "cursor", "t", F.col("held.v").alias("value"), F.col("held.t").alias("sample_t"))


@query("asof_sample", SAMPLES + """SELECT log_id, seq AS cursor, t, value,
  (hs IS NOT NULL AND ls IS NOT NULL AND NOT (ht = t AND hv IS NOT NULL)) AS interpolated,
  CASE WHEN hs IS NOT NULL AND ((ls IS NULL AND ht = t) OR (ht = t AND hv IS NOT NULL)) THEN ht END AS sample_t,
  CASE WHEN hs IS NOT NULL AND ls IS NOT NULL AND NOT (ht = t AND hv IS NOT NULL) THEN lt END AS bracket_lo,
  CASE WHEN hs IS NOT NULL AND ls IS NOT NULL AND NOT (ht = t AND hv IS NOT NULL) THEN ht END AS bracket_hi FROM val""")
def asof_sample(spark, folder):
    found = asof.asof_sample(cursors(spark, folder), samples(spark, folder), KEY, "t", "v", "seq")
    return found.select("log_id", "cursor", "t", "sample.value", "sample.interpolated", "sample.sample_t",
                        F.col("sample.bracket")[0].alias("bracket_lo"), F.col("sample.bracket")[1].alias("bracket_hi"))


@query("sample_index", f"""WITH {EV},
s AS (SELECT log_id, t, row_number() OVER (PARTITION BY log_id ORDER BY t, seq) - 1 AS i FROM ev WHERE event_type = 'view')
SELECT c.log_id, c.seq AS cursor, c.t, s.t AS sample_t, s.i AS "index"
FROM (SELECT * FROM ev WHERE event_type = 'click') c ASOF LEFT JOIN s ON s.log_id = c.log_id AND s.t <= c.t""")
def sample_index(spark, folder):
    return asof.sample_index(cursors(spark, folder), samples(spark, folder), KEY, "t", "seq")


@query("batch_values", f"""WITH {EV},
s AS (SELECT log_id, t, 'view.value' AS label, value AS v FROM ev WHERE event_type = 'view' UNION ALL
  SELECT log_id, t, 'view.k', CAST(k AS DOUBLE) FROM ev WHERE event_type = 'view' UNION ALL
  SELECT log_id, t, 'error.value', value FROM ev WHERE event_type = 'error'),
c AS (SELECT log_id, t, seq, label FROM ev CROSS JOIN (VALUES ('view.value'), ('view.k'), ('error.value')) l(label)
  WHERE event_type = 'click'),
b AS (SELECT c.*, lo.t AS lt, lo.v AS lv FROM c ASOF LEFT JOIN s lo ON lo.log_id = c.log_id AND lo.label = c.label AND lo.t < c.t),
x AS (SELECT b.*, hi.t AS ht, hi.v AS hv FROM b ASOF LEFT JOIN s hi ON hi.log_id = b.log_id AND hi.label = b.label AND hi.t >= b.t)
SELECT log_id, seq AS cursor, t, label, CASE WHEN ht IS NULL THEN NULL WHEN ht = t THEN hv WHEN lt IS NULL THEN NULL
  ELSE lv + (hv - lv) * (t - lt) / (ht - lt) END AS value FROM x""")
def batch_values(spark, folder):
    rows = events(spark, folder)
    channel = F.explode(F.array(
        F.when(F.col("event_type") == "view", F.struct(F.lit("view.value").alias("label"), F.col("value").alias("v"))),
        F.when(F.col("event_type") == "view", F.struct(F.lit("view.k").alias("label"), F.col("k").cast("double").alias("v"))),
        F.when(F.col("event_type") == "error", F.struct(F.lit("error.value").alias("label"), F.col("value").alias("v")))))
    long = rows.select("log_id", "t", "seq", channel.alias("_c")).where("_c is not null").select(
        "log_id", "t", "seq", "_c.label", "_c.v")
    labels = F.explode(F.array(F.lit("view.value"), F.lit("view.k"), F.lit("error.value")))
    marks = cursors(spark, folder).withColumn("label", labels)
    return asof.asof_linear(marks, long, ["log_id", "label"], "t", "v", "seq")


@query("time_range", f"WITH {EV} SELECT log_id, event_type, min(t) AS t_min, max(t) AS t_max FROM ev GROUP BY log_id, event_type")
def time_range(spark, folder):
    return events(spark, folder).groupBy("log_id", "event_type").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))


CLAMPED = """CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL OR lt = t THEN lv ELSE (hv - lv) / (ht - lt) * (t - lt) + lv END"""


@query("interp_clamped", f"""WITH {EV},
s AS (SELECT log_id, t, value AS v FROM ev WHERE event_type = 'view' AND k % 5 <> 0),
b AS (SELECT c.log_id, c.t, c.seq, lo.t AS lt, lo.v AS lv FROM (SELECT * FROM ev WHERE event_type = 'click') c
  ASOF LEFT JOIN s lo ON lo.log_id = c.log_id AND lo.t <= c.t),
x AS (SELECT b.*, hi.t AS ht, hi.v AS hv FROM b ASOF LEFT JOIN s hi ON hi.log_id = b.log_id AND hi.t > b.t)
SELECT log_id, seq AS cursor, t, round({CLAMPED}, 9) AS value FROM x""")
def interp_clamped(spark, folder):
    found = asof.interp_clamped(cursors(spark, folder), samples(spark, folder), KEY, "t", "v", "seq")
    return found.withColumn("value", F.round("value", 9))


@query("column_alignment", f"""WITH {EV},
s AS (SELECT log_id, t, value AS v FROM ev WHERE event_type = 'view' AND k % 5 <> 0),
a AS (SELECT log_id, t, seq, k FROM ev WHERE event_type = 'view'),
b AS (SELECT a.*, lo.t AS lt, lo.v AS lv FROM a ASOF LEFT JOIN s lo ON lo.log_id = a.log_id AND lo.t <= a.t),
x AS (SELECT b.*, hi.t AS ht, hi.v AS hv FROM b ASOF LEFT JOIN s hi ON hi.log_id = b.log_id AND hi.t > b.t)
SELECT log_id, seq, k, round({CLAMPED}, 9) AS aligned FROM x""")
def column_alignment(spark, folder):
    rows = of_type(events(spark, folder), "view").select("log_id", "t", "seq", "k")
    found = asof.interp_clamped(rows, samples(spark, folder), KEY, "t", "v", "seq", out="aligned")
    return found.select("log_id", "seq", "k", F.round("aligned", 9).alias("aligned"))


@query("uniform_resample", f"""WITH {EV}, span AS (SELECT log_id, min(t) AS t_first, max(t) AS t_last FROM ev GROUP BY log_id),
g AS (SELECT log_id, i, CASE WHEN i = 19 THEN t_last ELSE i * ((t_last - t_first) / 19) + t_first END AS t
  FROM span CROSS JOIN range(20) r(i)),
s AS (SELECT log_id, t, value AS v FROM ev),
b AS (SELECT g.*, lo.t AS lt, lo.v AS lv FROM g ASOF LEFT JOIN s lo ON lo.log_id = g.log_id AND lo.t <= g.t),
x AS (SELECT b.*, hi.t AS ht, hi.v AS hv FROM b ASOF LEFT JOIN s hi ON hi.log_id = b.log_id AND hi.t > b.t)
SELECT log_id, i, round(t, 7) AS t, round({CLAMPED}, 6) AS value FROM x""")
def uniform_resample(spark, folder):
    rows = events(spark, folder)
    spans = rows.groupBy(*KEY).agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    grid = resample.resample(spans, rows, KEY, "t", "value", "seq", F.lit(20), out="value")
    return grid.select("log_id", "i", F.round("t", 7).alias("t"), F.round("value", 6).alias("value"))


@query("forward_nearest", f"""WITH {EV},
s AS (SELECT log_id, t, seq, value AS v FROM ev WHERE event_type = 'view'),
b AS (SELECT c.log_id, c.t, c.seq, hi.v AS hv FROM (SELECT * FROM ev WHERE event_type = 'click') c
  ASOF LEFT JOIN s hi ON hi.log_id = c.log_id AND hi.t >= c.t),
l AS (SELECT log_id, arg_max(v, t) AS v FROM s GROUP BY log_id)
SELECT b.log_id, b.seq AS cursor, coalesce(b.hv, l.v) AS value FROM b LEFT JOIN l ON l.log_id = b.log_id""")
def forward_nearest(spark, folder):
    found = asof.asof_forward(cursors(spark, folder), samples_full(spark, folder), KEY, "t", ["v"], "seq")
    return found.select("log_id", "cursor", F.col("found.v").alias("value"))


def samples_full(spark, folder):
    return of_type(events(spark, folder), "view").select("log_id", "t", "seq", F.col("value").alias("v"))


NEAREST = f"""WITH {EV},
e AS (SELECT log_id, t, seq, value AS v FROM ev WHERE event_type = 'error'),
c AS (SELECT log_id, t, seq FROM ev WHERE event_type = 'click'),
p AS (SELECT c.log_id, c.seq AS cursor, e.seq AS es, e.v, abs(e.t - c.t) AS d FROM c JOIN e ON e.log_id = c.log_id)
"""


@query("nearest_event_within", NEAREST + """, n AS (SELECT *, row_number() OVER (PARTITION BY log_id, cursor ORDER BY d, es DESC) AS r
  FROM p WHERE d <= 5.0)
SELECT c.log_id, c.seq AS cursor, n.es AS event_seq, n.v AS value FROM c LEFT JOIN n ON n.log_id = c.log_id AND n.cursor = c.seq AND n.r = 1""")
def nearest_event_within(spark, folder):
    points = of_type(events(spark, folder), "error").withColumn("v", F.col("value"))
    found = asof.nearest_event(cursors(spark, folder), points, KEY, "t", "seq", ["v"], within=5.0, ties="last")
    return found.select("log_id", "cursor", F.col("event.seq").alias("event_seq"), F.col("event.v").alias("value"))


@query("nearest_event_any", NEAREST + """, n AS (SELECT *, row_number() OVER (PARTITION BY log_id, cursor ORDER BY d, es) AS r FROM p)
SELECT c.log_id, c.seq AS cursor, n.es AS event_seq, n.v AS value FROM c LEFT JOIN n ON n.log_id = c.log_id AND n.cursor = c.seq AND n.r = 1""")
def nearest_event_any(spark, folder):
    points = of_type(events(spark, folder), "error").withColumn("v", F.col("value"))
    found = asof.nearest_event(cursors(spark, folder), points, KEY, "t", "seq", ["v"], ties="first")
    return found.select("log_id", "cursor", F.col("event.seq").alias("event_seq"), F.col("event.v").alias("value"))


@query("step_events", f"""WITH {EV},
e AS (SELECT log_id, t, seq FROM ev WHERE event_type = 'error'),
c AS (SELECT log_id, t, seq FROM ev WHERE event_type = 'click'),
n AS (SELECT c.log_id, c.seq AS cursor, min(e.t) AS next_t FROM c JOIN e ON e.log_id = c.log_id AND e.t > c.t + 1e-6 GROUP BY 1, 2),
p AS (SELECT c.log_id, c.seq AS cursor, max(e.t) AS prev_t FROM c JOIN e ON e.log_id = c.log_id AND e.t < c.t - 1e-6 GROUP BY 1, 2)
SELECT c.log_id, c.seq AS cursor, n.next_t, p.prev_t FROM c LEFT JOIN n ON n.log_id = c.log_id AND n.cursor = c.seq
LEFT JOIN p ON p.log_id = c.log_id AND p.cursor = c.seq""")
def step_events(spark, folder):
    points = of_type(events(spark, folder), "error")
    later = asof.step_event(cursors(spark, folder), points, KEY, "t", "seq", "next", out="_n")
    both = asof.step_event(later, points, KEY, "t", "seq", "previous", out="_p")
    return both.select("log_id", "cursor", F.col("_n.t").alias("next_t"), F.col("_p.t").alias("prev_t"))


@query("step_flights", f"""WITH {REGIONS},
c AS (SELECT log_id, t, seq FROM ev WHERE event_type = 'click'),
n AS (SELECT c.log_id, c.seq AS cursor, min(r.t_start) AS next_start FROM c JOIN regions r ON r.log_id = c.log_id AND r.t_start > c.t + 1e-6 GROUP BY 1, 2),
p AS (SELECT c.log_id, c.seq AS cursor, max(r.t_start) AS prev_start FROM c JOIN regions r ON r.log_id = c.log_id AND r.t_start < c.t - 1e-6 GROUP BY 1, 2)
SELECT c.log_id, c.seq AS cursor, n.next_start, p.prev_start FROM c LEFT JOIN n ON n.log_id = c.log_id AND n.cursor = c.seq
LEFT JOIN p ON p.log_id = c.log_id AND p.cursor = c.seq""")
def step_flights(spark, folder):
    from aerolake.plans.timeline import arm_regions
    starts = arm_regions(telemetry(spark, folder, "ARM", "EV"), span(spark, folder)).withColumn("t", F.col("t_start"))
    later = asof.step_event(cursors(spark, folder), starts, KEY, "t", "idx", "next", out="_n")
    both = asof.step_event(later, starts, KEY, "t", "idx", "previous", out="_p")
    return both.select("log_id", "cursor", F.col("_n.t").alias("next_start"), F.col("_p.t").alias("prev_start"))


@query("mode_at", f"""WITH {EV}, {SPAN}, {MODES},
c AS (SELECT log_id, t, seq FROM ev WHERE event_type = 'click'),
h AS (SELECT c.log_id, c.seq AS cursor, m.idx, m.mode, row_number() OVER (PARTITION BY c.log_id, c.seq ORDER BY m.idx) AS r
  FROM c JOIN modes m ON m.log_id = c.log_id AND c.t >= m.t_start AND c.t <= m.t_end)
SELECT c.log_id, c.seq AS cursor, h.idx AS mode_idx, h.mode FROM c LEFT JOIN h ON h.log_id = c.log_id AND h.cursor = c.seq AND h.r = 1""")
def mode_at(spark, folder):
    from aerolake.plans.timeline import mode_segments
    modes = mode_segments(telemetry(spark, folder, "MODE"), span(spark, folder))
    found = intervals.interval_lookup(cursors(spark, folder), modes.withColumnRenamed("idx", "mode_idx"), KEY, "t",
                                      ["mode_idx", "mode"], "mode_idx")
    return found.select("log_id", "cursor", "interval.mode_idx", "interval.mode")


@query("events_in_flights", f"""WITH {REGIONS}, {EVENTS}
SELECT r.log_id, r.idx, count(e.t) AS event_count FROM regions r LEFT JOIN events_all e
  ON e.log_id = r.log_id AND e.t >= r.t_start AND e.t <= r.t_end GROUP BY r.log_id, r.idx""")
def events_in_flights(spark, folder):
    from aerolake.plans.events import EVENT_MESSAGES, flight_events, with_event_position
    from aerolake.plans.timeline import arm_regions
    rows = telemetry(spark, folder, *EVENT_MESSAGES)
    found = with_event_position(flight_events(rows))
    regions = arm_regions(rows, span(spark, folder))
    counted = intervals.count_in_windows(regions, found, KEY, "t", "ord", out="event_count")
    return counted.select("log_id", "idx", "event_count")


@query("modes_in_flights", f"""WITH {REGIONS}, {MODES}
SELECT r.log_id, r.idx, count(DISTINCT m.mode_num) AS mode_count FROM regions r LEFT JOIN modes m
  ON m.log_id = r.log_id AND m.t_start < r.t_end AND m.t_end > r.t_start GROUP BY r.log_id, r.idx""")
def modes_in_flights(spark, folder):
    from aerolake.plans.timeline import arm_regions, mode_segments
    rows, spans = telemetry(spark, folder, "ARM", "EV", "MODE"), span(spark, folder)
    counted = intervals.overlap_distinct(arm_regions(rows, spans), mode_segments(rows, spans), KEY, "idx", "mode_num", "idx", out="mode_count")
    return counted.select("log_id", "idx", "mode_count")


@query("armed_window_mask", f"""WITH {REGIONS}
SELECT log_id, seq, t, value FROM ev e WHERE EXISTS (SELECT 1 FROM regions r WHERE r.log_id = e.log_id AND e.t BETWEEN r.t_start AND r.t_end)""")
def armed_window_mask(spark, folder):
    from aerolake.plans.timeline import arm_regions
    regions = arm_regions(telemetry(spark, folder, "ARM", "EV"), span(spark, folder))
    inside = intervals.within_windows(events(spark, folder), regions, KEY, "t")
    return inside.select("log_id", "seq", "t", "value")


@query("history_window", f"""WITH {EV},
p AS (SELECT c.log_id, c.seq AS cursor, s.seq, s.t, s.value, count(*) OVER (PARTITION BY c.log_id, c.seq) AS n
  FROM ev c JOIN ev s ON s.log_id = c.log_id AND s.t >= c.t - 10 AND s.t <= c.t WHERE c.event_type = 'click' AND s.event_type = 'view')
SELECT log_id, cursor, seq, t, value FROM p WHERE n >= 2""")
def history_window(spark, folder):
    rows = of_type(events(spark, folder), "view").select("log_id", "seq", "t", "value")
    pairs = intervals.windows_around(rows, cursors(spark, folder), KEY, "t", "cursor", 10.0, 0.0)
    sizes = pairs.groupBy("log_id", "cursor_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    kept = pairs.join(sizes, ["log_id", "cursor_id"], "left_semi")
    return kept.select("log_id", F.col("cursor_id").alias("cursor"), "seq", "t", "value")
