"""Scalar expressions, scores, RC, geometry, statistics, reduction and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.functions import columns as C
from aerolake.functions import geo, rc
from aerolake.operators import decimate, folds, segments, setops, stats
from aerolake.plans import catalog as K
from aerolake.plans.analytics import rates, reversal_counts
from aerolake.sources import aviation
from suite.fleet import EV, SPAN, events, of_type, span, telemetry
from suite.registry import query, table

KEY = ["log_id"]


@query("angle_scores", f"""WITH {EV}, a AS (SELECT log_id, seq, (value % 360) - 3.6::DOUBLE * k + 180 AS x, value FROM ev)
, d AS (SELECT *, x - 360 * floor(x / 360) - 180 AS diff FROM a)
SELECT log_id, seq, round(diff, 9) AS diff, CASE WHEN abs(diff) >= 20 THEN 'CRITICAL' WHEN abs(diff) >= 8 THEN 'CAUTION' ELSE 'NOMINAL' END AS band,
  CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 20 THEN 'CAUTION' ELSE 'OK' END AS state,
  round(greatest(0.0, least(100.0, 100.0 * (1.0 - abs(diff) / 180.0))), 6) AS score,
  CASE WHEN 100.0 * (1.0 - abs(diff) / 180.0) >= 90 THEN 'A' WHEN 100.0 * (1.0 - abs(diff) / 180.0) >= 80 THEN 'B' WHEN 100.0 * (1.0 - abs(diff) / 180.0) >= 70 THEN 'C'
    WHEN 100.0 * (1.0 - abs(diff) / 180.0) >= 60 THEN 'D' ELSE 'F' END AS grade FROM d""")
def angle_scores(spark, folder):
    rows = events(spark, folder).withColumn("diff", C.angle_diff(F.col("value") % 360.0, F.lit(3.6) * F.col("k")))
    score = C.linear_score(F.abs("diff"), 180.0)
    return rows.select("log_id", "seq", F.round("diff", 9).alias("diff"), C.delta_band(F.abs("diff"), 8.0, 20.0).alias("band"),
                       C.threshold_state(F.col("value"), 20.0, 100.0).alias("state"), F.round(score, 6).alias("score"), C.letter_grade(score).alias("grade"))


@query("value_texts", """SELECT event_id, CAST(floor(value / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS mmss,
  CASE WHEN value * 1000 > 60000 THEN 'suspect' ELSE 'plain' END AS altitude_kind, CASE WHEN value * 10 >= 1000 THEN 'km' ELSE 'm' END AS distance_unit,
  'V' || CAST(floor(value) AS BIGINT) AS firmware, 'b' || event_id AS build, 'ESC' AS base, CAST(event_id % 16 AS INTEGER) AS inst FROM events""")
def value_texts(spark, folder):
    rows = table(spark, folder, "events")
    version = F.concat(F.lit("V"), F.floor("value").cast("string"), F.lit(" (b"), F.col("event_id").cast("string"), F.lit(")"))
    key = F.concat(F.lit("ESC["), (F.col("event_id") % 16).cast("string"), F.lit("]"))
    return rows.select(
        "event_id", C.minutes_seconds(F.col("value")).alias("mmss"),
        F.when(C.altitude_text(F.col("value") * 1000).contains("suspect"), "suspect").otherwise("plain").alias("altitude_kind"),
        F.when(C.distance_text(F.col("value") * 10).endswith(" km"), "km").otherwise("m").alias("distance_unit"),
        C.firmware_name(version).alias("firmware"), C.firmware_build(version).alias("build"),
        C.signal_base(key).alias("base"), C.signal_instance(key).alias("inst"))


@query("number_texts", """SELECT event_id, CASE WHEN abs(value * 1000) > 60000 THEN '⚠ ' || printf('%.0f', value * 1000) || ' m (suspect)' ELSE printf('%.1f', value * 1000) || ' m' END AS high,
  CASE WHEN abs(value) > 60000 THEN '⚠ ' || printf('%.0f', value) || ' m (suspect)' ELSE printf('%.1f', value) || ' m' END AS low, CASE WHEN value * 10 >= 1000 THEN printf('%.2f', value * 10 / 1000) || ' km' ELSE printf('%.0f', value * 10) || ' m' END AS distance,
  printf('%.1f', value) || ' m/s' AS speed, CASE WHEN event_id % 5 = 0 THEN '—' ELSE printf('%.1f', event_id / 20.0::DOUBLE) || ' m/s' END AS tie, printf('%.2f', -(event_id % 1000) / 200.0::DOUBLE) AS negative FROM events""")
def number_texts(spark, folder):
    """The texts of altitudes, distances and speeds, as they are read; every second one of ``tie`` looks like a tie."""
    value, number = F.col("value"), F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id", C.altitude_text(value * 1000).alias("high"), C.altitude_text(value).alias("low"), C.distance_text(value * 10).alias("distance"),
        C.speed_text(value).alias("speed"), C.speed_text(F.when(number % 5 != 0, number / 20.0)).alias("tie"),
        C.fixed_text(-(number % 1000) / 200.0, 2).alias("negative"))


@query("speed_3d", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 9) AS speed FROM lineitem")
def speed_3d(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(C.speed_3d(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")), 9).alias("speed"))


RC_SQL = f"""WITH {EV}, p AS (SELECT log_id, max(CASE WHEN n = 'RCMAP_ROLL' THEN v END) AS map, max(CASE WHEN n = 'RC1_MIN' THEN v END) AS lo1, max(CASE WHEN n = 'RC1_MAX' THEN v END) AS hi1,
  max(CASE WHEN n = 'RC1_TRIM' THEN v END) AS tr1, max(CASE WHEN n = 'RC1_DZ' THEN v END) AS dz1, max(CASE WHEN n = 'RC1_REVERSED' THEN v END) AS rv1
  FROM (SELECT log_id, n, arg_max(v, seq) AS v FROM (SELECT log_id, seq, CASE k % 8 WHEN 0 THEN 'RCMAP_ROLL' WHEN 1 THEN 'RC1_MIN' WHEN 2 THEN 'RC1_MAX' WHEN 3 THEN 'RC1_TRIM' WHEN 4 THEN 'RC1_DZ'
    WHEN 6 THEN 'RC1_REVERSED' ELSE 'X' END AS n, CAST(CASE k % 8 WHEN 0 THEN 1 + k % 4 WHEN 1 THEN 1000 + k WHEN 2 THEN 1900 + k WHEN 3 THEN 1450 + k WHEN 4 THEN k % 30 ELSE k % 2 END AS DOUBLE) AS v
    FROM ev WHERE event_type = 'signup') GROUP BY log_id, n) GROUP BY log_id),
x AS (SELECT p.*, a.axis, CASE WHEN a.axis = 'roll' THEN coalesce(CAST(map AS INTEGER), 1) WHEN a.axis = 'pitch' THEN 2 WHEN a.axis = 'yaw' THEN 4 ELSE 3 END AS channel
  FROM p CROSS JOIN (VALUES ('roll'), ('pitch'), ('yaw'), ('throttle')) a(axis)),
y AS (SELECT log_id, axis, channel, CASE WHEN channel = 1 THEN coalesce(lo1, 1000) ELSE 1000.0 END AS pmin, CASE WHEN channel = 1 THEN coalesce(hi1, 2000) ELSE 2000.0 END AS pmax,
  CASE WHEN channel = 1 THEN coalesce(tr1, 1500) ELSE 1500.0 END AS ptrim, CASE WHEN channel = 1 THEN coalesce(dz1, 0) ELSE 0.0 END AS dz, CASE WHEN channel = 1 THEN coalesce(rv1, 0) = 1 ELSE FALSE END AS reversed FROM x)
"""


@query("rc_config", RC_SQL + "SELECT * FROM y")
def rc_config(spark, folder):
    from aerolake.plans.health import parameters
    return rc.rc_config(parameters(telemetry(spark, folder, "PARM")), KEY)


@query("stick_positions", RC_SQL + """, w AS (SELECT e.log_id, e.seq, y.axis, 1000.0 + 10 * ((e.k * CASE channel WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 13 ELSE 29 END) % 100) AS pwm, pmin, pmax, ptrim, dz, reversed
  FROM ev e JOIN y ON y.log_id = e.log_id WHERE e.event_type = 'click')
SELECT log_id, seq, axis, pwm, round(CASE WHEN axis = 'throttle' THEN CASE WHEN reversed THEN 1 - greatest(0, least(1, (pwm - pmin) / (pmax - pmin))) ELSE greatest(0, least(1, (pwm - pmin) / (pmax - pmin))) END
  WHEN abs(pwm - ptrim) <= dz THEN 0 ELSE sign(pwm - ptrim) * (CASE WHEN reversed THEN -1 ELSE 1 END) *
    (CASE WHEN (CASE WHEN pwm > ptrim THEN pmax - ptrim ELSE ptrim - pmin END) - dz <= 0 THEN 1 ELSE least(1, (abs(pwm - ptrim) - dz) / ((CASE WHEN pwm > ptrim THEN pmax - ptrim ELSE ptrim - pmin END) - dz)) END) END, 9) AS stick,
  round(CASE WHEN axis = 'throttle' THEN greatest(0, least(1, (pwm - pmin) / (pmax - pmin))) ELSE greatest(-1, least(1, (pwm - ptrim) / ((pmax - pmin) / 2))) END, 9) AS simple FROM w""")
def stick_positions(spark, folder):
    from aerolake.plans.health import parameters
    from aerolake.schema import plain
    rows = plain(telemetry(spark, folder, "RCIN"), "RCIN")
    config = rc.rc_config(parameters(telemetry(spark, folder, "PARM")), KEY)
    joined = rows.join(config, "log_id")
    pwm = F.col("ints")[F.concat(F.lit("C"), F.col("channel").cast("string"))].cast("double")
    c = F.col
    joined = joined.withColumn("pwm", pwm)
    full = rc.stick_position(c("axis"), c("pwm"), c("pmin"), c("pmax"), c("ptrim"), c("dz"), c("reversed"))
    simple = rc.stick_simple(c("axis"), c("pwm"), c("pmin"), c("pmax"), c("ptrim"))
    return joined.select("log_id", "seq", "axis", "pwm", F.round(full, 9).alias("stick"), F.round(simple, 9).alias("simple"))


POSITIONS = """pts AS (SELECT c_custkey AS id, -60 + (c_custkey * 37 % 12000) / 100.0::DOUBLE AS lat, -180 + (c_custkey * 91 % 36000) / 100.0::DOUBLE AS lon FROM customer),
air AS (SELECT s_suppkey AS rid, s_name AS ident, -60 + (s_suppkey * 53 % 1200) / 10.0::DOUBLE AS lat, -180 + (s_suppkey * 77 % 3600) / 10.0::DOUBLE AS lon, s_nationkey FROM supplier)"""


def _points(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(k.alias("id"), (F.lit(-60) + (k * 37 % 12000) / 100.0).alias("lat"), (F.lit(-180) + (k * 91 % 36000) / 100.0).alias("lon"))


def _airports(spark, folder):
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        k.alias("row"), F.col("s_name").alias("ident"), F.col("s_name").alias("name"), (F.lit(-60) + (k * 53 % 1200) / 10.0).alias("lat"),
        (F.lit(-180) + (k * 77 % 3600) / 10.0).alias("lon"),
        F.when(F.col("s_nationkey") % 4 == 0, "small_airport").when(F.col("s_nationkey") % 4 == 1, "medium_airport")
        .when(F.col("s_nationkey") % 4 == 2, "large_airport").otherwise("heliport").alias("kind"))


@query("local_plane", f"""WITH {POSITIONS}, e AS (SELECT id, lat, lon, 6378137.0 * cos(radians(-35.0)) * radians(lon - 149.0) AS east, 6378137.0 * radians(lat + 35.0) AS north FROM pts)
SELECT id, round(east, 3) AS east, round(north, 3) AS north, round(sqrt(east * east + north * north), 3) AS distance, round(-35.0 + degrees(north / 6378137.0), 9) AS lat,
  round(149.0 + degrees(east / (6378137.0 * cos(radians(-35.0)))), 9) AS lon FROM e""")
def local_plane(spark, folder):
    lat0, lon0 = F.lit(-35.0), F.lit(149.0)
    rows = _points(spark, folder)
    rows = rows.withColumns({"east": geo.east_m(F.col("lon"), lat0, lon0), "north": geo.north_m(F.col("lat"), lat0)})
    away = geo.planar_distance(lat0, lon0, F.col("lat"), F.col("lon"))
    return rows.select("id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(away, 3).alias("distance"),
                       F.round(geo.latitude(F.col("north"), lat0), 9).alias("lat"), F.round(geo.longitude(F.col("east"), lat0, lon0), 9).alias("lon"))


@query("map_tiles", f"""WITH {POSITIONS}, x AS (SELECT id, greatest(0, least(255, CAST(trunc((lon + 180.0) / 360.0 * 256) AS BIGINT))) AS x,
  greatest(0, least(255, CAST(trunc((1.0 - asinh(tan(radians(greatest(least(lat, 85.05112878), -85.05112878)))) / pi()) / 2.0 * 256) AS BIGINT))) AS y FROM pts)
SELECT id, x, y, round(x / 256.0::DOUBLE * 360 - 180, 9) AS lon_w, round(degrees(atan(sinh(pi() * (1 - 2.0 * y / 256.0::DOUBLE)))), 9) AS lat_n,
  round((x + 1) / 256.0::DOUBLE * 360 - 180, 9) AS lon_e, round(degrees(atan(sinh(pi() * (1 - 2.0 * (y + 1) / 256.0::DOUBLE)))), 9) AS lat_s FROM x""")
def map_tiles(spark, folder):
    rows = _points(spark, folder).select("id", geo.tile_x(F.col("lon"), 8).alias("x"), geo.tile_y(F.col("lat"), 8).alias("y"))
    rows = rows.withColumn("b", geo.tile_bounds(F.col("x"), F.col("y"), 8))
    return rows.select("id", "x", "y", *[F.round(f"b.{c}", 9).alias(c) for c in ("lon_w", "lat_n", "lon_e", "lat_s")])


@query("tiles_covering", f"""WITH {POSITIONS}, t AS (SELECT id, greatest(0, least(255, CAST(trunc((lon + 180.0) / 360.0 * 256) AS BIGINT))) AS x0,
  greatest(0, least(255, CAST(trunc((lon + 2 + 180.0) / 360.0 * 256) AS BIGINT))) AS x1,
  greatest(0, least(255, CAST(trunc((1.0 - asinh(tan(radians(lat + 1.5::DOUBLE))) / pi()) / 2.0 * 256) AS BIGINT))) AS y0,
  greatest(0, least(255, CAST(trunc((1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * 256) AS BIGINT))) AS y1 FROM pts)
SELECT id, x, y FROM (SELECT id, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM t), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)""")
def tiles_covering(spark, folder):
    rows = _points(spark, folder)
    tiles = geo.tiles_covering(F.col("lon"), F.col("lat"), F.col("lon") + 2, F.col("lat") + 1.5, 8)
    return rows.select("id", F.explode(tiles).alias("_t")).select("id", "_t.x", "_t.y")


NEAR = """, d AS (SELECT p.id, a.ident, a.rid, sqrt((6378137.0 * cos(radians(p.lat)) * radians(a.lon - p.lon)) ** 2 + (6378137.0 * radians(a.lat - p.lat)) ** 2) AS m
  FROM pts p JOIN air a ON a.lat BETWEEN p.lat - 1 AND p.lat + 1 AND a.lon BETWEEN p.lon - 1 AND p.lon + 1)"""


@query("nearest_airport", f"""WITH {POSITIONS}{NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, rid) AS n FROM d)
SELECT id, ident, ident AS name, round(m, 3) AS distance_m FROM r WHERE n = 1""")
def nearest_airport(spark, folder):
    found = aviation.nearest_airport(_points(spark, folder), _airports(spark, folder), "id")
    return found.withColumn("distance_m", F.round("distance_m", 3))


@query("nearest_runway", f"""WITH {POSITIONS}, d AS (SELECT p.id, a.ident, a.rid, least(
    sqrt((6378137.0 * cos(radians(p.lat)) * radians(a.lon - p.lon)) ** 2 + (6378137.0 * radians(a.lat - p.lat)) ** 2),
    sqrt((6378137.0 * cos(radians(p.lat)) * radians(a.lon + 0.02 - p.lon)) ** 2 + (6378137.0 * radians(a.lat + 0.01 - p.lat)) ** 2)) AS m
  FROM pts p JOIN air a ON a.lat BETWEEN p.lat - 1 AND p.lat + 1 AND a.lon BETWEEN p.lon - 1 AND p.lon + 1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, rid) AS n FROM d)
SELECT id, '10/28' AS designator, ident AS airport_ident, round(m, 3) AS distance_m FROM r WHERE n = 1""")
def nearest_runway(spark, folder):
    strips = _airports(spark, folder).select(
        F.col("ident").alias("airport_ident"), F.lit("10/28").alias("designator"), F.col("lat").alias("le_lat"), F.col("lon").alias("le_lon"),
        (F.col("lat") + 0.01).alias("he_lat"), (F.col("lon") + 0.02).alias("he_lon"), "row")
    found = aviation.nearest_runway(_points(spark, folder), strips, "id")
    return found.withColumn("distance_m", F.round("distance_m", 3))


@query("aerodromes_in_box", f"""WITH {POSITIONS} SELECT ident, lat, lon, list_extract(['small_airport', 'medium_airport', 'large_airport'], CAST(s_nationkey % 4 AS INTEGER) + 1) AS kind FROM air
  WHERE s_nationkey % 4 < 3 AND lat BETWEEN -40 AND 40 AND lon BETWEEN -100 AND 120""")
def aerodromes_in_box(spark, folder):
    inside = aviation.in_box(aviation.aerodromes(_airports(spark, folder)), 40, -40, -100, 120)
    return inside.select("ident", "lat", "lon", "kind")


@query("signal_stats", """SELECT l_suppkey, min(l_extendedprice) AS v_min, max(l_extendedprice) AS v_max, round(avg(l_extendedprice), 4) AS v_mean, round(stddev_pop(l_extendedprice), 4) AS v_std,
  count(*) AS n FROM lineitem GROUP BY l_suppkey""")
def signal_stats(spark, folder):
    found = stats.signal_stats(table(spark, folder, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return found.withColumns({"v_mean": F.round("v_mean", 4), "v_std": F.round("v_std", 4)})


@query("event_density", f"""WITH {EV}, {SPAN}, v AS (SELECT log_id, t_first AS a, t_last AS b FROM span),
c AS (SELECT e.log_id, least(CAST(floor((e.t - v.a) / ((v.b - v.a) / 24)) AS INTEGER), 23) AS bin, count(*) AS n FROM ev e JOIN v ON v.log_id = e.log_id AND e.t >= v.a AND e.t <= v.b WHERE v.b > v.a GROUP BY 1, 2)
SELECT v.log_id, CAST(r.i AS INTEGER) AS bin, coalesce(c.n, 0) AS n FROM v CROSS JOIN range(24) r(i) LEFT JOIN c ON c.log_id = v.log_id AND c.bin = r.i""")
def event_density(spark, folder):
    views = span(spark, folder).select("log_id", F.col("t_first").alias("view_start"), F.col("t_last").alias("view_end"))
    return stats.density(events(spark, folder), views, KEY, "t", 24)


@query("decimate_even", f"""WITH {EV}, a AS (SELECT log_id, seq, row_number() OVER (PARTITION BY log_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY log_id) AS n FROM ev),
p AS (SELECT DISTINCT s.log_id, CAST(trunc(CASE WHEN j = 19 THEN n - 1 ELSE j * ((n - 1) / 19.0::DOUBLE) END) AS BIGINT) AS i FROM (SELECT DISTINCT log_id, n FROM a) s CROSS JOIN range(20) r(j))
SELECT a.log_id, a.seq FROM a WHERE n <= 20 OR EXISTS (SELECT 1 FROM p WHERE p.log_id = a.log_id AND p.i = a.i)""")
def decimate_even(spark, folder):
    return decimate.decimate_even(events(spark, folder).select("log_id", "seq"), KEY, ["seq"], 20)


@query("decimate_stride", f"""WITH {EV}, a AS (SELECT log_id, seq, row_number() OVER (PARTITION BY log_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY log_id) AS n FROM ev)
SELECT log_id, seq FROM a WHERE n <= 20 OR i % (n // 20) = 0""")
def decimate_stride(spark, folder):
    return decimate.decimate_stride(events(spark, folder).select("log_id", "seq"), KEY, ["seq"], 20)


@query("decimate_peaks", f"""WITH {EV}, {SPAN}, b AS (SELECT e.log_id, e.t, e.value, coalesce(least(CAST(floor((e.t - s.t_first) / ((s.t_last - s.t_first) / 16)) AS INTEGER), 15), 0) AS bucket
  FROM ev e JOIN span s ON s.log_id = e.log_id AND e.t BETWEEN s.t_first AND s.t_last),
r AS (SELECT *, row_number() OVER (PARTITION BY log_id, bucket ORDER BY value, t) AS lo, row_number() OVER (PARTITION BY log_id, bucket ORDER BY value DESC, t) AS hi FROM b)
SELECT log_id, bucket, max(CASE WHEN lo = 1 THEN value END) AS v_min, max(CASE WHEN lo = 1 THEN t END) AS t_min, max(CASE WHEN hi = 1 THEN value END) AS v_max, max(CASE WHEN hi = 1 THEN t END) AS t_max FROM r GROUP BY 1, 2""")
def decimate_peaks(spark, folder):
    views = span(spark, folder).select("log_id", F.col("t_first").alias("view_start"), F.col("t_last").alias("view_end"))
    return decimate.decimate_peaks(events(spark, folder), KEY, "t", "value", views, 16)


@query("event_clusters", f"""WITH RECURSIVE {EV}, {SPAN}, e AS (SELECT v.log_id, v.t, row_number() OVER (PARTITION BY v.log_id ORDER BY v.t, v.seq) AS n,
  100 + (v.t - s.t_first) / (s.t_last - s.t_first) * 900 AS x, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS rank
  FROM ev v JOIN span s ON s.log_id = v.log_id AND v.t BETWEEN s.t_first AND s.t_last),
w AS (SELECT log_id, t, n, x, rank, x AS anchor, n AS a FROM e WHERE n = 1 UNION ALL
  SELECT e.log_id, e.t, e.n, e.x, e.rank, CASE WHEN e.x - w.anchor > 11 THEN e.x ELSE w.anchor END, CASE WHEN e.x - w.anchor > 11 THEN e.n ELSE w.a END FROM w JOIN e ON e.log_id = w.log_id AND e.n = w.n + 1)
SELECT log_id, round(avg(t), 7) AS t, count(*) AS n, max(rank) AS rank, min(t) AS t_first FROM w GROUP BY log_id, a""")
def event_clusters(spark, folder):
    views = span(spark, folder).select("log_id", F.col("t_first").alias("view_start"), F.col("t_last").alias("view_end"))
    rows = events(spark, folder).withColumn("rank", F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0))
    found = folds.cluster_events(rows, views, KEY, "t", "seq", "rank", 100.0, 1000.0)
    return found.withColumn("t", F.round("t", 7))


@query("thin_min_spacing", f"""WITH RECURSIVE {EV}, e AS (SELECT log_id, seq, t, row_number() OVER (PARTITION BY log_id ORDER BY t, seq) AS n FROM ev),
w AS (SELECT log_id, seq, t, n, t AS kept, TRUE AS keep FROM e WHERE n = 1 UNION ALL
  SELECT e.log_id, e.seq, e.t, e.n, CASE WHEN e.t - w.kept >= 2.0 THEN e.t ELSE w.kept END, e.t - w.kept >= 2.0 FROM w JOIN e ON e.log_id = w.log_id AND e.n = w.n + 1)
SELECT log_id, seq, t FROM w WHERE keep""")
def thin_min_spacing(spark, folder):
    return folds.thin_min_spacing(events(spark, folder).select("log_id", "seq", "t"), KEY, "t", ["t", "seq"], 2.0)


@query("rate_reversals", f"""WITH {EV}, d AS (SELECT log_id, seq, t, (value - lag(value) OVER w) / (t - lag(t) OVER w) AS rate FROM ev WINDOW w AS (PARTITION BY log_id ORDER BY t, seq)),
s AS (SELECT log_id, sign(rate) AS s, lag(sign(rate)) OVER (PARTITION BY log_id ORDER BY t, seq) AS p FROM d WHERE abs(rate) > 0.05)
SELECT log_id, count(*) FILTER (WHERE s <> p) AS reversals FROM s GROUP BY log_id""")
def rate_reversals(spark, folder):
    return reversal_counts(rates(events(spark, folder), KEY, "value"), KEY)


@query("distinct_positions", f"""WITH {EV}, a AS (SELECT log_id, seq, k % 3 AS p, lag(k % 3) OVER (PARTITION BY log_id ORDER BY seq) AS q FROM ev)
SELECT log_id, seq, p FROM a WHERE q IS NULL OR p <> q""")
def distinct_positions(spark, folder):
    rows = events(spark, folder).select("log_id", "seq", (F.col("k") % 3).alias("p"))
    return segments.drop_repeats(rows, KEY, ["seq"], ["p"])


CATALOG = f"""{EV}, sig AS (SELECT DISTINCT log_id, g AS "group", msg, CAST(inst AS INTEGER) AS "instance", msg || CASE WHEN inst IS NULL THEN '' ELSE '[' || inst || ']' END AS key, col, unit
  FROM ev JOIN (VALUES ('view', 'ATTITUDE', 'ATT', NULL, 'Roll', 'deg'), ('view', 'ATTITUDE', 'ATT', NULL, 'DesRoll', 'deg'), ('view', 'ATTITUDE', 'ATT', NULL, 'Pitch', 'deg'),
    ('view', 'ATTITUDE', 'ATT', NULL, 'DesPitch', 'deg'), ('view', 'ATTITUDE', 'ATT', NULL, 'Yaw', 'deg'), ('view', 'ATTITUDE', 'ATT', NULL, 'DesYaw', 'deg'),
    ('view', 'OTHER', 'MODE', NULL, 'Mode', ''), ('error', 'POWER', 'BAT', NULL, 'Volt', 'V'), ('error', 'POWER', 'BAT', NULL, 'Curr', 'A'),
    ('click', 'BARO', 'BARO', 0, 'Alt', 'm'), ('click', 'BARO', 'BARO', 0, 'CRt', '')) m(et, g, msg, inst, col, unit) ON m.et = ev.event_type)"""
CATALOG_MESSAGES = ("ATT", "MODE", "BAT", "BARO")


@query("signal_catalog", f"WITH {CATALOG} SELECT * FROM sig")
def signal_catalog(spark, folder):
    return K.signal_catalog(telemetry(spark, folder, *CATALOG_MESSAGES))


@query("message_keys", f"WITH {CATALOG} SELECT log_id, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM sig GROUP BY log_id")
def message_keys(spark, folder):
    return K.message_keys(telemetry(spark, folder, *CATALOG_MESSAGES)).withColumn("keys", F.concat_ws(",", "keys"))


@query("signal_search", f"WITH {CATALOG} SELECT * FROM sig WHERE contains(lower(key || '.' || col), 'att.des')")
def signal_search(spark, folder):
    return K.search_signals(K.signal_catalog(telemetry(spark, folder, *CATALOG_MESSAGES)), " ATT.Des ")


@query("ungrouped_messages", f"WITH {CATALOG} SELECT DISTINCT log_id, msg FROM sig WHERE msg = 'MODE'")
def ungrouped_messages(spark, folder):
    return K.ungrouped_messages(telemetry(spark, folder, *CATALOG_MESSAGES))


@query("signals_side_by_side", f"""WITH {EV}, a AS (SELECT log_id, t, value, row_number() OVER (PARTITION BY log_id ORDER BY t, seq) AS "row" FROM ev WHERE event_type = 'view' AND t BETWEEN 50 AND 150),
b AS (SELECT log_id, t, value, row_number() OVER (PARTITION BY log_id ORDER BY t, seq) AS "row" FROM ev WHERE event_type = 'error' AND t BETWEEN 50 AND 150)
SELECT coalesce(a.log_id, b.log_id) AS log_id, coalesce(a."row", b."row") AS "row", a.t AS view_t, a.value AS "view", b.t AS error_t, b.value AS error FROM a FULL JOIN b ON a.log_id = b.log_id AND a."row" = b."row" """)
def signals_side_by_side(spark, folder):
    rows = of_type(events(spark, folder), "view", "error").withColumn("key", F.col("event_type"))
    views = rows.select("log_id").distinct().withColumns({"view_start": F.lit(50.0), "view_end": F.lit(150.0)})
    return K.visible_signals_table(rows.select("log_id", "key", "seq", "t", "value"), views, ["view", "error"])


@query("table_difference", """SELECT c_custkey, c_name, 'left' AS side FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey, c_name || '!', 'right' FROM customer WHERE c_custkey % 10 = 0""")
def table_difference(spark, folder):
    left = table(spark, folder, "customer").select("c_custkey", "c_name")
    changed = F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    return setops.table_difference(left, left.withColumn("c_name", changed))


@query("verification_states", """WITH s AS (SELECT event_id, list_extract(['VERIFIED', 'PARTIAL', 'TAMPERED', 'NOT_LOADED', 'KEY_MISMATCH', 'other', 'UNSIGNED'], CAST(event_id % 7 AS INTEGER) + 1) AS raw, event_id % 4 AS chunks FROM events),
n AS (SELECT *, CASE raw WHEN 'TAMPERED' THEN 'INVALID' WHEN 'NOT_LOADED' THEN 'UNKNOWN' WHEN 'KEY_MISMATCH' THEN 'WRONG_KEY' WHEN 'other' THEN 'UNKNOWN' ELSE raw END AS state FROM s)
SELECT event_id, state, CASE state WHEN 'WRONG_KEY' THEN 'WRONG KEY' ELSE state END AS label, CASE state WHEN 'VERIFIED' THEN 'good' WHEN 'PARTIAL' THEN 'warn' WHEN 'UNSIGNED' THEN 'neutral'
  WHEN 'INVALID' THEN 'bad' WHEN 'UNKNOWN' THEN 'muted' ELSE 'warn' END AS tone,
  CASE WHEN chunks > 0 THEN chunks || ' SHA-256 hash-chain chunks validated. | ' WHEN state = 'UNSIGNED' THEN 'No signature structures present. | ' ELSE '' END
  || CASE WHEN chunks = 3 THEN 'END record present.' ELSE 'END record not present.' END || CASE state WHEN 'VERIFIED' THEN ' | Ed25519 signature valid.'
  WHEN 'PARTIAL' THEN ' | Final Ed25519 signature unavailable (log not closed).' WHEN 'INVALID' THEN ' | Signature / hash-chain validation failed.'
  WHEN 'WRONG_KEY' THEN ' | Key fingerprint does not match this log.' WHEN 'UNKNOWN' THEN ' | Signature not checked — no public key loaded.' ELSE '' END AS basis FROM n""")
def verification_states(spark, folder):
    names = F.array(*[F.lit(n) for n in ("VERIFIED", "PARTIAL", "TAMPERED", "NOT_LOADED", "KEY_MISMATCH", "other", "UNSIGNED")])
    rows = table(spark, folder, "events").select("event_id", F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("raw"), (F.col("event_id") % 4).alias("chunks"))
    state = F.col("raw")
    basis = C.verification_basis(state, F.col("chunks"), F.lit(True), F.col("chunks") == 3, F.lit("SHA-256 + Ed25519"))
    return rows.select("event_id", C.normal_state(state).alias("state"), C.state_fact(state, "label").alias("label"), C.state_fact(state, "tone").alias("tone"),
                       F.concat_ws(" | ", basis).alias("basis"))
