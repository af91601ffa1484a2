"""Timeline, snapshots, RC, trajectory, health and reference tables on fixtures with known answers."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.plans import evidence, health, metrics, snapshot, timeline, trajectory
from aerolake.sources import aviation
from fleet import frame, telemetry


def profile():
    t = np.linspace(0, 60, 601)
    agl = np.interp(t, [0, 5, 15, 45, 55, 60], [0, 0, 20, 20, 0, 0])
    return {"ARM": frame(TimeS=[5.0, 55.0], ArmState=[1, 0]), "MODE": frame(TimeS=[5.0], Mode=[5]), "POS": frame(TimeS=t, RelHomeAlt=agl, Lat=-35.36 + t * 1e-5, Lng=149.16 + t * 0),
            "EV": frame(TimeS=[10.0, 50.0], Id=[10, 11]), "ERR": frame(TimeS=[30.0], Subsys=[11], ECode=[2]),
            "ATT": frame(TimeS=t, Roll=t * 0 + 10, DesRoll=t * 0, Pitch=t * 0, DesPitch=t * 0, Yaw=t * 0 + 359, DesYaw=t * 0 + 1),
            "RCIN": frame(TimeS=t, C1=t * 0 + 1750, C2=t * 0 + 1500, C3=t * 0 + 1500, C4=t * 0 + 1500),
            "GPS[0]": frame(TimeS=t, Status=(t * 0 + 6).astype(int), NSats=(t * 0 + 12).astype(int), Spd=t * 0 + 2.0),
            "XKF4[0]": frame(TimeS=t, SV=t * 0 + 0.1, SP=t * 0 + 0.7, SH=t * 0 + 0.1, SM=t * 0 + 0.1, FS=(t * 0).astype(int)),
            "XKF3[0]": frame(TimeS=t, IPN=t * 0 + 3.0, IPE=t * 0 + 4.0, IPD=t * 0),
            "MSG": frame(TimeS=[1.0, 2.0], Message=["ArduCopter V4.5.1 (abc123)", "Frame: QUAD/X"])}


@pytest.fixture(scope="module")
def rows(spark):
    multi = {"ARM": frame(TimeS=[10.0, 40.0, 60.0, 90.0, 110.0, 140.0], ArmState=[1, 0, 1, 0, 1, 0]), "MODE": frame(TimeS=[0.0, 150.0], Mode=[2, 6])}
    pairs = {"ARM": frame(TimeS=[1.0, 2.0, 3.0], Other=[1, 0, 1]), "MODE": frame(TimeS=[0.0, 9.0], Mode=[0, 99])}
    return telemetry(spark, {"flight": profile(), "multi": multi, "pairs": pairs}).cache()


def test_phases_are_contiguous(rows):
    found = timeline.phases(rows).where("log_id = 'flight'").orderBy("idx").collect()
    kinds = [p.kind for p in found]
    assert kinds[0] == "PRE_ARM" and kinds[-1] == "POST" and "TAKEOFF" in kinds and "HOVER" in kinds and "LAND" in kinds
    assert all(a.t_end == b.t_start for a, b in zip(found, found[1:])) and found[0].t_start == 0 and found[-1].t_end == 60


def test_regions_and_flights(rows):
    regions = {(r.log_id, r.idx): (r.t_start, r.t_end) for r in timeline.arm_regions(rows).collect()}
    assert [regions["multi", i] for i in range(3)] == [(10, 40), (60, 90), (110, 140)]
    assert [regions["pairs", i] for i in range(2)] == [(1, 2), (3, 9)]
    flights = timeline.flight_windows(rows).where("log_id = 'flight'").collect()
    assert len(flights) == 1 and flights[0].peak_agl == pytest.approx(20) and flights[0].mode_count == 1
    assert flights[0].event_count == 6


def test_snapshot_fields(spark, rows):
    marks = spark.createDataFrame([("flight", 1, 30.25)], "log_id string, cursor long, t double")
    s = snapshot.snapshots(rows, marks).collect()[0]
    assert s.event.message == "ERR: GPS code=2" and s.flight_index == 0 and s.flight_total == 1 and s.phase == "HOVER" and s.mode == "LOITER"
    assert s.pilot.roll == pytest.approx(0.5) and s.divergence.yaw == pytest.approx(2.0) and s.divergence.roll == pytest.approx(10.0)
    assert s.ekf.state == "CAUTION" and s.ekf.worst == "SP" and s.position_divergence.value == pytest.approx(5.0)
    assert s.position_divergence.state == "CRITICAL" and s.gps_fix == "RTK_FIXED" and s.gps_sats == 12 and s.altitude_source == "POS.RelHomeAlt"
    assert s.vertical_speed == pytest.approx(0.0) and s.vertical_speed_source == "POS.RelHomeAlt d/dt"
    assert s.provenance["ground_speed"].interpolated and s.provenance["gps_sats"].sample_t == pytest.approx(30.2)
    text = evidence.snapshots_markdown(snapshot.snapshots(rows, marks)).collect()[0].text
    assert "## Snapshot 1 — ERR: ERR: GPS code=2" in text and "| Mode | LOITER |" in text


def test_metrics_health_and_track(rows):
    m = {r.log_id: r for r in metrics.flight_metrics(rows).collect()}
    assert m["flight"].duration_s == 50 and m["flight"].duration_text == "0:50" and m["flight"].max_altitude_m == pytest.approx(20)
    assert m["flight"].distance_m == pytest.approx(66.8, abs=0.2) and m["multi"].duration_s == 130
    h = {r.log_id: r for r in health.health(rows).collect()}
    assert h["flight"].firmware == "ArduCopter V4.5.1" and h["flight"].build == "abc123" and h["flight"].frame == "QUAD/X"
    assert h["flight"].gps_fix == "RTK_FIXED" and h["multi"].gps_status == "NO DATA"
    track = trajectory.best_trajectory(rows).where("log_id = 'flight'")
    assert {r.pos_source for r in track.collect()} == {"POS"} and track.agg(F.max("up")).first()[0] == pytest.approx(20)


def test_aviation_tables(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    with open(f"{folder}/airports.csv", "w") as out:
        out.write("id,ident,type,name,latitude_deg,longitude_deg,elevation_ft\n1,YSSY,large_airport,Sydney,-33.946,151.177,21\n2,XX,heliport,Pad,bad,1,\n")
    with open(f"{folder}/runways.csv", "w") as out:
        out.write("airport_ident,le_ident,he_ident,le_latitude_deg,le_longitude_deg,he_latitude_deg,he_longitude_deg,surface,length_ft\nYSSY,07,25,-33.943,151.164,-33.939,151.19,ASP,8301\nYSSY,16,34,,,1,1,ASP,\n")
    airports, runways = aviation.read_airports(spark, f"{folder}/airports.csv"), aviation.read_runways(spark, f"{folder}/runways.csv")
    points = spark.createDataFrame([("p", -33.95, 151.18)], "id string, lat double, lon double")
    near = aviation.nearest_airport(points, airports, "id").collect()[0]
    assert near.ident == "YSSY" and near.distance_m < 5000
    assert aviation.nearest_runway(points, runways, "id").collect()[0].designator == "07/25" and runways.count() == 1
    assert aviation.read_airports(spark, f"{folder}/none.csv").count() == 0


def test_nearest_places_by_brute_force(spark):
    """Places of every density, equal places and far second runway ends, points without a place near, high latitudes."""
    import math
    import random

    rnd = random.Random(5)
    spots = [(rnd.uniform(-60, -59.9), rnd.uniform(10, 10.1)) for _ in range(60)] + [(rnd.uniform(-63, -57), rnd.uniform(6, 14)) for _ in range(40)]
    spots += [(86 + rnd.random() * 3, rnd.uniform(10, 14)) for _ in range(20)] + [(-60.05, 10.05)] * 5 + [(-59.0, 10.0)]
    strips = [(f"S{i}", "10/28", la, lo, la + rnd.uniform(-0.9, 0.9), lo + rnd.uniform(-0.9, 0.9), i) for i, (la, lo) in enumerate(spots)]
    points = [(i, rnd.uniform(-63, -57), rnd.uniform(6, 14)) for i in range(120)] + [(200 + i, rnd.uniform(-60, -59.9), rnd.uniform(10, 10.1)) for i in range(60)]
    points += [(300 + i, 86 + rnd.random() * 3, rnd.uniform(9, 15)) for i in range(40)] + [(400, -60.05, 10.05), (401, -60.0, 10.0), (402, 0.0, 0.0), (None, -60.05, 10.05), (403, None, 1.0)]

    def gap(p, la, lo):
        return math.hypot(6378137.0 * math.cos(math.radians(p[1])) * math.radians(lo - p[2]), 6378137.0 * math.radians(la - p[1]))

    def nearest(both):
        found = {}
        for p in points:
            if p[1] is not None:
                inside = [s for s in strips if p[1] - 1 <= s[2] <= p[1] + 1 and p[2] - 1 <= s[3] <= p[2] + 1]
                if inside:
                    found[p[0]] = min((min(gap(p, s[2], s[3]), gap(p, s[4], s[5])) if both else gap(p, s[2], s[3]), s[6]) for s in inside)
        return found

    marks = spark.createDataFrame(points, "id int, lat double, lon double")
    runways = spark.createDataFrame(strips, "airport_ident string, designator string, le_lat double, le_lon double, he_lat double, he_lon double, row long")
    airports = runways.selectExpr("airport_ident AS ident", "airport_ident AS name", "le_lat AS lat", "le_lon AS lon", "row")
    for told, both in ((aviation.nearest_airport(marks, airports, "id"), False), (aviation.nearest_runway(marks, runways, "id"), True)):
        assert "BroadcastHashJoin" not in told._jdf.queryExecution().toString()
        rows = {r.id: (r.distance_m, int((r.airport_ident if both else r.ident)[1:])) for r in told.collect()}
        truth = nearest(both)
        assert rows.keys() == truth.keys() and all(rows[i][1] == truth[i][1] and abs(rows[i][0] - truth[i][0]) < 1e-6 for i in truth)
