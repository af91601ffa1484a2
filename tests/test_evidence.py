"""What is plotted for findings: windows that overlap freely, and the readings in them."""

import random

import duckdb
import pytest

from aerolake.operators.intervals import pairs_in_windows
from aerolake.plans import catalog
from aerolake.schema import TELEMETRY
from suite import exports as _  # noqa: F401
from suite.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["trend_windows", "evidence_readings", "evidence_windows"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    got = sorted(tuple(r) for r in QUERIES[name](spark, FOLDER).select(*columns).collect())
    assert len(want) > 0 and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == pytest.approx(y, abs=1e-8) if isinstance(y, float) else x == y for x, y in zip(a, b))


def test_pairs_equal_brute_force(spark):
    """Windows of all widths, nested, repeated, of one instant, reversed, at negative times and without a border."""
    rng = random.Random(5)
    points = [(rng.choice(["a", "b", None]), i, rng.choice([-3.0, 0.0, 8.0, 16.0]) if i % 9 == 0 else rng.uniform(-50, 9000)) for i in range(600)]
    points += [("a", 600, None), ("hot", 601, 1.0)]
    windows = []
    for n in range(80):
        at, width = rng.uniform(-60, 9000), rng.choice([0.0, 0.01, 1.0, 6.0, 12.0, 700.0, 8999.0, 20000.0, -1.0])
        windows.append((rng.choice(["a", "b", None]), n, at, at + width))
    windows += [("a", 80, 0.0, 8.0), ("a", 81, 0.0, 8.0), ("b", 82, 16.0, 16.0), ("a", 83, None, 5.0), ("nobody", 84, 0.0, 1e4)]
    want = sorted((i, n) for k, i, t in points for q, n, a, b in windows if k == q and t is not None and a is not None and a <= t <= b)
    left = spark.createDataFrame(points, "log_id string, i int, t double")
    right = spark.createDataFrame(windows, "log_id string, n int, a double, b double")
    got = pairs_in_windows(left, right, ["log_id"], "t", "a", "b")
    assert got.columns == ["log_id", "i", "t", "n", "a", "b"]
    assert sorted((r.i, r.n) for r in got.collect()) == want and len(want) > 500
    assert pairs_in_windows(left.limit(0), right, ["log_id"], "t", "a", "b").isEmpty()
    assert pairs_in_windows(left, right.limit(0), ["log_id"], "t", "a", "b").isEmpty()


def test_readings_of_findings_seconds_apart(spark):
    rows = [("a", "ATT", None, i, float(i), {"Flag": i}, {"Roll": i / 2, "Pitch": None}, {}) for i in range(40)]
    rows += [("a", "BARO", 0, 100 + i, 50.0 + i, {}, {"Alt": 1.0}, {}) for i in range(3)] + [("a", "BARO", 0, 200, None, {}, {"Alt": 9.0}, {})]
    telemetry = spark.createDataFrame(rows, TELEMETRY)
    found = spark.createDataFrame([("a", 1, "X", 10.0, ["ATT.Roll", "ATT.Flag"]), ("a", 2, "X", 13.0, ["ATT.Roll"]), ("a", 3, "X", None, ["BARO.Alt", "BARO.Alt"]),
                                   ("a", 4, "X", None, [])], "log_id string, finding_no int, category string, t_start double, evidence array<string>")
    signals = catalog.finding_signals(found, catalog.signal_catalog(telemetry))
    windows = catalog.evidence_windows(found, catalog.signal_spans(telemetry, signals))
    assert {r.finding_no: (r.w_start, r.w_end) for r in windows.collect()} == {1: (4.0, 16.0), 2: (7.0, 19.0), 3: (50.0, 52.0), 4: (0.0, 1.0)}
    got = sorted((r.finding_no, r.col, r.seq, r.value) for r in catalog.evidence_readings(telemetry, signals, windows).collect())
    want = [(1, "Flag", i, float(i)) for i in range(4, 17)] + [(1, "Roll", i, i / 2) for i in range(4, 17)] + [(2, "Roll", i, i / 2) for i in range(7, 20)]
    assert got == want + [(3, "Alt", 100 + i, 1.0) for i in range(3)]
