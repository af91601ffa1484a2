"""The contract: names agree, and a sample of queries equals its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["armed_signal_stats", "asof_sample", "step_events", "mode_at", "flight_windows", "event_clusters", "anomalies", "best_trajectory",
          "signals_side_by_side", "rc_config", "decode_records", "verification", "finding_signals", "stream_rolling_stats", "stream_arm_regions", "forged_trailers", "keyed_verification"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def check_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(all(map(same, a, b)) for a, b in zip(got, want))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    check_query(spark, duck, name)


def test_lake_reads_the_events_once(spark, monkeypatch):
    """A lake of many messages has the rows of its branches, which read the events of their types only."""
    from pyspark.sql import functions as F
    from suite import fleet
    from suite.reports import REPORT_MESSAGES

    folder, written = "/root/testdata/sf0.001", []
    monkeypatch.setattr(fleet, "cut", lambda df, *by, cut=fleet.cut: written.append(df) or cut(df, *by))
    got, want = fleet.lake(spark, folder, *REPORT_MESSAGES), fleet.telemetry(spark, folder, *REPORT_MESSAGES)
    assert not any(f.endswith("/events.parquet") for f in written[-1].inputFiles()) and got.dtypes == want.dtypes
    texts = [sorted(r[0] for r in rows.select(F.to_json(F.struct("*"))).collect()) for rows in (got, want)]
    assert texts[0] == texts[1] and texts[0]
