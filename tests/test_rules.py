"""Rules given as rows: the same hits as the written rules, single rules with known answers, and their edges."""

import duckdb
import pytest
from aerolake.plans import health
from aerolake.plans import rules as R
from aerolake.schema import TELEMETRY
from suite import rules as _  # noqa: F401
from suite.fleet import telemetry
from suite.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def row(seq, t, msg="X", instance=None, **reals):
    return ("a", msg, instance, seq, t, {}, reals, {})


def rule(number=1, scope="plain", compare="gt", bound=1.0, share=False, least=None, pick="max", digits=1, msg="X", columns=("V", "W"), more=()):
    return (number, 0, msg, list(columns), scope, compare, bound, share, least, pick, "INFO", "C", "v=", digits, "", list(more))


def hits(spark, rows, *rules):
    found = R.rule_hits(spark.createDataFrame(rows, TELEMETRY), spark.createDataFrame(list(rules), R.RULES))
    return sorted((r.rule, r.t, r.message, r.rule_seq) for r in found.collect())


@pytest.mark.parametrize("name", ["rule_anomalies", "added_rules"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)

    def rounded(rows):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)

    assert rounded(df.select(*columns).collect()) == rounded(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


def test_standard_rules_are_the_written_ones(spark):
    rows = telemetry(spark, FOLDER, "XKF4", "GPS", "VIBE", "BAT", "ERR")
    names = ["log_id", "t", "t_rel", "severity", "category", "message", "rule", "rule_seq"]
    old, new = (sorted((tuple(r) for r in df.select(*names).collect()), key=repr) for df in (health.anomalies(rows), R.rule_hits(rows, R.standard_rules(spark))))
    assert old == new and old


def test_picks_and_comparisons(spark):
    rows = [row(1, 1.0, V=1.0), row(2, 2.0, V=2.0), row(3, 3.0, V=5.0), row(4, 4.0, V=3.0)]
    assert hits(spark, rows, rule(1), rule(2, pick="min"), rule(3, pick="first"), rule(4, compare="ge", pick="first"), rule(5, compare="lt"), rule(6, compare="le", digits=None)) == [
        (1, 2.0, "v=5.0", 0), (2, 2.0, "v=2.0", 0), (3, 2.0, "v=2.0", 0), (4, 1.0, "v=1.0", 0), (6, 1.0, "v=1", 0)]


def test_scopes(spark):
    rows = [row(1, 1.0, instance=1, V=9.0), row(2, 2.0, instance=0, V=0.0), row(3, 3.0, instance=7, V=8.0)]
    assert hits(spark, rows, rule(1, scope="first")) == []  # instance 0 is the first, and meets nothing
    assert hits(spark, rows, rule(2, scope="ranked"), rule(3, scope="each"), rule(4, scope="plain")) == [(2, 1.0, "v=9.0", 2), (3, 1.0, "v=9.0", 1), (3, 3.0, "v=8.0", 7)]


def test_share_of_the_greatest_reading(spark):
    rows = [row(1, 1.0, V=10.0), row(2, 2.0, V=8.0), row(3, 3.0, V=9.0)]
    assert hits(spark, rows, rule(1, compare="lt", bound=0.85, share=True, least=4.0, pick="min"), rule(2, compare="lt", bound=0.85, share=True, least=10.0, pick="min")) == [(1, 2.0, "v=8.0", 0)]


def test_edges(spark):
    rows = [row(1, None, V=9.0), row(2, 2.0, W=4.0), row(3, 3.0, V=None, W=7.0), row(4, 4.0, U=1.0), row(5, 5.0, V=2.0), row(5, 5.0, V=2.0)]
    assert hits(spark, rows, rule(1, pick="every", digits=None, more=[(" u=", ["U"])])) == [(1, 2.0, "v=4 u=?", 2), (1, 5.0, "v=2 u=?", 5), (1, 5.0, "v=2 u=?", 5)]
    assert hits(spark, rows, rule(1, compare=None), rule(2, msg=None), rule(3, pick=None), rule(4, bound=None), rule(5, msg="Y")) == []
    empty = spark.createDataFrame([], TELEMETRY)
    assert R.rule_hits(empty, R.standard_rules(spark)).count() == 0
    assert R.rule_hits(spark.createDataFrame(rows, TELEMETRY), R.standard_rules(spark).limit(0)).count() == 0


def test_rules_beyond_the_broadcast_limit_join_by_message(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_BROADCAST", 1)
    assert hits(spark, [row(1, 1.0, V=2.0)], rule(1), rule(2, pick="min")) == [(1, 1.0, "v=2.0", 0), (2, 1.0, "v=2.0", 0)]
