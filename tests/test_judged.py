"""The parts that findings are judged by: what several of them read is written once."""

import duckdb

from aerolake.plans import analytics
from suite import reports
from test_suite import FOLDER, TABLES, check_query


def test_shared_series_are_written_once(spark, monkeypatch):
    """Attitude errors and sticks reach every part that reads them as written tables, and the findings equal their SQL."""
    plans = []

    def noted(name, at):
        whole = getattr(analytics, name)

        def run(*args, **options):
            plans.extend(args[i]._jdf.queryExecution().optimizedPlan().toString() for i in at)
            return whole(*args, **options)

        monkeypatch.setattr(reports.A, name, run)

    for name, at in (("tracking", [0]), ("smoothness", [0]), ("yaw_discipline", [0, 1])):
        noted(name, at)
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    check_query(spark, duck, "first_findings")
    assert len(plans) == 4 and not any("Join" in plan for plan in plans)
