"""Identity of every log, from logs that are decoded together."""

import duckdb

import __spark_entry__ as contract
from suite import logs
from aerolake.sources import decode

FOLDER = "/root/testdata/sf0.001"


def test_log_meta_is_its_sql(spark):
    duckdb.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    want = duckdb.execute(contract.oracle_sql()["log_meta"])
    names = [d[0] for d in want.description]
    want = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in want.fetchall())
    found = contract.queries()["log_meta"](spark, FOLDER).select(*names).collect()
    assert sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in found) == want


def test_no_expression_walks_the_maps_of_a_record(spark):
    plan = decode.decode_logs(logs.log_files(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform_values" not in plan and "map_filter" not in plan
