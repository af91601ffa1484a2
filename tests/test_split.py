"""Size changes speed, never answers: plain and split plans give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from aerolake.operators import asof, folds
from aerolake.operators.ordered import Ordered
from test_suite import FOLDER, check_query, duck  # noqa: F401

ROW_ORDER = ["asof_linear", "asof_hold", "nearest_event_within", "arm_regions", "mode_segments", "flight_windows", "event_clusters", "thin_min_spacing",
             "decimate_peaks", "armed_window_mask", "step_events", "smoothness", "landing", "rate_reversals", "distinct_positions"]


@pytest.mark.parametrize("name", ROW_ORDER)
def test_query_in_the_split_plan(spark, duck, small_tasks, name):  # noqa: F811
    check_query(spark, duck, name)


def rows_with_gaps(spark, n=300):
    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "hot", "cold"]), None if rng.random() < 0.2 else float(rng.randrange(12)), None if rng.random() < 0.1 else rng.randrange(3), i, rng.random())
            for i in range(n)]
    return spark.createDataFrame(rows, "k string, t double, kind int, seq long, v double")


@pytest.mark.parametrize("order", [["t", "seq"], ["t", "kind", "seq"]])
def test_null_times_come_first_in_both_plans(spark, small_tasks, order):
    df = rows_with_gaps(spark)
    asked = {"prev": {"p": F.col("v")}, "next": {"n": F.col("v")}, "last": {"l": F.when(F.col("v") > 0.6, F.col("v"))}, "following": {"f": F.when(F.col("v") > 0.6, F.col("v"))},
             "position": "at", "running": {"m": ("max", F.col("v"))}}
    plain, split = (sorted(map(tuple, Ordered(df, ["k"], order, s).add(**asked).collect()), key=repr) for s in (False, True))
    assert plain == split


def test_an_instant_is_cut_by_any_order_column(spark, small_tasks):
    """One time, two kinds, many rows: no piece may keep more than a few tasks' worth of rows."""
    df = spark.range(400).select(F.lit("a").alias("k"), F.lit(5.0).alias("t"), (F.col("id") % 2).cast("int").alias("kind"), F.col("id").alias("seq"))
    pieces = Ordered(df, ["k"], ["t", "kind", "seq"], True).hot.groupBy("_cell", "_sub", "_deep").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert pieces[0] <= 60 and pieces[1] >= 8


def test_only_hot_keys_are_split(spark, small_tasks):
    df = rows_with_gaps(spark)
    hot = Ordered(df.where("k = 'hot' or seq < 40"), ["k"], ["t", "seq"], True)
    assert {r.k for r in hot.hot.select("k").distinct().collect()} == {"hot"} and {r.k for r in hot.df.select("k").distinct().collect()} == {"cold"}


def test_as_of_with_null_times(spark, small_tasks):
    df = rows_with_gaps(spark)
    marks = df.select("k", "t", F.col("seq").alias("cid"))
    plain, split = (sorted(map(tuple, asof.bracket(marks, df, ["k"], "t", "seq", ["v"], split=s).collect()), key=repr) for s in (False, True))
    assert plain == split


@pytest.mark.parametrize("split", [False, True])
def test_null_keys_form_one_chain(spark, small_tasks, split):
    rows = [(None, float(x), i) for i, x in enumerate((0, 1, 2, 20, 21, 40))] + [(2**60 + 1, 0.0, 10), (2**60 + 2, 1.0, 11)]
    df = spark.createDataFrame(rows, "k long, x double, seq long").withColumn("extra", F.array(F.lit(None).cast("int")))
    found = folds.greedy_anchors(df, ["k"], "x", ["x", "seq"], 11.0, split=split)
    assert sorted(r.seq for r in found.where("is_anchor").collect()) == [0, 3, 5, 10, 11] and found.count() == 8
    assert found.schema["extra"].dataType == df.schema["extra"].dataType
