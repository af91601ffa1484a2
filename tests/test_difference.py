"""Differences of tables by digests: the rows of a plain comparison, found through few leaves."""

import random

import pytest
from pyspark.sql import functions as F

from aerolake.operators import setops

SCHEMA = "`a.b` int, _b0 string, side2 double, l array<int>, s struct<x:int,y:string>"


def plain(left, right):
    a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def rows_of(df):
    return sorted(map(repr, df.collect()))


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_nulls_repeats_and_nested(spark):
    base = [(1, None, 0.5, [1, None], (1, "p")), (None, "1", 0.5, [None, 1], (None, "1")), (2, "x", float("nan"), None, None), (2, "x", 0.0, [], (1, None))]
    left = make(spark, base * 2 + base[:1])
    others = {
        "same": base * 2 + base[:1], "one copy less": base * 2, "null moved": [(None, "1", 0.5, [1, None], (1, "p"))] + base + base[1:] + base[:1],
        "list turned": [(1, None, 0.5, [None, 1], (1, "p"))] + base + base[1:] + base[:1], "zero signed": base[:3] + [(2, "x", -0.0, [], (1, None))] + base + base[:1], "empty": []}
    for name, rows in others.items():
        right = make(spark, rows)
        got = rows_of(setops.table_difference(left, right))
        assert got == rows_of(plain(left, right)), name
        assert (name in ("same", "zero signed")) == (not got), name
        assert setops.tables_equal(left, right) == (not got)
    assert setops.table_difference(left.limit(0), left.limit(0)).isEmpty()


def test_only_leaves_that_differ_are_compared(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), str(rng.random()), rng.random(), [n], (n, "v")) for n in range(20_000)]
    left = make(spark, rows).repartition(7)
    moved = make(spark, rng.sample(rows, len(rows))).repartition(3)
    digested = lambda df: setops._digested(df, left.columns)
    assert setops.differing_leaves(digested(left), digested(moved)).count() == 0
    changed = make(spark, [(r[0] + 1, *r[1:]) if n in (5, 77) else r for n, r in enumerate(rows)])
    leaves = setops.differing_leaves(digested(left), digested(changed))
    assert 1 <= leaves.count() <= 4
    assert digested(left).join(leaves, ["_b0", "_b1"], "left_semi").count() < 50
    assert rows_of(setops.table_difference(left, changed)) == rows_of(plain(left, changed)) and not setops.tables_equal(left, changed)


def test_other_column_orders_and_types(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([("a", 1), ("c", 2)], "v string, k bigint")
    assert sorted(tuple(r) for r in setops.table_difference(left, right).collect()) == [(2, "b", "left"), (2, "c", "right")]
    assert not setops.tables_equal(left, left.withColumnRenamed("v", "w"))
