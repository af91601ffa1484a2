"""Decimal texts equal those of exact arithmetic."""

import random

from pyspark.sql import functions as F

from aerolake.functions import columns as C


def test_fixed_text_is_exact(spark):
    rng = random.Random(4)
    values = [0.0, 0.5, 1.5, 2.5, 0.25, 0.35, 0.05, 0.15, 0.125, 0.375, 1.005, 2.675, 9.995, 99.95, 0.04, 5e-324, 1e-9, 1e-3, 59999.95, 2.0**52 + 1, 1e17]
    values += [n / 200 for n in range(400)] + [rng.uniform(0, 10 ** rng.randrange(-3, 9)) for _ in range(400)] + [round(rng.uniform(0, 500), 3) for _ in range(400)]
    values += [-v for v in values if v]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    kinds = [(0, False), (1, False), (2, False), (3, True)]
    got = rows.select("v", *[C.fixed_text(F.col("v"), d, p).alias(f"t{d}") for d, p in kinds]).collect()
    for r in got:
        for d, p in kinds:
            assert r[f"t{d}"] == f"{r.v:{'+' if p else ''}.{d}f}", (r.v, d)


def test_missing_and_endless_numbers(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double")
    got = [r[0] for r in rows.select(C.speed_text(F.col("v"))).collect()]
    assert got[0] == "—" and got[1] == "NaN m/s" and got[2] == "Infinity m/s"
