"""Set operations between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from aerolake.session import cut

#: Buckets of the digest tree, and leaves of each bucket.
DIGEST_BUCKETS = 4096


def union_all(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def minus_keys(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``."""
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def _digested(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_row, _d0, _d1, _b0, _b1): the row, two digests of it, its bucket and the bucket's leaf.

    Spark's hash passes over NULLs, so that every column is hashed with its NULL mark; what is nested goes in as text.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns:
        value = F.col(f"`{name}`")
        parts.append(value.isNull())
        nested = isinstance(kinds[name], (ArrayType, StructType))
        parts.append(F.to_json(F.struct(value), {"ignoreNullFields": "false"}) if nested else value)
    rows = df.select(row.alias("_row"), F.xxhash64(F.lit(0), *parts).alias("_d0"), F.xxhash64(F.lit(1), *parts).alias("_d1"))
    leaf = F.pmod(F.shiftright("_d0", 20), F.lit(DIGEST_BUCKETS))
    return rows.withColumns({"_b0": F.pmod("_d0", F.lit(DIGEST_BUCKETS)), "_b1": leaf})


def differing_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """(_b0, _b1): the leaves of the tree of buckets in which two digested tables differ, as a written table.

    A bucket's checksum is the number of its rows and the sums of their digests, left less right, so that neither
    order nor placing matters and repeated rows count. Buckets are compared first; only rows of those that
    differ, a table of ``DIGEST_BUCKETS`` rows at most, are summed again by leaf.
    """
    whole = "decimal(28,0)"
    sides = []
    for frame, sign in ((left, 1), (right, -1)):
        sums = {f"_s{i}": F.col(f"_d{i}").cast(whole) * F.lit(sign) for i in range(2)}
        sides.append(frame.select("_b0", "_b1", F.lit(sign).alias("_n"), *[v.cast(whole).alias(k) for k, v in sums.items()]))
    both = sides[0].unionByName(sides[1])

    def odd(rows: DataFrame, *by: str) -> DataFrame:
        sums = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("_n", "_s0", "_s1")])
        return cut(sums.where("_n <> 0 OR _s0 <> 0 OR _s1 <> 0").select(*by))

    return odd(both.join(F.broadcast(odd(both, "_b0")), "_b0", "left_semi"), "_b0", "_b1")


def table_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one table but not in the other (multiset, NULL equals NULL), with their side.

    Rows are only shuffled where the checksums of their leaf differ, so that equal tables cost two partial
    aggregates, and a few changed rows cost their leaves. A difference is missed only if two digests of 64 bits agree
    in their sums; rows that are compared are compared as they are.
    """
    columns = left.columns
    sides = [_digested(frame, columns) for frame in (left, right)]
    leaves = differing_leaves(*sides)
    a, b = (frame.join(leaves, ["_b0", "_b1"], "left_semi").select("_row.*") for frame in sides)
    only_left = a.exceptAll(b).withColumn("side", F.lit("left"))
    only_right = b.exceptAll(a).withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def tables_equal(left: DataFrame, right: DataFrame) -> bool:
    if sorted(left.columns) != sorted(right.columns):
        return False
    return table_difference(left, right).isEmpty()
