"""Connected components of a link table by repeated minima, without any list of links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the root is the smallest node of the component.

    Large-star and small-star rounds: a link to a larger neighbour moves to the smallest one, then a link to a
    smaller neighbour does. Links only become fewer; rounds are logarithmic in the number of nodes, and a node
    with very many links is a partial minimum before anything is shuffled.
    """
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        links = _star(_star(links, True), False)
        links = cut(links)
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before:
            break
        before = (state.n, state.h)
    roots = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half round on links (a, b) with a > b."""
    if large:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("low")).withColumn("low", F.least("c", "low"))
    joined = near.join(least, F.col("u") == F.col("c"))
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()
