"""Connected components of an edge table, with no component ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.sources.scratch import materialise


def _linked(edges: DataFrame) -> DataFrame:
    """Each edge as (u, v) with the smaller end second."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return pairs.filter("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v): the smallest node that can be reached.

    Every round hooks each node, and its neighbours, to the smallest neighbour known, first over all
    neighbours and then over the smaller ones; stars remain after a number of rounds that
    grows with the logarithm of the longest path. A round is two grouped minima and two joins
    on the edge table, which Spark splits where a centre is hot; it is written once, so lost
    executors cost a round at most. Null ends are ignored; no edges give no rows.
    """
    current = materialise(_linked(edges.filter("u is not null and v is not null")), "edges")
    for _ in range(rounds):
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _linked(large.unionAll(least.filter("u > m").select("u", F.col("m").alias("v"))))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(_linked(small.unionAll(lowest.select("u", F.col("m").alias("v")))), "edges")
        # a star forest: no parent has a parent
        parents = after.select(F.col("v").alias("u")).distinct()
        deep = after.join(parents, "u", "left_semi").isEmpty()
        several = after.groupBy("u").count().filter("count > 1").isEmpty()
        current = after
        if deep and several:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
