"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modengine.llm.scratch import saved


def _lowest(directed: DataFrame) -> DataFrame:
    """Each ``u`` with the least of itself and its neighbours; counted in part before the exchange, so a hub is cheap."""
    return directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for each node in ``edges`` (a, b: long): label is the smallest node that it is linked with.

    Each round is a written table, so a lost executor costs no more than the round. No group is gathered: the steps are
    minima and joins on the node, whose large partitions Spark can split.
    """
    current = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = saved(large, "large-star")
        low = _lowest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        current = saved(small.filter("u != v").distinct(), "small-star")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
