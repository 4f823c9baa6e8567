"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import one_row, stage


def _state(edges: DataFrame) -> dict:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return one_row(edges.agg(F.count(F.lit(1)).alias("n"), digest.alias("h")))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node that each node of an edge reaches: (node, root).

    Takes (u, v) longs. Rounds of large stars (larger neighbours move to the smallest
    neighbour) and small stars (smaller ones do) until the edges are stars; the
    rounds grow with the logarithm of the longest path. A hub's smallest neighbour
    comes from partial minima; its edges meet that one row in a join whose hot
    partitions Spark splits, as both sides are read from files.
    """
    e = stage(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before, state = None, _state(e)
    while state["n"] and state != before:
        e = _round(e)
        before, state = state, _state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _round(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "least")
    large = both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = stage(large.where("u <> v").distinct(), "large-stars")  # u is larger than v
    least = stage(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "least")
    small = large.join(least, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stage(small.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "small-stars")
