"""Connected components of a large graph, by alternating stars.

Every step shuffles on a node and moves one row per edge: large-star links each node's
larger neighbours to its smallest one, small-star its smaller ones.  Both keep the
components; a graph of stars is the fixed point.  Edges are staged after every round and
only their number and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    near = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return near.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge, from edges (a, b) of long ids; the root is the smallest node."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = staged(e, "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        e = staged(_small_star(_large_star(e)), "edges")
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
