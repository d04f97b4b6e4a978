"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tables import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over pairs (a, b) with a > b: neighbours move to the smallest node that they or their centre know."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    centres = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("centre"), F.least("a", "low").alias("low"))
    moved = both.join(centres, both["a"] == centres["centre"])
    own = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")) if large else own.unionByName(moved.select("a", F.col("low").alias("b")))
    return own.filter(F.col("a") > F.col("b")).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether the pairs are stars: each node hangs on one centre, and no centre hangs on another node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").count() == 0


def stars(edges: DataFrame) -> DataFrame:
    """Stored pairs (a, b) of long ids, a > b, that connect what edges (a, b) connect: b is the smallest node that a reaches.

    A node's edges are never gathered: each round is an aggregate and a join that Spark may split where a centre is hot.
    Each round is stored, so that lost executors cost one round at most. Stars are told by one aggregate, as a round
    that only confirms them takes several joins.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")).distinct())
    while not _done(now):
        before = now
        now = stored(_star(_star(now, True), False))
        drop_stored(before)
    return now


def labels(hung: DataFrame) -> DataFrame:
    """node, component for all nodes of what stars() gives."""
    roots = hung.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return hung.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for all nodes of edges (a, b) of long ids."""
    return labels(stars(edges))
