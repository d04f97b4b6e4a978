"""Edge tables: components by label propagation with stars, ancestors by recursion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.storage import stored


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for the nodes of an undirected edge table.

    Every round each node hooks to the least label around it, and labels jump to their labels' labels, so that the number
    of rounds follows the logarithm of the longest chain.
    """
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = stored(both.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(seen, "node", "left").withColumn("low", F.least("component", "near"))
        moves = hooked.filter("low < component").groupBy(F.col("component").alias("root")).agg(F.min("low").alias("to"))
        parent = hooked.select("node", "low").join(moves, F.col("node") == F.col("root"), "left").select("node", F.least("low", "to").alias("parent"))
        parent = stored(parent)
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        after = stored(parent.join(up, "parent", "left").select("node", F.least("parent", "grand").alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "was"), "node").filter("component <> was").limit(1).count()
        labels = after
        if not changed:
            return labels


def ancestors(edges: DataFrame, child: str, parent: str, depth: int) -> DataFrame:
    """node, ancestor, distance for all ancestors at most ``depth`` steps up, by a recursive query."""
    view = f"edges_{uuid.uuid4().hex}"
    edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).createOrReplaceTempView(view)
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE up(node, ancestor, distance) AS (
            SELECT c, p, 1 FROM {view}
            UNION ALL
            SELECT u.node, e.p, u.distance + 1 FROM up AS u JOIN {view} AS e ON e.c = u.ancestor WHERE u.distance < {int(depth)})
        SELECT node, ancestor, distance FROM up""")
