"""Append-only edit logs: current heads, replay, undo chains and referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heads(log: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each key the columns of its last row: what an upsert of each row in order leaves."""
    last = log.groupBy(*by).agg(F.max(F.struct(*order, *columns)).alias("_last"))
    return last.select(*by, *(F.col("_last")[c].alias(c) for c in columns))


def replayed(log: DataFrame, by: list[str], order: list[str], kind: Column, value: Column) -> DataFrame:
    """For each key the state (a number or null) and n_applied after its operations in order: set, add, clear.

    set and clear forget what was before, so only what follows the last of them counts: two windows instead of a loop.
    add to nothing starts from 0.
    """
    rows = log.select(*by, *order, kind.alias("_kind"), value.alias("_value"))
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_epoch", F.sum(F.when(F.col("_kind").isin("set", "clear"), 1).otherwise(0)).over(upto))
    whole = Window.partitionBy(*by)
    final = rows.withColumn("_last", F.max("_epoch").over(whole))
    counts = final.groupBy(*by).agg(F.count("*").alias("n_applied"), F.sum(F.when((F.col("_epoch") == F.col("_last")) & F.col("_kind").isin("set", "add"), F.col("_value"))).alias("state"))
    return counts


def effective(log: DataFrame, by: list[str], revision: str, kind: str) -> DataFrame:
    """The rows of a log of edits that still hold where ``undo`` takes back the last edit that holds and ``reset`` all.

    An edit holds if, within its reset epoch, no later depth falls below the one it raised: depth counts edits minus
    undos (undos of nothing don't count).
    """
    upto = Window.partitionBy(*by).orderBy(revision).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumn("_epoch", F.sum(F.when(F.col(kind) == "reset", 1).otherwise(0)).over(upto))
    step = F.when(F.col(kind) == "undo", -1).when(F.col(kind) == "reset", 0).otherwise(1)
    own = Window.partitionBy(*by, "_epoch").orderBy(revision)
    rows = rows.withColumn("_raw", F.sum(step).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    floor = F.least(F.lit(0), F.min("_raw").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_depth", F.col("_raw") - floor)
    later = F.min("_depth").over(own.rowsBetween(1, Window.unboundedFollowing))
    last = F.max("_epoch").over(Window.partitionBy(*by))
    rows = rows.withColumns({"_later": later, "_last": last})
    holds = ~F.col(kind).isin("undo", "reset") & (F.col("_epoch") == F.col("_last")) & (F.col("_later").isNull() | (F.col("_later") >= F.col("_depth")))
    return rows.filter(holds).drop("_epoch", "_raw", "_depth", "_later", "_last")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key is set but names no row of parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def conflicting(df: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Keys that were registered with more than one content."""
    return df.groupBy(*key).agg(F.countDistinct(F.sha2(F.to_json(F.struct(*content)), 256)).alias("n_contents")).filter("n_contents > 1")
