"""Pages of ordered entities and choices from ranked ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, order: str, cursor: int | None, size: int) -> DataFrame:
    """The first ``size`` rows after the cursor; one more than a page tells whether there is another."""
    rows = df if cursor is None else df.filter(F.col(order) > cursor)
    return rows.orderBy(order).limit(size)


def byte_page(df: DataFrame, by: list[str], order: str, body: str, most: int, cursor: Column | None = None) -> DataFrame:
    """Each key's page after the cursor: rows in order until the next one would make more than ``most`` bytes of bodies.

    next_cursor is the order of the page's last row, null where nothing follows. A body that is larger by itself raises.
    """
    size = F.coalesce(F.octet_length(body), F.lit(0))
    checked = F.when(size > most, F.raise_error(F.concat(F.lit("individual entity exceeds response bound: "), F.col(order).cast("string"))).cast("int")).otherwise(size)
    rows = df if cursor is None else df.filter(F.col(order) > cursor)
    in_order = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumns({"_upto": F.sum(checked).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_next": F.lead(checked).over(in_order)})
    page = rows.filter(F.col("_upto") <= most)
    last = F.when(F.col("_next").isNotNull() & (F.col("_upto") + F.col("_next") > most), F.col(order))
    return page.withColumn("next_cursor", F.max(last).over(Window.partitionBy(*by))).drop("_upto", "_next")


def top_with_margin(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """Each key's best row and its margin over the second; null where there is none."""
    ranked = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    rows = df.withColumns({"_rank": F.row_number().over(ranked), "_next": F.lead(score).over(ranked)})
    return rows.filter("_rank = 1").withColumn("margin", F.col(score) - F.col("_next")).drop("_rank", "_next")


def even_sample(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """n rows of each key at even places of its order, first and last among them; all rows if there are no more."""
    in_order = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumns({"_at": F.row_number().over(in_order) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    # place k is floor(k * (_n - 1) / (n - 1) + 1/2): a row is taken if some k gives its number
    k = F.ceil((F.col("_at") - 0.5) * (n - 1) / (F.col("_n") - 1))
    hit = F.floor(k * (F.col("_n") - 1) / (n - 1) + 0.5) == F.col("_at")
    return rows.filter((F.col("_n") <= n) | hit).drop("_at", "_n")
