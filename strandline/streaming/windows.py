"""Windowed aggregates of streams with a watermark; the same calls work on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, by: list[str], time: str, gap: str, late: str) -> DataFrame:
    """by, start, end, n: sessions that end after a pause of ``gap``; rows later than ``late`` behind the newest are left out."""
    window = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(*by, window.alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, by: list[str], time: str, width: str, late: str, value: str) -> DataFrame:
    """by, start, n, total of fixed windows."""
    grouped = events.withWatermark(time, late).groupBy(*by, F.window(time, width).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*by, F.col("w.start").alias("start"), "n", "total")


def once_each(events: DataFrame, ids: list[str], time: str, late: str) -> DataFrame:
    """Events without the ones that arrive again within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)
