"""The driver's tables as the time series that the catalogue's queries work on, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, us (microseconds), k (from props)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("us"), k.alias("k"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals from their date to their last shipment: o_orderkey, o_custkey, start, end."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(micros("l_shipdate")).alias("end"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", micros("o_orderdate").alias("start")).join(shipped, "o_orderkey").filter("start <= end")


#: The same for DuckDB.
EVENTS = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
ORDERS = """o AS (
    SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS start, s.last AS "end"
    FROM orders JOIN (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS last FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey
    WHERE epoch_us(o_orderdate) <= s.last)"""
