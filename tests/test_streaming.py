"""Streams give what the batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import machines
from strandline.streaming import latch, windows


def test_latch_as_stream(spark, tmp_path):
    rows = [(i % 2, i * 10, float((i * 7) % 13), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t long, h double, id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = latch.latched(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "t", "h", "id", 4.0, 8.0, 20, 20, 1000)
    query = stream.writeStream.format("memory").queryName("latch_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = machines.latched(df, ["k"], "t", "h", 4.0, 8.0, 20, 20, 1000, "id")
    assert sorted(map(tuple, spark.table("latch_out").select("id", "state").collect())) == sorted(map(tuple, batch.select("id", "state").collect()))


def test_sessions_as_stream_hold_back_the_open_ones(spark, tmp_path):
    df = spark.createDataFrame([(u, u * 7 + 100 * (i // 3) + i) for u in range(3) for i in range(12)], "u int, s long").withColumn("at", F.timestamp_seconds("s"))
    expected = {(r.u, r.n) for r in windows.sessions(df, ["u"], "at", "20 seconds", "0 seconds").collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["u"], "at", "20 seconds", "0 seconds")
    query = stream.writeStream.format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r.u, r.n) for r in spark.table("sessions_out").collect()}
    assert found <= expected and found
