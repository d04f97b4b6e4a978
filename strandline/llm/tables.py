"""Small helpers on DataFrames shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset in local mode, as in tests, a folder beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder as Parquet and read again: cuts lineage and survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so once the JVM has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def drop_stored(*frames: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % F.lit(modulus)


def free_name(name: str, taken: list[str]) -> str:
    """name, or with so many underscores before it that no column in taken is called so, whatever its case."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name
