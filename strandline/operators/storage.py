"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset in local mode, as in tests, a folder beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: an iteration's lineage ends there, and lost executors cost no more than a read."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """names, each with so many underscores before it that no column in taken is called so, whatever its case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out
