"""Strict sources: wide detector CSV, content-addressed stores, verified files."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed tokens that stand for a missing value in detector CSV files.
MISSING = ("", "nan", "na", "null")
#: Fixed joints of the wide CSV, in the order of its columns.
JOINTS = ("L_shoulder", "R_shoulder", "L_elbow", "R_elbow", "L_wrist", "R_wrist", "L_hip", "R_hip", "L_knee", "R_knee", "L_ankle", "R_ankle")


def wide_columns() -> list[str]:
    """frame_index, time_ms, then x, y and score of every joint."""
    return ["frame_index", "time_ms", *(f"{joint}_{part}" for joint in JOINTS for part in ("x", "y", "score"))]


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file's rows as text; fails where the header is another one."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in wide_columns()])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def wide_to_long(wide: DataFrame) -> DataFrame:
    """frame_index, time_ms, landmark, x, y, score, problem: a row for each joint.

    Missing tokens become null. problem names a joint that is missing in part, or a score that isn't in [0, 1]; coordinates
    off the frame are kept.
    """
    def number(column: str):
        # all tokens but nan aren't numbers anyway, and nan is the only text of NaN
        return F.nanvl(F.col(column).try_cast("double"), F.lit(None).cast("double"))

    points = F.array(*(F.struct(F.lit(n).alias("landmark"), *(number(f"{n}_{p}").alias(p) for p in ("x", "y", "score"))) for n in JOINTS))
    long = wide.select(F.col("frame_index").cast("long").alias("frame_index"), F.col("time_ms").cast("double").alias("time_ms"), F.inline(points))
    known = sum((F.col(p).isNotNull().cast("int") for p in ("y", "score")), F.col("x").isNotNull().cast("int"))
    problem = F.when(~known.isin(0, 3), "missing_in_part").when(~F.col("score").between(0, 1), "score_out_of_range")
    return long.withColumn("problem", problem)


def digest(identity: dict) -> str:
    """The key of an artifact: SHA-256 of its identity as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def published(spark: SparkSession, root: str, layer: str, identity: dict, produce) -> DataFrame:
    """The table under root/layer=/digest=, made by produce() unless it is there: compute once, write, then rename.

    A writer stages its files beside the target and renames the folder, so readers see all or nothing; the first of two
    writers wins.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/layer={layer}/digest={digest(identity)}")
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        staged = jvm.org.apache.hadoop.fs.Path(f"{root}/.staging/{digest(identity)}-{jvm.java.util.UUID.randomUUID()}")
        produce().write.parquet(staged.toString())
        fs.mkdirs(target.getParent())
        if not fs.rename(staged, target) and not fs.exists(target):
            raise OSError(f"could not publish {target}")
        fs.delete(staged, True)
    return spark.read.parquet(target.toString())


def verified_files(spark: SparkSession, folder: str, receipt: DataFrame) -> DataFrame:
    """path, problem (missing, wrong_size, wrong_hash) of a receipt's files (path below the folder, size, sha256) that aren't as it says; hashes are computed where the files are read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.select(F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/").alias("full"), "length", F.sha2("content", 256).alias("hash"))
    found = found.withColumn("path", F.expr(f"substring(full, {len(re.sub('^[a-z0-9]+:/*', '/', root)) + 2})")).drop("full")
    checked = receipt.join(found, "path", "left")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("size"), "wrong_size").when(F.col("hash") != F.col("sha256"), "wrong_hash")
    return checked.select("path", problem.alias("problem")).filter("problem is not null")


def parse_duration(text):
    """Seconds of H:M:S text (fractions allowed in the seconds); null if it isn't such."""
    part = [F.regexp_extract(text, r"^([0-9]+):([0-5]?[0-9]):([0-5]?[0-9](?:\.[0-9]+)?)$", k).try_cast("double") for k in (1, 2, 3)]
    return part[0] * 3600 + part[1] * 60 + part[2]
