"""A query of noisy views: vectors' first components as points before four cameras in a row, some of which err."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import triangulation
from strandline.plans.base import table


def noisy_points(spark: SparkSession, d: str) -> DataFrame:
    """Views off by up to 1.5 pixels; camera 0 errs on each fifth point, two cameras see another point, or a point has one view.

    Camera 0 errs along the line to camera 1, so that where two cameras see another point these two still agree: a tie.
    """
    v = table(spark, d, "embeddings").filter("vec_id is not null and embedding is not null and size(embedding) >= 3").dropDuplicates(["vec_id"])
    x, y, z = (F.col("embedding")[i].cast("double") for i in range(3))
    cameras = F.array(*(F.struct(F.lit(c).alias("camera"), F.lit(float(t)).alias("t")) for c, t in enumerate((-1.5, -0.5, 0.5, 1.5))))
    views = v.select("vec_id", x.alias("x"), y.alias("y"), (z + 4).alias("z"), F.inline(cameras)).filter("vec_id % 7 <> 2 or camera = 0")
    other = F.when((F.col("vec_id") % 11 == 3) & (F.col("camera") >= 2), 0.5).otherwise(0.0)
    astray = F.when((F.col("vec_id") % 5 == 1) & (F.col("camera") == 0), 60.0).otherwise(0.0)
    noise = lambda k: 1.5 * F.sin(F.col("vec_id") * k + F.col("camera") * 2.4)
    row = F.array(*map(F.lit, (800.0, 0.0, 320.0)), 800.0 * F.col("t"), *map(F.lit, (0.0, 800.0, 240.0, 0.0, 0.0, 0.0, 1.0, 0.0)))
    u = 800 * (F.col("x") + F.col("t")) / F.col("z") + 320 + noise(1.7) + astray
    w = 800 * (F.col("y") + other) / F.col("z") + 240 + noise(0.9)
    found = triangulation.located_points(views.select("vec_id", "camera", u.alias("u"), w.alias("v"), F.lit(1.5).alias("sigma"), row.alias("p")), ["vec_id"])
    truth = v.select("vec_id", x.alias("tx"), y.alias("ty"), (z + 4).alias("tz"))
    off = F.sqrt(sum((F.col(a) - F.col("t" + a)) ** 2 for a in "xyz"))
    both = found.join(truth, "vec_id")
    return both.select("vec_id", F.array_join("used", ",").alias("used"), "reason", (off <= 3 * F.col("sigma")).alias("within"), F.size("residuals").cast("long").alias("n_views"))


QUERIES = {"noisy_points": noisy_points}

ORACLES = {
    "noisy_points": """SELECT DISTINCT vec_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN vec_id % 5 = 1 THEN '1,2,3' ELSE '0,1,2,3' END END AS used,
            CASE WHEN reason IS NULL THEN true END AS "within", CASE WHEN reason IS NULL THEN 4::BIGINT END AS n_views
        FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 2 THEN 'insufficient_independent_views' WHEN vec_id % 11 = 3 THEN 'ambiguous_equal_support_consensus' END AS reason
              FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) >= 3)""",
}
