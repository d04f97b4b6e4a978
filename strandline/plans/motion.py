"""Queries of regularised motion and rotations: users are bodies, whose clocks run 86,400 times as fast, so that days are seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import motion, poses
from strandline.plans.base import EVENTS, events, table

MOTION = motion.MotionConfig(filter_window=4_000_000, derivative_window=3_000_000, max_interval=1_500_000, short_gap=0, max_uncertainty=5.0, max_angle_uncertainty=0.5, floor=0.05)


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "signup", "interpolated").when(F.col("event_type") == "click", "inferred").otherwise("observed")
    return events(spark, d).withColumns({"fast": F.floor(F.col("us") / 86_400), "state": state})


def regular_motion(spark: SparkSession, d: str) -> DataFrame:
    rows = _bodies(spark, d).withColumns({"at": F.array(F.col("value") / 100, F.col("k") / 100.0, F.lit(1.0)), "sigma": F.col("k") / 100.0})
    out = motion.regularised(rows, ["user_id"], "fast", "at", "sigma", "state", MOTION)
    return out.select("event_id", "smooth_state", F.round(F.get("smooth", F.lit(0)), 6).alias("x"), F.round(F.get("smooth", F.lit(1)), 6).alias("y"), F.round("smooth_sigma", 6).alias("sigma"))


def angular_velocity(spark: SparkSession, d: str) -> DataFrame:
    half = F.col("value") / 60
    turn = F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))
    rows = _bodies(spark, d).withColumns({"turn": F.when(F.col("k") % 19 > 0, turn), "sigma": F.col("k") / 180.0})
    out = motion.angular_derivatives(rows, ["user_id"], "fast", "turn", "sigma", "state", MOTION)
    return out.select("event_id", "n_support", F.round(F.get("velocity", F.lit(2)), 2).alias("velocity"), F.round(F.get("acceleration", F.lit(2)), 1).alias("acceleration"), F.round("velocity_sigma", 2).alias("sigma"))


def fitted_bones(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as forearms, pulled to lengths that are some hundredths off."""
    v = table(spark, d, "embeddings").filter("embedding is not null and size(embedding) >= 6").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    gap = F.sqrt(sum(((F.col("e")[j + 3] - F.col("e")[j]) ** 2 for j in range(3)), F.lit(0.0)))
    v = v.withColumns({"gap": gap, "length": gap * (1 + 0.02 * F.sin("vec_id"))}).filter("gap > 0")
    ends = F.array(*(F.struct(F.lit(n).alias("name"), *(F.col("e")[k + j].alias(c) for j, c in enumerate("xyz")), (F.col("gap") * share).alias("sigma")) for n, k, share in (("elbow", 0, 0.01), ("wrist", 3, 0.02))))
    lengths = v.select("vec_id", F.lit("forearm").alias("bone"), F.lit("elbow").alias("a"), F.lit("wrist").alias("b"), "length", (F.col("gap") * 0.03).alias("sigma"))
    out = poses.fitted(v.select("vec_id", F.inline(ends)), lengths, ["vec_id"], ["vec_id"])
    return out.select("vec_id", "status", F.inline("points")).select("vec_id", "status", "name", *(F.round(c, 7).alias(c) for c in "xyz"), F.round("moved", 7).alias("moved"))


QUERIES = {f.__name__: f for f in (regular_motion, angular_velocity, fitted_bones)}


def _windows(known: str, sigma: str, radius: float, columns: str) -> str:
    """Samples with their run, pairs within a radius, and their weights."""
    return f"""{EVENTS}, b AS (SELECT *, us // 86400 AS t, {sigma} AS q, CASE event_type WHEN 'signup' THEN 0.25 WHEN 'click' THEN 0.5 ELSE 1 END AS worth, {known} AS known{columns} FROM e),
        l AS (SELECT *, CASE WHEN known AND lag(known) OVER w AND t - lag(t) OVER w <= 1500000 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM l),
        p AS (SELECT a.event_id, (o.t - a.t) / {radius}::DOUBLE AS u, o.q, o.worth / greatest(o.q, 0.05) ** 2 AS w, a.x, o.x AS ox, o.y AS oy
              FROM r a JOIN r o ON a.user_id = o.user_id AND a.run = o.run AND a.known AND o.known AND abs(o.t - a.t) <= {radius})"""


ORACLES = {
    "regular_motion": f"""WITH {_windows("event_type <> 'error' AND k / 100.0::DOUBLE <= 5", "k / 100.0::DOUBLE", 2000000, ", value / 100 AS x, k / 100.0::DOUBLE AS y")},
        m AS (SELECT event_id, count(*) AS n, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u ** 3) AS s3, sum(w * u ** 4) + 0.001 * sum(w) AS s4, sum(w * ox) AS a0, sum(w * u * ox) AS a1, sum(w * u * u * ox) AS a2, sum(w * oy) AS b0, sum(w * u * oy) AS b1, sum(w * u * u * oy) AS b2 FROM p GROUP BY 1),
        d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM m WHERE n >= 3),
        c AS (SELECT *, (s2 * s4 - s3 * s3) / det AS c0, (s2 * s3 - s1 * s4) / det AS c1, (s1 * s3 - s2 * s2) / det AS c2 FROM d WHERE abs(det) > 1e-12 * s0 * s2 * s4),
        f AS (SELECT event_id, any_value(c0 * a0 + c1 * a1 + c2 * a2) AS fx, any_value(c0 * b0 + c1 * b1 + c2 * b2) AS fy, sum(abs((c0 + c1 * u + c2 * u * u) * w) * p.q) AS fq FROM c JOIN p USING (event_id) GROUP BY 1),
        o AS (SELECT r.*, fx, fy, greatest(fq, sqrt((fx - x) ** 2 + (fy - y) ** 2), q) AS sq FROM r LEFT JOIN f USING (event_id))
        SELECT event_id, CASE WHEN NOT known OR sq > 5 THEN 'unknown' WHEN fx IS NOT NULL THEN 'inferred' WHEN event_type = 'signup' THEN 'interpolated' WHEN event_type = 'click' THEN 'inferred' ELSE 'observed' END AS smooth_state,
            round(CASE WHEN known AND coalesce(sq, 0) <= 5 THEN coalesce(fx, x) END, 6) AS x, round(CASE WHEN known AND coalesce(sq, 0) <= 5 THEN coalesce(fy, y) END, 6) AS y, round(CASE WHEN known AND coalesce(sq, 0) <= 5 THEN coalesce(sq, q) END, 6) AS sigma FROM o""",
    "angular_velocity": f"""WITH {_windows("event_type <> 'error' AND k % 19 > 0 AND k / 180.0::DOUBLE <= 0.5", "k / 180.0::DOUBLE", 1500000, ", value / 30 AS x, 0 AS y")},
        v AS (SELECT *, atan2(sin(ox - x), cos(ox - x)) AS z FROM p),
        m AS (SELECT event_id, count(*) AS n, max(abs(z)) AS most, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u ** 3) AS s3, sum(w * u ** 4) AS s4, sum(w * z) AS a0, sum(w * u * z) AS a1, sum(w * u * u * z) AS a2 FROM v GROUP BY 1),
        d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM m WHERE n >= 3 AND most < pi() - 1e-6),
        c AS (SELECT *, (s2 * s3 - s1 * s4) / det AS d0, (s0 * s4 - s2 * s2) / det AS d1, (s1 * s2 - s0 * s3) / det AS d2, (s1 * s3 - s2 * s2) / det AS e0, (s1 * s2 - s0 * s3) / det AS e1, (s0 * s2 - s1 * s1) / det AS e2 FROM d WHERE abs(det) > 1e-12 * s0 * s2 * s4),
        f AS (SELECT event_id, any_value(n) AS n, any_value(d0 * a0 + d1 * a1 + d2 * a2) / 1.5 AS velocity, any_value(e0 * a0 + e1 * a1 + e2 * a2) * 2 / 2.25 AS acceleration, sum(abs((d0 + d1 * u + d2 * u * u) * w) * v.q) / 1.5 AS sigma FROM c JOIN v USING (event_id) GROUP BY 1)
        SELECT e.event_id, coalesce(n, 0) AS n_support, round(velocity, 2) + 0.0 AS velocity, round(acceleration, 1) + 0.0 AS acceleration, round(sigma, 2) AS sigma FROM e LEFT JOIN f USING (event_id)""",
    "fitted_bones": """WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings WHERE len(embedding) >= 6),
        g AS (SELECT *, sqrt((e[4] - e[1]) ** 2 + (e[5] - e[2]) ** 2 + (e[6] - e[3]) ** 2) AS gap FROM e),
        f AS (SELECT *, gap * (1 + 0.02 * sin(vec_id)) AS length, (4 / (gap * 0.03)) ** 2 AS pull FROM g WHERE gap > 0),
        p AS (SELECT *, pull * (gap - length) / (1 + pull * ((0.01 * gap) ** 2 + (0.02 * gap) ** 2)) AS force FROM f),
        m AS (SELECT vec_id, e, gap, force, unnest(['elbow', 'wrist']) AS name, unnest([0, 3]) AS k, unnest([(0.01 * gap) ** 2, -1 * ((0.02 * gap) ** 2)]) * force / gap AS t FROM p)
        SELECT vec_id, CASE WHEN force IS NULL THEN 'fit_rejected' ELSE 'converged' END AS status, name, round(e[k + 1] + t * (e[4] - e[1]), 7) + 0.0 AS x, round(e[k + 2] + t * (e[5] - e[2]), 7) + 0.0 AS y, round(e[k + 3] + t * (e[6] - e[3]), 7) + 0.0 AS z, round(abs(t) * gap, 7) AS moved FROM m""",
}
