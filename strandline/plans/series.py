"""Catalogue queries on aggregates and windows of time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import evidence, geometry
from strandline.operators import graphs, intervals, robust, runs, smoothing
from strandline.plans.base import DAY, EVENTS, HOUR, events, orders, table


def percentile_normalise(spark: SparkSession, d: str) -> DataFrame:
    return robust.normalised(events(spark, d), ["event_type"], "value").select("event_id", F.round("normalized", 6).alias("normalized"))


def robust_mad(spark: SparkSession, d: str) -> DataFrame:
    out = robust.robust_estimate(events(spark, d), ["user_id"], "value")
    return out.select("user_id", "n", F.round("center", 6).alias("center"), F.round("dispersion", 6).alias("dispersion"), "n_kept", F.round("estimate", 6).alias("estimate"))


def local_gap_limit(spark: SparkSession, d: str) -> DataFrame:
    gap = F.lead("us").over(Window.partitionBy("user_id").orderBy("us")) - F.col("us")
    gaps = events(spark, d).select("event_id", "user_id", "us", gap.cast("double").alias("gap")).filter("gap is not null")
    out = robust.neighbour_median(gaps, ["user_id"], "us", "gap", 2)
    return out.select("event_id", "local_median", (F.col("gap") > 2 * F.col("local_median")).alias("is_dropout"))


def quality_combine(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    state = F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "signup", "interpolated").otherwise("observed")
    q = evidence.quality(state, F.lit(0.5), F.col("value"), F.array("event_type"))
    groups = e.withColumn("q", q).withColumn("hour", F.floor(F.col("us") / HOUR)).groupBy("hour").agg(evidence.combined(F.col("q"), F.round(F.max("value"), 6)).alias("q"))
    return groups.select("hour", "q.state", "q.uncertainty", F.concat_ws(",", "q.source_ids").alias("sources"))


def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = robust.coverage(events(spark, d), ["user_id"], "us", F.col("event_type") != "error")
    return out.select("user_id", F.col("extent").alias("extent_us"), F.col("covered").alias("covered_us"), F.round("ratio", 6).alias("ratio"))


def dup_and_missing(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", "k").dropna()
    counts = e.groupBy("user_id", "k").agg(F.count("*").alias("n"))
    spans = counts.groupBy("user_id").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count_if(F.col("n") > 1).alias("n_duplicated"), F.count("*").alias("n_distinct"))
    return spans.select("user_id", "n_duplicated", (F.col("high") - F.col("low") + 1 - F.col("n_distinct")).alias("n_missing"))


def missing_ordinals(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("conv_id is not null and turn is not null")
    every = c.groupBy("conv_id").agg(F.max("turn").alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("turn"))
    return every.exceptAll(c.select("conv_id", "turn").distinct())


def path_length_excursion(spark: SparkSession, d: str) -> DataFrame:
    out = robust.travelled(events(spark, d), ["user_id"], "us", ["value", "k"])
    return out.select("user_id", *(F.round(c, 4).alias(c) for c in ("path", "displacement", "excursion")))


def component_labels(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", F.floor(F.col("us") / (HOUR // 12)).alias("slot")).distinct()
    # all users of a slot hang on its first one
    edges = e.withColumn("a", F.min("user_id").over(Window.partitionBy("slot"))).filter("a < user_id").select("a", F.col("user_id").alias("b")).distinct()
    return graphs.component_labels(edges)


def signature_runs(spark: SparkSession, d: str) -> DataFrame:
    out = runs.value_runs(events(spark, d), ["user_id"], "us", "event_type")
    return out.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("us").alias("start"), F.max("us").alias("end"))


def islands_gap(spark: SparkSession, d: str) -> DataFrame:
    out = runs.islands(events(spark, d), ["user_id"], "us", DAY)
    return out.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("us").alias("start"), F.max("us").alias("end"))


def range_frame_count(spark: SparkSession, d: str) -> DataFrame:
    frame = Window.partitionBy("user_id").orderBy("us").rangeBetween(-12 * HOUR, 12 * HOUR)
    return events(spark, d).select("event_id", F.count("*").over(frame).alias("n_near"), F.round(F.max("value").over(frame), 6).alias("max_near"))


def local_slope(spark: SparkSession, d: str) -> DataFrame:
    scaled = events(spark, d).withColumn("hours", (F.col("us") / 3600).cast("long"))
    out = smoothing.local_slope(scaled, ["user_id"], "hours", "value", 2, 2)
    return out.select("event_id", F.round("slope", 4).alias("slope"))


def local_quadratic(spark: SparkSession, d: str) -> DataFrame:
    # each event type is a series; its clock runs 86,400 times as fast, so that days are seconds
    scaled = events(spark, d).withColumn("fast", (F.col("us") / 86_400).cast("long"))
    out = smoothing.local_quadratic(scaled, ["event_type"], "fast", "value", 500_000, least=4)
    return out.select("event_id", "n_fit", F.round("smooth", 4).alias("smooth"), F.round("velocity", 3).alias("velocity"), F.round("acceleration", 2).alias("acceleration"), F.round("smooth_sigma", 5).alias("smooth_sigma"))


def short_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return runs.filled(e, ["user_id"], "us", "value", 3 * DAY).select("event_id", "state", F.round("value", 6).alias("value"))


def unwrap_angle(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("angle", geometry.wrap_angle(F.col("value")))
    return runs.unwrapped(e, ["user_id"], "us", "angle").select("event_id", F.round("unwrapped", 6).alias("unwrapped"))


def sign_continuity(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumns({"p": F.cos("value"), "q": F.sin("value")})
    return runs.sign_continuous(e, ["user_id"], "us", ["p", "q"]).select("event_id", "flipped", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


def monotone_runs(spark: SparkSession, d: str) -> DataFrame:
    out = runs.monotone_runs(events(spark, d), ["user_id"], "us", "value")
    return out.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.round(F.max("value") - F.min("value"), 6).alias("fall")).filter("n >= 2")


def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_spans(orders(spark, d), ["o_custkey"]).select("o_custkey", "start", "end", "n_spans")


def complement_spans(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    low, high = o.agg(F.min("start").alias("low"), F.max("end").alias("high")).select("low", "high").first() or (0, 0)
    extent = o.select("o_custkey").distinct().select("o_custkey", F.lit(low).alias("low"), F.lit(high).alias("high"))
    return intervals.complement_spans(o, extent, ["o_custkey"])


def next_previous_entity(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("event_type").orderBy("us", "event_id")
    return events(spark, d).select("event_id", F.lag("event_id").over(order).alias("previous_id"), F.lead("event_id").over(order).alias("next_id"))


def rotation_slerp(spark: SparkSession, d: str) -> DataFrame:
    """Turns about one axis: what slerp gives half-way is known."""
    e = events(spark, d).withColumns({"a": F.col("value") / 1000, "b": F.col("k") / 100.0})
    zero = F.lit(0.0)
    p = geometry.quaternion(F.cos(F.col("a") / 2), zero, zero, F.sin(F.col("a") / 2))
    q = geometry.quaternion(F.cos(F.col("b") / 2), zero, zero, F.sin(F.col("b") / 2))
    # structs are columns of their own before the next step uses them several times
    e = e.withColumns({"p": p, "q": q}).withColumn("s", geometry.slerp(F.col("p"), F.col("q"), F.lit(0.5)))
    middle = geometry.rotation_vector(F.col("s"))["z"]
    turned = geometry.rotated(F.col("p"), geometry.vector(F.lit(1.0), zero, zero))
    return e.select("event_id", F.round(middle, 6).alias("half_way"), F.round(turned["x"], 6).alias("x"), F.round(turned["y"], 6).alias("y"))


def camera_projection(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").filter("embedding is not null and size(embedding) >= 3").withColumn("e", F.col("embedding").cast("array<double>"))
    point = geometry.vector(F.col("e")[0], F.col("e")[1], F.col("e")[2] + 2.0)
    distortion = F.array(*map(F.lit, (0.1, -0.05, 0.001, -0.002, 0.01)))
    pixel = geometry.projected(point, F.lit(800.0), F.lit(820.0), F.lit(320.0), F.lit(240.0), distortion)
    back = geometry.undistorted((F.col("pixel.x") - 320) / 800, (F.col("pixel.y") - 240) / 820, distortion)
    v = v.withColumn("pixel", pixel).withColumn("back", back)
    return v.select("vec_id", F.round("pixel.x", 5).alias("u"), F.round("pixel.y", 5).alias("v"), (F.abs(F.col("back.x") - F.col("e")[0] / (F.col("e")[2] + 2)) < 1e-6).alias("round_trip"))


def evidence_violations(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    state = F.when(F.col("event_type") == "error", "unknown").otherwise("observed")
    q = F.struct(state.alias("state"), F.when(F.col("k") > 5, F.col("k") / 50).alias("score"), F.lit(0.1).alias("uncertainty"), F.array(F.lit("a")).alias("source_ids"))
    rows = e.withColumn("broken", evidence.violations(F.when(F.col("value") > 10, F.col("value")), q))
    return rows.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (percentile_normalise, robust_mad, local_gap_limit, quality_combine, coverage_ratio, dup_and_missing, missing_ordinals, path_length_excursion, component_labels, signature_runs, islands_gap, range_frame_count)
    + (local_slope, local_quadratic, short_gap_fill, unwrap_angle, sign_continuity, monotone_runs, merge_spans, complement_spans, next_previous_entity, rotation_slerp, camera_projection, evidence_violations)
}

RUN = "sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING)"
ORDERED = "(PARTITION BY user_id ORDER BY us)"
SPANS = 'o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS start, s.last AS "end" FROM orders JOIN (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS last FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey WHERE epoch_us(o_orderdate) <= s.last)'
MERGED = f"""{SPANS}, n AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY o_custkey ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM o),
        u AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS span FROM n),
        m AS (SELECT o_custkey, span, min(start) AS start, max("end") AS "end", count(*) AS n_spans FROM u GROUP BY 1, 2)"""

ORACLES = {
    "percentile_normalise": f"""WITH {EVENTS}, b AS (SELECT event_type, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.95) AS p95, max(value) AS top FROM e GROUP BY 1)
        SELECT event_id, round(greatest(0, least(1, (value - p10) / greatest(p95 - p10, top - p10))), 6) AS normalized FROM e JOIN b USING (event_type)""",
    "robust_mad": f"""WITH {EVENTS}, m AS (SELECT user_id, count(value) AS n, median(value) AS center FROM e GROUP BY 1),
        x AS (SELECT e.user_id, value, abs(value - center) AS off FROM e JOIN m USING (user_id)),
        s AS (SELECT user_id, median(off) * 1.4826 AS dispersion FROM x GROUP BY 1),
        k AS (SELECT user_id, count(*) AS n_kept, median(value) AS estimate FROM x JOIN s USING (user_id) WHERE off <= dispersion * 3.5 GROUP BY 1)
        SELECT user_id, n, round(center, 6) AS center, round(dispersion, 6) AS dispersion, n_kept, round(estimate, 6) AS estimate FROM m JOIN s USING (user_id) LEFT JOIN k USING (user_id)""",
    "local_gap_limit": f"""WITH {EVENTS}, g AS (SELECT * FROM (SELECT event_id, user_id, us, (lead(us) OVER {ORDERED} - us)::DOUBLE AS gap FROM e) WHERE gap IS NOT NULL),
        m AS (SELECT *, median(gap) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS local_median FROM g)
        SELECT event_id, local_median, gap > 2 * local_median AS is_dropout FROM m""",
    "quality_combine": f"""WITH {EVENTS}, q AS (SELECT *, CASE event_type WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'interpolated' ELSE 'observed' END AS state FROM e)
        SELECT CAST(floor(us / {HOUR}) AS BIGINT) AS hour, CASE WHEN bool_or(state = 'unknown') THEN 'unknown' WHEN bool_or(state = 'interpolated') THEN 'interpolated' ELSE 'inferred' END AS state,
               round(max(value), 6) AS uncertainty, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM q GROUP BY 1""",
    "coverage_ratio": f"""WITH {EVENTS}, c AS (SELECT user_id, us, event_type <> 'error' AS c, lead(us) OVER {ORDERED} AS n, lead(event_type <> 'error') OVER {ORDERED} AS nc FROM e)
        SELECT user_id, max(us) - min(us) AS extent_us, coalesce(sum(CASE WHEN c AND nc THEN n - us END), 0)::BIGINT AS covered_us,
               round(CASE WHEN max(us) > min(us) THEN coalesce(sum(CASE WHEN c AND nc THEN n - us END), 0)::DOUBLE / (max(us) - min(us)) END, 6) AS ratio FROM c GROUP BY 1""",
    "dup_and_missing": f"""WITH {EVENTS}, c AS (SELECT user_id, k, count(*) AS n FROM e WHERE k IS NOT NULL GROUP BY 1, 2)
        SELECT user_id, count(*) FILTER (n > 1) AS n_duplicated, max(k) - min(k) + 1 - count(*) AS n_missing FROM c GROUP BY 1""",
    "missing_ordinals": """WITH c AS (SELECT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
        SELECT conv_id, unnest(range(0, max(turn) + 1)) AS turn FROM c GROUP BY 1 EXCEPT SELECT conv_id, turn FROM c""",
    "path_length_excursion": f"""WITH {EVENTS}, s AS (SELECT *, sqrt((value - lag(value) OVER {ORDERED}) ** 2 + (k - lag(k) OVER {ORDERED}) ** 2) AS step,
            sqrt((value - first_value(value) OVER {ORDERED}) ** 2 + (k - first_value(k) OVER {ORDERED}) ** 2) AS away FROM e)
        SELECT user_id, round(coalesce(sum(step), 0), 4) AS path, round(arg_max(away, us), 4) AS displacement, round(max(away), 4) AS excursion FROM s GROUP BY 1""",
    "component_labels": f"""WITH RECURSIVE {EVENTS}, s AS (SELECT DISTINCT user_id, floor(us / {HOUR // 12}) AS slot FROM e),
        x AS (SELECT DISTINCT l.user_id AS a, r.user_id AS b FROM s l JOIN s r ON l.slot = r.slot AND l.user_id < r.user_id),
        y AS (SELECT a, b FROM x UNION SELECT b, a FROM x),
        c(node, seen) AS (SELECT a, a FROM y UNION SELECT b, b FROM y UNION SELECT y.b, c.seen FROM c JOIN y ON c.node = y.a)
        SELECT node, min(seen) AS component FROM c GROUP BY 1""",
    "signature_runs": f"""WITH {EVENTS}, n AS (SELECT *, CASE WHEN lag(event_type) OVER {ORDERED} IS NOT DISTINCT FROM event_type AND lag(us) OVER {ORDERED} IS NOT NULL THEN 0 ELSE 1 END AS new FROM e),
        g AS (SELECT *, {RUN} AS run FROM n) SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, min(us) AS start, max(us) AS "end" FROM g GROUP BY 1, 2, 3""",
    "islands_gap": f"""WITH {EVENTS}, n AS (SELECT *, CASE WHEN us - lag(us) OVER {ORDERED} <= {DAY} THEN 0 ELSE 1 END AS new FROM e),
        g AS (SELECT *, {RUN} AS island FROM n) SELECT user_id, island::BIGINT AS island, count(*) AS n, min(us) AS start, max(us) AS "end" FROM g GROUP BY 1, 2""",
    "range_frame_count": f"""WITH {EVENTS} SELECT event_id, count(*) OVER w AS n_near, round(max(value) OVER w, 6) AS max_near FROM e
        WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {12 * HOUR} PRECEDING AND {12 * HOUR} FOLLOWING)""",
    "local_slope": f"""WITH {EVENTS}, t AS (SELECT *, (us // 3600 - min(us // 3600) OVER (PARTITION BY user_id)) * 1e-6 AS t FROM e)
        SELECT event_id, round(regr_slope(value, t) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS slope FROM t""",
    "local_quadratic": f"""WITH {EVENTS}, f AS (SELECT *, us // 86400 AS fast FROM e),
        p AS (SELECT a.event_id, (b.fast - a.fast) / 500000.0::DOUBLE AS u, b.value AS y FROM f a JOIN f b ON a.event_type = b.event_type AND b.fast BETWEEN a.fast - 500000 AND a.fast + 500000 WHERE b.value IS NOT NULL),
        s AS (SELECT event_id, count(*) AS n, sum(u) AS u1, sum(u * u) AS u2, sum(u ** 3) AS u3, sum(u ** 4) AS u4, sum(y) AS y0, sum(u * y) AS y1, sum(u * u * y) AS y2 FROM p GROUP BY 1),
        t AS (SELECT *, n * (u2 * u4 - u3 * u3) - u1 * (u1 * u4 - u2 * u3) + u2 * (u1 * u3 - u2 * u2) AS det FROM s)
        SELECT event_id, n AS n_fit, round(CASE WHEN ok THEN (y0 * (u2 * u4 - u3 * u3) - u1 * (y1 * u4 - y2 * u3) + u2 * (y1 * u3 - y2 * u2)) / det END, 4) + 0.0 AS smooth,
               round(CASE WHEN ok THEN (n * (y1 * u4 - y2 * u3) - y0 * (u1 * u4 - u2 * u3) + u2 * (u1 * y2 - u2 * y1)) / det / 0.5 END, 3) + 0.0 AS velocity,
               round(CASE WHEN ok THEN 2 * (n * (u2 * y2 - u3 * y1) - u1 * (u1 * y2 - u2 * y1) + y0 * (u1 * u3 - u2 * u2)) / det / 0.25 END, 2) + 0.0 AS acceleration,
               round(CASE WHEN ok THEN sqrt((u2 * u4 - u3 * u3) / det) END, 5) AS smooth_sigma
        FROM (SELECT *, n >= 4 AND det > 1e-6 * n * u2 * u4 AND u2 > 0 AS ok FROM t)""",
    "short_gap_fill": f"""WITH {EVENTS}, v AS (SELECT event_id, user_id, us, CASE WHEN event_type <> 'error' THEN value END AS value FROM e),
        x AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) OVER b AS bt, last_value(value IGNORE NULLS) OVER b AS bv,
                     first_value(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) OVER f AS ft, first_value(value IGNORE NULLS) OVER f AS fv FROM v
              WINDOW b AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
        SELECT event_id, CASE WHEN value IS NOT NULL THEN 'observed' WHEN ft - bt <= {3 * DAY} THEN 'interpolated' ELSE 'unknown' END AS state,
               round(CASE WHEN value IS NULL AND ft - bt <= {3 * DAY} THEN bv + (fv - bv) * ((us - bt)::DOUBLE / (ft - bt)) ELSE value END, 6) AS value FROM x""",
    "unwrap_angle": f"""WITH {EVENTS}, a AS (SELECT *, atan2(sin(value), cos(value)) AS angle FROM e), s AS (SELECT *, angle - lag(angle) OVER {ORDERED} AS step FROM a)
        SELECT event_id, round(sum(coalesce(atan2(sin(step), cos(step)), angle)) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM s""",
    "sign_continuity": f"""WITH {EVENTS}, c AS (SELECT event_id, user_id, us, cos(value) AS p, sin(value) AS q FROM e),
        t AS (SELECT *, CASE WHEN p * lag(p) OVER {ORDERED} + q * lag(q) OVER {ORDERED} < 0 THEN 1 ELSE 0 END AS turn FROM c),
        f AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) % 2 = 1 AS flipped FROM t)
        SELECT event_id, flipped, round(CASE WHEN flipped THEN -p ELSE p END, 6) AS p, round(CASE WHEN flipped THEN -q ELSE q END, 6) AS q FROM f""",
    "monotone_runs": f"""WITH {EVENTS}, n AS (SELECT *, CASE WHEN value < lag(value) OVER {ORDERED} THEN 0 ELSE 1 END AS new FROM e), g AS (SELECT *, {RUN} AS run FROM n)
        SELECT user_id, run::BIGINT AS run, count(*) AS n, round(max(value) - min(value), 6) AS fall FROM g GROUP BY 1, 2 HAVING count(*) >= 2""",
    "merge_spans": f"""WITH {MERGED} SELECT o_custkey, start, "end", n_spans FROM m""",
    "complement_spans": f"""WITH {MERGED}, x AS (SELECT min(start) AS low, max("end") AS high FROM o),
        g AS (SELECT o_custkey, coalesce(lag("end") OVER (PARTITION BY o_custkey ORDER BY start), low) AS a, start AS b FROM m, x
              UNION ALL SELECT o_custkey, max("end"), any_value(high) FROM m, x GROUP BY 1)
        SELECT o_custkey, a AS start, b AS "end" FROM g WHERE a < b""",
    "next_previous_entity": f"""WITH {EVENTS} SELECT event_id, lag(event_id) OVER w AS previous_id, lead(event_id) OVER w AS next_id FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id)""",
    "rotation_slerp": f"""WITH {EVENTS} SELECT event_id, round((value / 1000 + k / 100.0) / 2, 6) AS half_way, round(cos(value / 1000), 6) AS x, round(sin(value / 1000), 6) AS y FROM e""",
    "camera_projection": """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE / (embedding[3]::DOUBLE + 2) AS x, embedding[2]::DOUBLE / (embedding[3]::DOUBLE + 2) AS y FROM embeddings WHERE len(embedding) >= 3),
        r AS (SELECT *, x * x + y * y AS r2 FROM p), s AS (SELECT *, 1 + r2 * (0.1 + r2 * (-0.05 + r2 * 0.01)) AS k FROM r)
        SELECT vec_id, round(800 * (x * k + 2 * 0.001 * x * y - 0.002 * (r2 + 2 * x * x)) + 320, 5) AS u, round(820 * (y * k + 0.001 * (r2 + 2 * y * y) - 2 * 0.002 * x * y) + 240, 5) AS v, true AS round_trip FROM s""",
    "evidence_violations": f"""WITH {EVENTS}, q AS (SELECT event_type = 'error' AS u, CASE WHEN k > 5 THEN k / 50.0 END AS s, CASE WHEN value > 10 THEN value END AS v FROM e)
        SELECT * FROM (SELECT 'value_without_evidence' AS rule, count(*) FILTER (v IS NOT NULL AND u) AS n FROM q UNION ALL SELECT 'evidence_without_value', count(*) FILTER (v IS NULL AND NOT u) FROM q
            UNION ALL SELECT 'score_of_unknown', count(*) FILTER (u AND s IS NOT NULL) FROM q UNION ALL SELECT 'score_out_of_range', count(*) FILTER (s NOT BETWEEN 0 AND 1) FROM q) WHERE n > 0""",
}
