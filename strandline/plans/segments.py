"""Queries of activity: spans, executions and steps, proofs, coverage, ground views; users stand for recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import runs, segmentation
from strandline.plans.base import DAY, EVENTS, HOUR, events

PAUSE = 4 * DAY
#: The first day of the events, in microseconds.
DAWN = 1_704_067_200_000_000


def arm_spans(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") != "error", (F.col("value") > 25).cast("int"))
    e = events(spark, d).withColumn("state", state)
    return segmentation.activity_spans(e, ["user_id"], "us", "state", DAY, 8 * HOUR, 4 * HOUR).select("user_id", "start", "end", "n")


def execution_steps(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("day", F.floor((F.col("us") - DAWN) / DAY))
    covered = (F.col("event_type") != "error") | (F.col("value") < 60)
    busy = F.col("day").between(4, 24) & (F.col("value") > 35) & covered & (F.col("event_type") != "signup")
    e = e.withColumns({"covered": covered, "busy": busy, "quiet": covered & ~busy})
    e = e.withColumns({"left": F.when(F.col("event_type") == "click", F.col("value") > 60), "right": F.when(F.col("event_type") == "view", F.col("k") > 70)})
    out = segmentation.executions(
        e, ["user_id"], "us", "busy", "quiet", "covered", "event_type", ["left", "right"],
        gap=PAUSE, least=HOUR, tracks=3, hold=2 * DAY, edge=DAY, step_quiet=6 * HOUR, coverage=0.7, unknown=2 * DAY,
    )
    return out.withColumn("score", F.round("score", 6))


def increase_proof(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("day", F.floor(F.col("us") / DAY))
    e = e.withColumns({"value": F.when(F.col("event_type") != "error", F.col("value")), "sigma": F.col("k") / 20})
    return segmentation.proven_increase(e, ["user_id", "day"], "us", "value", "sigma", 10.0, 3.0)


def coverage_intervals(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("valid", F.col("event_type") != "error")
    return segmentation.covered_spans(e, ["user_id"], "us", "valid", 12 * HOUR).select("user_id", "start", "end", "n_spans")


def keyframe_window(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.keyframe_anchors(events(spark, d), ["user_id"], "us", F.col("k") % 12 == 0, 20, 40).select("user_id", "ordinal", "event_id", "anchor")


def ground_view(spark: SparkSession, d: str) -> DataFrame:
    """Per run of one source of the root (its own, the pelvis, none): extent in time and bounds."""
    root, pelvis = F.when(F.col("event_type").isin("click", "view"), F.col("value")), F.when(F.col("k") > 30, F.col("k") / 2)
    e = events(spark, d).withColumns({"root": F.coalesce(root, pelvis), "source": F.when(root.isNotNull(), "root").when(pelvis.isNotNull(), "pelvis")})
    spans = runs.value_runs(e, ["user_id"], "us", "source").filter("source is not null").groupBy("user_id", "run", "source")
    return spans.agg(F.min("us").alias("start"), F.max("us").alias("end"), F.min("root").alias("low"), F.max("root").alias("high")).drop("run")


def crossing_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Where an arm comes to be crossed: a run of crossed rows that holds for two hours, right after one of not_crossed rows."""
    relation = F.when(F.col("event_type") == "error", "unknown").when(F.col("value") > 30, "crossed").otherwise("not_crossed")
    e = runs.value_runs(events(spark, d).withColumn("relation", relation), ["user_id"], "us", "relation")
    spans = e.groupBy("user_id", "run", "relation").agg(F.min("us").alias("start"), (F.max("us") - F.min("us")).alias("held"))
    spans = spans.withColumn("was", F.lag("relation").over(Window.partitionBy("user_id").orderBy("run")))
    return spans.filter((F.col("relation") == "crossed") & (F.col("was") == "not_crossed") & (F.col("held") >= 2 * HOUR)).select("user_id", "start", "held")


def airborne_bouts(spark: SparkSession, d: str) -> DataFrame:
    """Runs without contact with their chamber (first lowest), extension (first highest after) and recovery (first lowest after that)."""
    e = events(spark, d).withColumn("flight", ~F.col("event_type").isin("click", "error"))
    e = runs.value_runs(e, ["user_id"], "us", "flight").filter("flight").withColumn("level", F.round("value", 0))
    key = ["user_id", "run"]
    whole = Window.partitionBy(*key)

    e = e.withColumn("peak", F.max_by("us", F.struct("level", -F.col("us"))).over(whole))
    before, after = F.col("us") <= F.col("peak"), F.col("us") >= F.col("peak")
    chamber = F.min_by(F.when(before, F.col("us")), F.when(before, F.struct("level", "us")))
    recovery = F.min_by(F.when(after, F.col("us")), F.when(after, F.struct("level", "us")))
    out = e.groupBy(*key).agg(F.count("*").alias("n"), chamber.alias("chamber"), F.first("peak").alias("peak"), recovery.alias("recovery"))
    return out.filter("n >= 3").drop("run")


def mirrored_paths(spark: SparkSession, d: str) -> DataFrame:
    """Per user whether clicks and views of the same six hours move to opposite sides, over at least three shared samples."""
    e = events(spark, d).withColumn("slot", F.floor(F.col("us") / (6 * HOUR)))
    sides = e.groupBy("user_id", "slot").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("l"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("r"))
    shared = sides.filter("l is not null and r is not null")
    mirrored = F.bool_and((F.col("l") - 60) * (F.col("r") - 60) <= 900)
    return shared.groupBy("user_id").agg(F.count("*").alias("n"), mirrored.alias("near"), F.min_by("slot", F.struct(-F.col("l"), "slot")).alias("widest")).filter("n >= 3")


QUERIES = {f.__name__: f for f in (arm_spans, execution_steps, increase_proof, coverage_intervals, keyframe_window, ground_view, crossing_transitions, airborne_bouts, mirrored_paths)}

W = "(PARTITION BY user_id ORDER BY us)"
RUNS = "sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING)"
ORACLES = {
    "arm_spans": f"""WITH RECURSIVE {EVENTS}, a AS (SELECT user_id, us, CASE WHEN event_type <> 'error' THEN (value > 25)::INT ELSE -1 END AS state FROM e
            UNION ALL SELECT user_id, max(us) + {30 * DAY}, -1 FROM e GROUP BY 1),
        s AS (SELECT *, row_number() OVER {W} AS i, us - lag(us) OVER {W} AS step FROM a),
        f AS (SELECT user_id, i, us, CASE WHEN state = 1 THEN us END AS start, CASE WHEN state = 1 THEN us END AS last, NULL::BIGINT AS rest, 1 AS n, NULL::BIGINT AS d0, NULL::BIGINT AS d1, 0 AS dn FROM s WHERE i = 1
              UNION ALL
              SELECT user_id, i, us, CASE WHEN ends THEN CASE WHEN state = 1 THEN us END WHEN state = 1 THEN coalesce(start, us) ELSE start END,
                  CASE WHEN state = 1 THEN us WHEN ends THEN NULL ELSE last END, CASE WHEN ends OR state = 1 OR start IS NULL THEN NULL ELSE coalesce(rest, us) END,
                  CASE WHEN state = 1 THEN CASE WHEN ends OR start IS NULL THEN 1 ELSE n + 1 END ELSE n END, CASE WHEN ends THEN start END, CASE WHEN ends THEN last END, n
              FROM (SELECT s.user_id, s.i, s.us, s.state, f.start, f.last, f.rest, f.n, s.step > {DAY} OR s.state = -1 OR (s.state = 0 AND f.start IS NOT NULL AND s.us - coalesce(f.rest, s.us) >= {8 * HOUR}) AS ends
                    FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1))
        SELECT user_id, d0 AS start, d1 AS "end", dn::BIGINT AS n FROM f WHERE d1 - d0 >= {4 * HOUR}""",
    "execution_steps": f"""WITH {EVENTS}, c AS (SELECT *, event_type <> 'error' OR value < 60 AS covered, (us - {DAWN}) // {DAY} BETWEEN 4 AND 24 AND value > 35 AND event_type NOT IN ('signup') AND (event_type <> 'error' OR value < 60) AS busy FROM e),
        m AS (SELECT *, covered AND NOT busy AS quiet, lag(us) OVER {W} AS prev, lead(us) OVER {W} AS next, lead(covered) OVER {W} AS ahead, (lag(busy) OVER {W} IS DISTINCT FROM busy)::INT AS new, (lag(covered) OVER {W} IS DISTINCT FROM covered)::INT AS newc FROM c),
        r AS (SELECT *, {RUNS} AS run, sum(newc) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS crun FROM m),
        b AS (SELECT user_id, min(us) AS s, max(us) AS t FROM r WHERE busy GROUP BY user_id, run HAVING max(us) - min(us) >= {HOUR}),
        u AS (SELECT user_id, min(us) AS low, max(us) AS high, max(next - us) AS gap FROM r GROUP BY 1),
        x AS (SELECT u.*, first, last, (SELECT min(us) FROM r WHERE r.user_id = u.user_id AND us > last AND us >= last + {2 * DAY}) AS fin FROM u LEFT JOIN (SELECT user_id, min(s) AS first, max(t) AS last FROM b GROUP BY 1) q ON q.user_id = u.user_id),
        k AS (SELECT x.user_id, count(DISTINCT event_type) FILTER (busy AND us BETWEEN first AND last) AS tracks, sum(next - us) FILTER (us >= first AND us < fin AND covered AND ahead) / any_value(fin - first) AS share,
                count(*) FILTER (us < first AND us >= first - {DAY}) AS pre, count(*) FILTER (us > last AND us <= fin + {DAY}) AS post,
                count(*) FILTER (NOT quiet AND (us < first AND us >= first - {DAY} OR us > last AND us <= fin + {DAY})) AS loud FROM x JOIN r ON r.user_id = x.user_id GROUP BY 1),
        o AS (SELECT user_id, max(long) AS worst FROM (SELECT r.user_id, least(any_value(fin), max(next)) - greatest(any_value(first), min(prev)) AS long FROM r JOIN x ON r.user_id = x.user_id AND us BETWEEN first AND fin WHERE NOT covered GROUP BY r.user_id, crun) GROUP BY 1),
        v AS (SELECT x.*, k.share, CASE WHEN gap > {PAUSE} THEN 'native_sampling_gap' WHEN first IS NULL THEN 'no_sustained_activity' WHEN tracks < 3 THEN 'insufficient_multi_track_activity'
                WHEN fin IS NULL OR high - fin < {DAY} THEN 'terminal_hold_or_post_roll_not_observed' WHEN first - low < {DAY} THEN 'pre_roll_not_observed' WHEN pre = 0 OR post = 0 OR loud > 0 THEN 'edge_context_unknown_or_active'
                WHEN coalesce(share, 0) < 0.7 OR worst > {2 * DAY} THEN 'insufficient_continuous_evidence' ELSE 'segmented' END AS verdict FROM x JOIN k ON k.user_id = x.user_id LEFT JOIN o ON o.user_id = x.user_id),
        p AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY s) AS pt FROM b),
        g AS (SELECT v.user_id, p.s FROM v JOIN p ON p.user_id = v.user_id WHERE verdict = 'segmented' AND (pt IS NULL OR p.s - pt >= {6 * HOUR} AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = v.user_id AND us > pt AND us < p.s AND NOT quiet)
                AND NOT coalesce((SELECT arg_max(value > 60, us) FROM r WHERE r.user_id = v.user_id AND event_type = 'click' AND us >= first AND us < p.s), false)
                AND NOT coalesce((SELECT arg_max(k > 70, us) FROM r WHERE r.user_id = v.user_id AND event_type = 'view' AND us >= first AND us < p.s), false)))
        SELECT v.user_id, verdict, (row_number() OVER (PARTITION BY g.user_id ORDER BY s) - 1)::INTEGER AS step, s AS start, coalesce(lead(s) OVER (PARTITION BY g.user_id ORDER BY s), fin) AS "end", round(share, 6) AS score FROM v JOIN g ON g.user_id = v.user_id
        UNION ALL SELECT user_id, verdict, NULL, NULL, NULL, NULL FROM v WHERE verdict <> 'segmented'""",
    "increase_proof": f"""WITH {EVENTS}, d AS (SELECT user_id, us // {DAY} AS day, us, CASE WHEN event_type <> 'error' THEN value END AS v, k / 20.0::DOUBLE AS s, row_number() OVER (PARTITION BY user_id, us // {DAY} ORDER BY us) AS i FROM e),
        f AS (SELECT user_id, day, v AS v0, s AS s0 FROM d WHERE i = 1)
        SELECT f.user_id, f.day, (SELECT min(x.us) FROM d x WHERE x.user_id = f.user_id AND x.day = f.day AND x.v - v0 > greatest(10, 3 * (s0 + (SELECT max(y.s) FROM d y WHERE y.user_id = f.user_id AND y.day = f.day AND y.i <= x.i)))
            AND NOT EXISTS (SELECT 1 FROM d y WHERE y.user_id = f.user_id AND y.day = f.day AND y.i <= x.i AND (y.v IS NULL OR y.s IS NULL))) AS at FROM f""",
    "coverage_intervals": f"""WITH {EVENTS}, n AS (SELECT user_id, us, event_type <> 'error' AS valid, lag(us) OVER {W} AS t, lag(event_type) OVER {W} AS before FROM e),
        g AS (SELECT user_id, us, sum((t IS NULL OR before = 'error' OR us - t > {12 * HOUR})::INT) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM n WHERE valid)
        SELECT user_id, min(us) AS start, max(us) AS "end", count(*) AS n_spans FROM g GROUP BY user_id, island""",
    "keyframe_window": f"""WITH {EVENTS}, r AS (SELECT user_id, row_number() OVER {W} - 1 AS ordinal, event_id, k FROM e)
        SELECT user_id, ordinal, event_id, (SELECT max(y.ordinal) FROM r y WHERE y.user_id = r.user_id AND y.ordinal <= r.ordinal AND y.k % 12 = 0) AS anchor FROM r WHERE ordinal BETWEEN 20 AND 40""",
    "ground_view": f"""WITH {EVENTS}, s AS (SELECT user_id, us, CASE WHEN event_type IN ('click', 'view') THEN 'root' WHEN k > 30 THEN 'pelvis' END AS source, CASE WHEN event_type IN ('click', 'view') THEN value ELSE k / 2.0::DOUBLE END AS root FROM e),
        n AS (SELECT *, (lag(us) OVER {W} IS NULL OR lag(source) OVER {W} IS DISTINCT FROM source)::INT AS new FROM s), r AS (SELECT *, {RUNS} AS run FROM n)
        SELECT user_id, source, min(us) AS start, max(us) AS "end", min(root) AS low, max(root) AS high FROM r WHERE source IS NOT NULL GROUP BY user_id, run, source""",
    "crossing_transitions": f"""WITH {EVENTS}, s AS (SELECT user_id, us, CASE WHEN event_type = 'error' THEN 'unknown' WHEN value > 30 THEN 'crossed' ELSE 'not_crossed' END AS rel FROM e), n AS (SELECT *, lag(rel) OVER {W} AS was, (lag(rel) OVER {W} IS DISTINCT FROM rel)::INT AS new FROM s),
        r AS (SELECT *, {RUNS} AS run FROM n), g AS (SELECT user_id, any_value(rel) AS rel, arg_min(was, us) AS was, min(us) AS start, max(us) - min(us) AS held FROM r GROUP BY user_id, run)
        SELECT user_id, start, held FROM g WHERE rel = 'crossed' AND was = 'not_crossed' AND held >= {2 * HOUR}""",
    "airborne_bouts": f"""WITH {EVENTS}, s AS (SELECT user_id, us, event_type NOT IN ('click', 'error') AS flight, round(value, 0) AS level FROM e), n AS (SELECT *, (lag(flight) OVER {W} IS DISTINCT FROM flight)::INT AS new FROM s),
        r AS (SELECT *, {RUNS} AS run FROM n), f AS (SELECT *, first_value(us) OVER (PARTITION BY user_id, run ORDER BY level DESC, us) AS peak FROM r WHERE flight)
        SELECT user_id, count(*) AS n, first(us ORDER BY level, us) FILTER (us <= peak) AS chamber, any_value(peak) AS peak, first(us ORDER BY level, us) FILTER (us >= peak) AS recovery FROM f GROUP BY user_id, run HAVING count(*) >= 3""",
    "mirrored_paths": f"""WITH {EVENTS}, l AS (SELECT user_id, us // {6 * HOUR} AS slot, avg(value) AS l FROM e WHERE event_type = 'click' GROUP BY 1, 2), r AS (SELECT user_id, us // {6 * HOUR} AS slot, avg(value) AS r FROM e WHERE event_type = 'view' GROUP BY 1, 2)
        SELECT user_id, count(*) AS n, bool_and((l - 60) * (r - 60) <= 900) AS near, first(slot ORDER BY l DESC, slot) AS widest FROM l JOIN r USING (user_id, slot) GROUP BY 1 HAVING count(*) >= 3""",
}
