"""Queries of assembly and edits: users are performances, their events actions of some hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import assembly, constraints
from strandline.plans.base import DAY, EVENTS, HOUR, events

DAWN = 1_704_067_200_000_000
FIRST, LAST = DAWN + 10 * DAY, DAWN + 12 * DAY


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d)
    before = F.when(F.col("k") % 4 == 0, F.col("event_id") - F.col("k") % 7 - 1)
    actions = e.select("user_id", "event_id", before.alias("before"), F.col("us").alias("start"), (F.col("us") + F.col("k").cast("long") * (HOUR // 12) + HOUR).alias("end"))
    return e.select("user_id").distinct().select("user_id", F.lit(FIRST).alias("start"), F.lit(LAST).alias("end")), actions


def extended_executions(spark: SparkSession, d: str) -> DataFrame:
    found, chosen = assembly.extended(*_parts(spark, d), ["user_id"], "event_id", "before")
    return found.join(chosen.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").select("user_id", "start", "end", "extended", F.coalesce("n", F.lit(0)).alias("n_actions"))


def owned_actions(spark: SparkSession, d: str) -> DataFrame:
    executions, actions = _parts(spark, d)
    third = (LAST - FIRST) // 4
    steps = executions.select("user_id", F.inline(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(FIRST + k * third).alias("start"), F.lit(FIRST + (k + 1) * third).alias("end")) for k in range(4)))))
    wider = executions.withColumns({"start": F.col("start") - DAY, "end": F.col("end") + F.col("user_id") % 3 * HOUR})
    steps = assembly.retiled(steps, wider, ["user_id"])
    return assembly.step_actions(steps, actions, ["user_id"], "step", "event_id")


def boundary_edits(spark: SparkSession, d: str) -> DataFrame:
    """Each user's execution has three steps; events move the edges between them, alone or with the neighbour's."""
    e = events(spark, d).filter("event_type in ('click', 'view', 'error')")
    step = lambda k: F.struct(F.lit(f"s{k}").alias("name"), F.lit(100 * k).cast("long").alias("start"), F.lit(100 * k + 100).cast("long").alias("end"))
    number = lambda n: F.lit(n).cast("long")
    views = e.select("user_id").distinct().select("user_id", F.lit("x").alias("id"), number(0).alias("clock_from"), number(300).alias("clock_to"), number(0).alias("start"), number(300).alias("end"), F.array(*map(step, range(3))).alias("steps"), F.array().cast("array<struct<name: string, at: long>>").alias("frames"))
    op = lambda kind, target, start, end: F.struct(F.lit(kind).alias("kind"), target.alias("target"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    edge = F.col("k") + 50
    both = F.array(op("boundary", F.lit("s0"), number(0), edge), op("boundary", F.lit("s1"), edge, number(200)))
    alone = F.array(op("boundary", F.lit("s0"), number(0), edge))
    frame = F.array(op("add", F.concat(F.lit("f"), F.col("k") % 9), F.col("k") * 4, number(0)))
    batches = e.select("user_id", F.col("us").alias("revision"), F.when(F.col("event_type") == "click", both).when(F.col("event_type") == "view", frame).otherwise(alone).alias("operations"))
    told, _ = assembly.edited(views, batches, ["user_id"], 5 * DAY)
    return told


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Errors break the days of each user: steps that miss their neighbour, actions that leave theirs, clocks with holes."""
    e = events(spark, d).withColumn("day", F.floor((F.col("us") - DAWN) / DAY))
    late = F.when(F.col("n_errors") > 1, HOUR).otherwise(0)
    days = e.groupBy("user_id", "day").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("n_errors"))
    steps = days.select("user_id", "day", (DAWN + F.col("day") * DAY + late).alias("start"), (DAWN + F.col("day") * DAY + DAY).alias("end"))
    executions = days.groupBy("user_id").agg((DAWN + F.min("day") * DAY).alias("start"), (DAWN + F.max("day") * DAY + F.when(F.col("user_id") % 9 > 0, DAY).otherwise(0)).alias("end"))
    actions = e.select("user_id", "event_id", (F.col("day") + F.when(F.col("k") == 0, 40).otherwise(0)).alias("day"), F.col("us").alias("start"), (F.col("us") + F.col("k").cast("long") * (HOUR // 60)).alias("end"))
    rules = [constraints.tiling(steps, executions, ["user_id"], "day"), constraints.hierarchy(actions, steps, ["user_id"], "event_id", "day"), constraints.dense(days, ["user_id"], "day")]
    rules += [constraints.aligned(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id"], "day"), constraints.increasing(e, ["user_id"], "k")]
    return constraints.all_of(rules)


QUERIES = {f.__name__: f for f in (extended_executions, owned_actions, boundary_edits, constraint_violations)}

ACTIONS = f"""{EVENTS}, a AS (SELECT user_id, event_id, CASE WHEN k % 4 = 0 THEN event_id - k % 7 - 1 END AS before, us AS start, us + k::BIGINT * {HOUR // 12} + {HOUR} AS "end" FROM e)"""
ORACLES = {
    "extended_executions": f"""WITH RECURSIVE {ACTIONS},
        r AS (SELECT 0 AS turn, user_id, {FIRST} AS start, {LAST} AS "end", coalesce(list(event_id) FILTER (start < {LAST} AND {FIRST} < "end"), []) AS ids, false AS done FROM a GROUP BY user_id
            UNION ALL
            SELECT turn + 1, user_id, least(start, low), greatest("end", high), more, coalesce(low >= start AND high <= "end", true)
            FROM (SELECT r.turn, r.user_id, r.start, r."end", coalesce(list(a.event_id) FILTER (a.event_id IS NOT NULL), []) AS more, min(a.start) AS low, max(a."end") AS high
                FROM r LEFT JOIN (SELECT a.*, p.event_id IS NOT NULL AS has FROM a LEFT JOIN a p ON p.user_id = a.user_id AND p.event_id = a.before) a
                    ON a.user_id = r.user_id AND (a.start < r."end" AND r.start < a."end" OR list_contains(r.ids, a.before) OR list_has_any(r.ids, (SELECT coalesce(list(s.event_id), []) FROM a s WHERE s.user_id = a.user_id AND s.before = a.event_id)))
                WHERE NOT r.done GROUP BY ALL))
        SELECT user_id, start, "end", start <> {FIRST} OR "end" <> {LAST} AS extended, len(ids) AS n_actions FROM r WHERE done""",
    "owned_actions": f"""WITH {ACTIONS}, s AS (SELECT DISTINCT user_id, k AS step, {FIRST} + k::BIGINT * {(LAST - FIRST) // 4} - CASE k WHEN 0 THEN {DAY} ELSE 0 END AS s, {FIRST} + (k + 1)::BIGINT * {(LAST - FIRST) // 4} + CASE k WHEN 3 THEN user_id % 3 * {HOUR}::BIGINT ELSE 0 END AS t FROM (SELECT user_id, unnest([0, 1, 2, 3]) AS k FROM e))
        SELECT user_id, step, event_id, start >= s AND start < t AS owner FROM a JOIN s USING (user_id) WHERE start < t AND s < "end" """,
    "boundary_edits": f"""WITH {EVENTS}, b AS (SELECT user_id, us AS revision, event_type AS kind, k, k % 9 AS name, row_number() OVER (PARTITION BY user_id, k % 9, event_type ORDER BY us) AS nth FROM e WHERE event_type IN ('click', 'view', 'error')),
        l AS (SELECT *, last_value(CASE WHEN kind = 'click' THEN k + 50 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY revision ROWS UNBOUNDED PRECEDING) AS edge,
                min(CASE WHEN kind = 'view' AND k * 4 <= 300 THEN revision END) OVER (PARTITION BY user_id, name) AS came FROM b),
        f AS (SELECT user_id, revision, CASE kind WHEN 'click' THEN NULL WHEN 'error' THEN CASE WHEN k + 50 <> coalesce(edge, 100) THEN 'steps must be ordered and tile execution' END
            ELSE CASE WHEN came < revision THEN 'duplicate or empty keyframe ID' WHEN k * 4 > 300 THEN 'keyframe outside automatic dense clock' END END AS reason FROM l)
        SELECT user_id, revision, reason IS NULL AS accepted, reason FROM f""",
    "constraint_violations": f"""WITH {EVENTS}, x AS (SELECT *, (us - {DAWN}) // {DAY} AS day FROM e), d AS (SELECT user_id, day, count(*) FILTER (event_type = 'error') > 1 AS late FROM x GROUP BY 1, 2),
        o AS (SELECT *, lag(day) OVER w AS b, lead(day) OVER w AS a FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
        c AS (SELECT x.*, k = 0 AS lost, late FROM x JOIN d USING (user_id, day))
        SELECT user_id, 'steps_do_not_tile' AS rule, day::VARCHAR AS "row" FROM o WHERE b IS NOT NULL AND (late OR b < day - 1)
        UNION ALL SELECT user_id, 'first_step_starts_elsewhere', day::VARCHAR FROM o WHERE b IS NULL AND late
        UNION ALL SELECT user_id, 'last_step_ends_elsewhere', day::VARCHAR FROM o WHERE a IS NULL AND user_id % 9 = 0
        UNION ALL SELECT user_id, 'unknown_parent', event_id::VARCHAR FROM c WHERE lost
        UNION ALL SELECT user_id, 'outside_parent', event_id::VARCHAR FROM c WHERE NOT lost AND ((us - {DAWN}) % {DAY} + k::BIGINT * {HOUR // 60} > {DAY} OR late AND (us - {DAWN}) % {DAY} < {HOUR})
        UNION ALL SELECT user_id, 'index_not_dense', day::VARCHAR FROM o WHERE a > day + 1
        UNION ALL SELECT user_id, 'clock_not_aligned', day::VARCHAR FROM x WHERE event_type IN ('click', 'view') GROUP BY user_id, day HAVING count(DISTINCT event_type) = 1
        UNION ALL SELECT user_id, 'time_not_increasing', k::VARCHAR FROM (SELECT user_id, k, unnest(range(2, count(*) + 1)) FROM e GROUP BY 1, 2)""",
}
