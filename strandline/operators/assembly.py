"""What an execution is made of: how far it reaches over connected actions, its steps, the actions' owners, and edits of both.

Tables have the key columns and start and end of spans; spans overlap if they
share more than an end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.carried import carried
from strandline.operators.storage import stored


def _overlaps(start: str, end: str, other_start: str, other_end: str):
    return (F.col(start) < F.col(other_end)) & (F.col(other_start) < F.col(end))


def extended(executions: DataFrame, actions: DataFrame, by: list[str], id_column: str, previous: str) -> tuple[DataFrame, DataFrame]:
    """by, start, end, extended of each execution; and by and the id of the actions that it takes in.

    An execution reaches over every action that overlaps it or is linked to one that it has, as its predecessor or its
    successor, until that doesn't extend it any more. Rounds are joins over all executions at once; one that has stopped
    growing takes no part in later rounds. There is one execution for a key; keys aren't null.
    """
    spans = actions.select(*by, F.col(id_column).alias("_id"), F.col(previous).alias("_before"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    linked = spans.filter("_before is not null").select(*by, F.col("_id").alias("_near"), F.col("_before").alias("_id"))
    links = stored(linked.unionByName(linked.select(*by, F.col("_id").alias("_near"), F.col("_near").alias("_id"))).distinct())
    now = stored(executions.select(*by, "start", "end", F.col("start").alias("_start"), F.col("end").alias("_end"), F.lit(False).alias("done")))
    chosen = stored(spans.join(now, by).filter(_overlaps("_from", "_to", "start", "end")).select(*by, "_id"))
    while not now.filter("not done").isEmpty():
        open_ = now.filter("not done").select(*by, "start", "end")
        near = chosen.join(links.withColumnRenamed("_id", "_other").withColumnRenamed("_near", "_id"), [*by, "_id"]).select(*by, F.col("_other").alias("_id")).distinct().withColumn("linked", F.lit(True))
        taken = spans.join(open_, by).join(near, [*by, "_id"], "left").filter(_overlaps("_from", "_to", "start", "end") | F.col("linked"))
        taken = stored(taken.select(*by, "_id", "_from", "_to"))
        reach = taken.groupBy(*by).agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
        grown = now.join(reach, by, "left").withColumns({"_from": F.least("start", "_from"), "_to": F.greatest("end", "_to")})
        chosen = stored(chosen.join(open_, by, "left_anti").unionByName(taken.select(*by, "_id")))
        now = stored(grown.select(*by, F.when(F.col("done"), F.col("start")).otherwise(F.col("_from")).alias("start"), F.when(F.col("done"), F.col("end")).otherwise(F.col("_to")).alias("end"), "_start", "_end", (F.col("done") | (F.col("start") == F.col("_from")) & (F.col("end") == F.col("_to"))).alias("done")))
    told = now.select(*by, "start", "end", ((F.col("start") != F.col("_start")) | (F.col("end") != F.col("_end"))).alias("extended"))
    return told, chosen.select(*by, F.col("_id").alias(id_column))


def retiled(steps: DataFrame, executions: DataFrame, by: list[str]) -> DataFrame:
    """steps with the first one starting and the last one ending where their execution does."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    ends = steps.withColumns({"_first": F.row_number().over(order) == 1, "_last": F.lead("start").over(order).isNull()})
    both = ends.join(executions.select(*by, F.col("start").alias("_from"), F.col("end").alias("_to")), by)
    edges = {"start": F.when(F.col("_first"), F.col("_from")).otherwise(F.col("start")), "end": F.when(F.col("_last"), F.col("_to")).otherwise(F.col("end"))}
    return both.withColumns(edges).select(*steps.columns)


def step_actions(steps: DataFrame, actions: DataFrame, by: list[str], step_id: str, action_id: str) -> DataFrame:
    """by, step, action and owner of every pair that overlaps; the owner is the step in which the action starts."""
    s = steps.select(*by, F.col(step_id), F.col("start").alias("_start"), F.col("end").alias("_end"))
    both = actions.select(*by, action_id, "start", "end").join(s, by)
    owner = (F.col("_start") <= F.col("start")) & (F.col("start") < F.col("_end"))
    return both.filter(_overlaps("start", "end", "_start", "_end") | owner).select(*by, step_id, action_id, owner.alias("owner"))


#: Fixed reasons for which a batch of edits is refused.
UNKNOWN_STEP, REPEATED_FRAME, UNKNOWN_FRAME = "unknown boundary target", "duplicate or empty keyframe ID", "deleted or unknown keyframe target"
OFF_CLOCK, NOT_TILED, NOT_COVERED, EMPTY = "keyframe outside automatic dense clock", "steps must be ordered and tile execution", "steps must cover execution", "interval must end after it starts"


def _edited(view: dict, operations: list[dict]) -> str | None:
    """Apply a batch to a view; the reason against it, if there is one."""
    for op in operations:
        kind, target = op["kind"], op["target"]
        if kind == "boundary":
            if op["start"] is None or op["end"] is None or op["start"] >= op["end"]:
                return EMPTY
            if target == view["id"]:
                view["execution"] = [op["start"], op["end"]]
            elif target in view["steps"]:
                view["steps"][target] = [op["start"], op["end"]]
            else:
                return UNKNOWN_STEP
        elif kind == "add":
            if not target or target in view["frames"] or target in view["steps"] or target == view["id"]:
                return REPEATED_FRAME
            view["frames"][target] = op["start"]
        elif target not in view["frames"]:
            return UNKNOWN_FRAME
        elif kind == "remove":
            del view["frames"][target]
        else:
            view["frames"][target] = op["start"]
        if kind in ("add", "move") and (op["start"] is None or not view["clock"][0] <= op["start"] <= view["clock"][1]):
            return OFF_CLOCK
    edge = view["execution"][0]
    for name in view["order"]:
        start, end = view["steps"][name]
        if start != edge:
            return NOT_TILED
        edge = end
    return None if edge == view["execution"][1] else NOT_COVERED


def edited(views: DataFrame, batches: DataFrame, by: list[str], span: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """by, revision, accepted and reason of each batch of edits; and by, kind (execution, step or frame), name, start, end of what results.

    views has by, id, clock_from, clock_to (the times that keyframes may have), start, end, steps (an array of (name, start,
    end) in order) and frames (of (name, at)), one row for a key. batches has by, revision (a number from 1 on) and
    operations, an array of (kind, target, start, end): kind is boundary (of the execution by its id, or of a step), add,
    move or remove (of a keyframe, start is its time). A batch holds whole or not at all: steps must tile the execution
    after it. A refused batch leaves the view as it was. Edits of a key depend on each other; logs of many edits are
    walked in buckets of ``span`` revisions.
    """
    struct = "struct<id: string, clock_from: long, clock_to: long, start: long, end: long, steps: array<struct<name: string, start: long, end: long>>, frames: array<struct<name: string, at: long>>>"
    first = views.select(*by, F.lit(0).cast("long").alias("revision"), F.lit(None).cast("array<struct<kind: string, target: string, start: long, end: long>>").alias("operations"), F.struct("id", "clock_from", "clock_to", "start", "end", "steps", "frames").cast(struct).alias("view"))
    log = batches.select(*by, F.col("revision").cast("long").alias("revision"), F.col("operations").cast("array<struct<kind: string, target: string, start: long, end: long>>").alias("operations"), F.lit(None).cast(struct).alias("view"))

    def step(state: dict, emit, revision: int, operations: list[dict] | None, view: dict | None) -> None:
        if view is not None:
            steps = view["steps"] or []
            state["view"] = {"id": view["id"], "clock": [view["clock_from"], view["clock_to"]], "execution": [view["start"], view["end"]], "order": [s["name"] for s in steps], "steps": {s["name"]: [s["start"], s["end"]] for s in steps}, "frames": {f["name"]: f["at"] for f in view["frames"] or []}}
            return
        if state["view"] is None:
            emit((revision, False, UNKNOWN_STEP, None, None, None, None))
            return
        was = state["view"]
        tried = was | {"execution": list(was["execution"]), "steps": dict(was["steps"]), "frames": dict(was["frames"])}
        reason = _edited(tried, operations or [])
        if reason is None:
            state["view"] = tried
        emit((revision, reason is None, reason, None, None, None, None))

    def finish(state: dict, emit) -> None:
        view = state["view"]
        if view is not None:
            emit((None, None, None, "execution", view["id"], *view["execution"]))
            for name in view["order"]:
                emit((None, None, None, "step", name, *view["steps"][name]))
            for name, at in sorted(view["frames"].items()):
                emit((None, None, None, "frame", name, at, at))

    out = carried(first.unionByName(log), by, "revision", span, ["operations", "view"], {"view": None}, step, "revision long, accepted boolean, reason string, kind string, name string, start long, end long", finish)
    out = stored(out)
    return out.filter("revision is not null").select(*by, "revision", "accepted", "reason"), out.filter("kind is not null").select(*by, "kind", "name", "start", "end")
