"""Rules that related series must keep, each as the rows that break it: by, rule and the row's time, id or index as text.

A rule is a window or a join; it finds all of its violations at once instead of
stopping at the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed names of the rules.
UNORDERED, GAP, FIRST_EDGE, LAST_EDGE = "time_not_increasing", "steps_do_not_tile", "first_step_starts_elsewhere", "last_step_ends_elsewhere"
ORPHAN, OUTSIDE, NOT_DENSE, NOT_ALIGNED, NO_STEP = "unknown_parent", "outside_parent", "index_not_dense", "clock_not_aligned", "execution_without_steps"


def _broken(df: DataFrame, by: list[str], rule: str, wrong: Column, row: str) -> DataFrame:
    return df.filter(wrong).select(*by, F.lit(rule).alias("rule"), F.col(row).cast("string").alias("row"))


def all_of(rules: list[DataFrame]) -> DataFrame:
    """The violations of all rules."""
    return reduce(DataFrame.unionByName, rules)


def increasing(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """Rows whose time another row of their key has, too, and rows without one; the first of equals breaks nothing."""
    order = Window.partitionBy(*by, time).orderBy(F.lit(0))
    return _broken(df.withColumn("_nth", F.row_number().over(order)), by, UNORDERED, F.col(time).isNull() | (F.col("_nth") > 1), time)


def tiling(steps: DataFrame, executions: DataFrame, by: list[str], step_id: str) -> DataFrame:
    """Steps that don't begin where the one before ends, or the execution's edges that the first and last don't meet.

    steps have start and end and no null keys, executions are one row (start, end) for a key.
    """
    order = Window.partitionBy(*by).orderBy("start", "end", step_id)
    s = steps.select(*by, step_id, "start", "end").withColumns({"_before": F.lag("end").over(order), "_last": F.lead("start").over(order).isNull(), "_first": F.lag("start").over(order).isNull()})
    both = s.join(executions.select(*by, F.col("start").alias("_from"), F.col("end").alias("_to")), by, "left")
    return all_of(
        [
            _broken(both, by, GAP, ~F.col("_first") & (F.col("start") != F.col("_before")), step_id),
            _broken(both, by, FIRST_EDGE, F.col("_first") & ~F.col("start").eqNullSafe(F.col("_from")), step_id),
            _broken(both, by, LAST_EDGE, F.col("_last") & ~F.col("end").eqNullSafe(F.col("_to")), step_id),
            _broken(executions.join(steps.select(*by).distinct(), by, "left_anti"), by, NO_STEP, F.lit(True), "start"),
        ]
    )


def hierarchy(children: DataFrame, parents: DataFrame, by: list[str], child_id: str, parent_id: str) -> DataFrame:
    """Children (with start, end and parent_id) whose parent isn't there, or whose span isn't within its."""
    p = parents.select(*by, parent_id, F.col("start").alias("_from"), F.col("end").alias("_to"), F.lit(True).alias("_there"))
    both = children.select(*by, child_id, parent_id, "start", "end").join(p, [*by, parent_id], "left")
    within = (F.col("_from") <= F.col("start")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("_to"))
    return _broken(both, by, ORPHAN, F.col("_there").isNull(), child_id).unionByName(_broken(both, by, OUTSIDE, F.col("_there").isNotNull() & ~F.coalesce(within, F.lit(False)), child_id))


def dense(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Rows after whose index the next one of their key doesn't follow at once; several rows of an index count once."""
    order = Window.partitionBy(*by).orderBy(index)
    named = df.select(*by, index).distinct().withColumn("_next", F.lead(index).over(order))
    return _broken(named, by, NOT_DENSE, F.col(index).isNull() | (F.col("_next") > F.col(index) + 1), index)


def aligned(a: DataFrame, b: DataFrame, by: list[str], time: str) -> DataFrame:
    """Times of a key that one of two series has and the other hasn't."""
    counted = [x.select(*by, time, F.lit(k).alias("_side")) for k, x in enumerate((a, b))]
    sides = counted[0].unionByName(counted[1]).groupBy(*by, time).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high"))
    return _broken(sides, by, NOT_ALIGNED, F.col("_low") == F.col("_high"), time)
