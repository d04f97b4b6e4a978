"""As-of, nearest and bracket joins of two time series.

Rows of both sides are merged by key and time and a window carries the last
right row forward. Time is cut into buckets, and what a bucket inherits is
carried over a small table of buckets, so that a key with a large share of all
rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.storage import free_names

#: Microseconds in a bucket.
BUCKET = 86_400_000_000


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, payload: list[str], direction: str = "backward", bucket: int = BUCKET, to: str = "match") -> DataFrame:
    """left with a struct of right's time and payload: its last row at or before (or first at or after) the time, or null.

    Right rows at one time count in the order of their payload, the last one wins. A null in a key or time matches nothing. left has no
    column of the struct's name; its others may have any.
    """
    if to in left.columns:
        raise ValueError(f"the left side has a column {to} already")
    right = right.dropna(subset=[*by, time])
    sign = 1 if direction == "backward" else -1
    clock = F.col(time) * sign
    t, row, side, cell, inner, outer, end = free_names(["t", "r", "side", "bucket", "own", "carried", "end"], [*left.columns, *by, time])
    rights = right.select(*by, clock.alias(t), F.struct(time, *payload).alias(row), F.lit(0).alias(side))
    lefts = left.withColumns({t: clock, side: F.lit(1)})
    rows = lefts.unionByName(rights, allowMissingColumns=True).withColumn(cell, F.floor(F.col(t) / bucket))
    own = Window.partitionBy(*by, cell).orderBy(t, side, row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn(inner, F.last(row, ignorenulls=True).over(own)).filter(F.col(side) == 1)
    ends = rows.groupBy(*by, cell).agg(F.max(F.when(F.col(side) == 0, F.struct(t, row))).alias(end))
    before = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, cell, F.last(end, ignorenulls=True).over(before)[row].alias(outer))
    return seen.join(carried, [*by, cell], "left").withColumn(to, F.coalesce(inner, outer)).select(*left.columns, to)


def bracket(left: DataFrame, right: DataFrame, by: list[str], time: str, payload: list[str], bucket: int = BUCKET) -> DataFrame:
    """left with structs before and after: the right rows around its time; both are the same row at an exact time."""
    once = asof(left, right, by, time, payload, "backward", bucket, "before")
    return asof(once, right, by, time, payload, "forward", bucket, "after")


def nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, payload: list[str], tolerance: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """left with a struct match: the right row nearest in time, the earlier one of two, within the tolerance."""
    both = bracket(left, right, by, time, payload, bucket)
    back, ahead = F.col(time) - F.col("before")[time], F.col("after")[time] - F.col(time)
    match = F.when(ahead.isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))
    if tolerance is not None:
        match = F.when(F.abs(match[time] - F.col(time)) <= tolerance, match)
    return both.withColumn("match", match).drop("before", "after")


def weight(time: str) -> Column:
    """Where a bracketed time lies between before (0) and after (1)."""
    span = F.col("after")[time] - F.col("before")[time]
    return F.when(span == 0, F.lit(0.0)).otherwise((F.col(time) - F.col("before")[time]) / span)


def lerp(time: str, value: str) -> Column:
    """The linear interpolation of a bracketed value; null outside the right side's extent."""
    w = weight(time)
    return F.col("before")[value] * (1 - w) + F.col("after")[value] * w


def snapshot_state(time: str, start: str, end: str, gap: int) -> Column:
    """How a backward snapshot may be used: outside_execution, native, native_snapshot or native_time_gap.

    match is the row before, next_time the time of the one after; more than ``gap`` between these two is a gap.
    """
    exact = F.col("match")[time] == F.col(time)
    outside = F.col("match").isNull() | (F.col(time) < F.col(start)) | (F.col(time) > F.col(end))
    wide = F.col("next_time").isNull() | (F.col("next_time") - F.col("match")[time] > gap)
    return F.when(outside, "outside_execution").when(exact, "native").when(wide, "native_time_gap").otherwise("native_snapshot")
