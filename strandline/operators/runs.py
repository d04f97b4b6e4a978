"""Runs of a time series: islands, runs of equal or falling values, unwrapping and sign continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def islands(df: DataFrame, by: list[str], time: str, gap: int, breaks: Column | None = None, tie: list[str] | None = None, to: str = "island") -> DataFrame:
    """df with the number (from 1) of the run its row is in; a step of more than ``gap``, or ``breaks``, starts a new one."""
    order = _in_order(by, [time, *(tie or [])])
    new = F.lag(time).over(order).isNull() | (F.col(time) - F.lag(time).over(order) > gap)
    if breaks is not None:
        new = new | F.coalesce(breaks, F.lit(False))
    return df.withColumn("_new", new.cast("long")).withColumn(to, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def value_runs(df: DataFrame, by: list[str], time: str, value: str, to: str = "run") -> DataFrame:
    """df with the number of the run of equal values (null is a value) its row is in."""
    order = _in_order(by, [time])
    new = F.lag(time).over(order).isNull() | ~F.lag(value).over(order).eqNullSafe(F.col(value))
    return df.withColumn("_new", new.cast("long")).withColumn(to, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def monotone_runs(df: DataFrame, by: list[str], time: str, value: str, to: str = "run") -> DataFrame:
    """df with the number of the run of strictly falling values its row is in."""
    order = _in_order(by, [time])
    new = F.lag(value).over(order).isNull() | (F.col(value) >= F.lag(value).over(order))
    return df.withColumn("_new", new.cast("long")).withColumn(to, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def unwrapped(df: DataFrame, by: list[str], time: str, angle: str, to: str = "unwrapped") -> DataFrame:
    """df with the angle (radians) made continuous: the first one plus all wrapped steps."""
    order = _in_order(by, [time])
    step = F.col(angle) - F.lag(angle).over(order)
    wrapped = F.atan2(F.sin(step), F.cos(step))
    steps = df.withColumn("_step", F.coalesce(wrapped, F.col(angle)))
    return steps.withColumn(to, F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_step")


def sign_continuous(df: DataFrame, by: list[str], time: str, components: list[str]) -> DataFrame:
    """df with vectors that mean the same with either sign flipped so that no one opposes the one before it; flipped says which."""
    order = _in_order(by, [time])
    dot = sum((F.col(c) * F.lag(c).over(order) for c in components[1:]), F.col(components[0]) * F.lag(components[0]).over(order))
    turns = df.withColumn("_turn", F.when(dot < 0, 1).otherwise(0))
    odd = F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2
    sign = F.when(F.col("flipped"), -1.0).otherwise(1.0)
    return turns.withColumn("flipped", odd == 1).withColumns({c: F.col(c) * sign for c in components}).drop("_turn")


def filled(df: DataFrame, by: list[str], time: str, value: str, gap: int) -> DataFrame:
    """df with nulls of the value interpolated linearly between known neighbours at most ``gap`` apart; state says how."""
    known = F.when(F.col(value).isNotNull(), F.struct(time, value))
    back = F.last(known, ignorenulls=True).over(_in_order(by, [time]).rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(known, ignorenulls=True).over(_in_order(by, [time]).rowsBetween(1, Window.unboundedFollowing))
    rows = df.withColumns({"_back": back, "_ahead": ahead})
    a, b = F.col("_back"), F.col("_ahead")
    near = (b[time] - a[time]) <= gap
    between = a[value] + (b[value] - a[value]) * ((F.col(time) - a[time]) / (b[time] - a[time]))
    state = F.when(F.col(value).isNotNull(), "observed").when(near, "interpolated").otherwise("unknown")
    return rows.withColumn("state", state).withColumn(value, F.when(F.col("state") == "interpolated", between).otherwise(F.col(value))).drop("_back", "_ahead")
