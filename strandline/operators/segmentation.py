"""Spans of activity, executions and their steps, proofs of an increase: per key in order of time, by windows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import intervals, runs


def activity_spans(df: DataFrame, by: list[str], time: str, state: str, gap: int, quiet: int, least: int) -> DataFrame:
    """start, end, n of each span of moving rows (state 1) that lasts ``least``.

    A span ends at a step above ``gap``, at an unknown state (null) and once quiet rows (state 0) last for ``quiet``.
    """
    order = Window.partitionBy(*by).orderBy(time)
    unknown = F.col(state).isNull() | F.lag(state).over(order).isNull()
    rows = runs.islands(df, by, time, gap, breaks=unknown, to="_island").filter(F.col(state).isNotNull())
    inside = Window.partitionBy(*by, "_island").orderBy(time)
    rows = rows.withColumns({"_next": F.lead(time).over(inside), "_before": F.lag(time).over(inside), "_was": F.lag(state).over(inside)})
    moving = rows.filter(F.col(state) == 1)
    rested = (F.col("_was") == 0) & (F.col("_before") - F.lag("_next").over(inside) >= quiet)
    new = (F.lag(time).over(inside).isNull() | F.coalesce(rested, F.lit(False))).cast("long")
    moving = moving.withColumn("_new", new).withColumn("_span", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = moving.groupBy(*by, "_island", "_span").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))
    return spans.filter(F.col("end") - F.col("start") >= least).drop("_island", "_span")


def executions(
    df: DataFrame, by: list[str], time: str, busy: str, quiet: str, covered: str, track: str, opens: list[str],
    *, gap: int, least: int, tracks: int, hold: int, edge: int, step_quiet: int, coverage: float, unknown: int,
) -> DataFrame:
    """Each key's execution as steps (verdict, step, start, end, score), or one row with the first reason against it.

    busy: a track other than the head moves; quiet: all limbs are known and none moves; covered: all limbs are known;
    opens: per foot true where it lifts or starts to turn, false where it comes to rest, else null. The execution goes
    from the first bout of activity of at least ``least`` to the first row ``hold`` after the last bout. A bout starts a
    step after ``step_quiet`` of quiet rows alone, unless a foot is still open.
    """
    order = Window.partitionBy(*by).orderBy(time)
    whole, ever = Window.partitionBy(*by), Window.unboundedPreceding
    t = F.col(time)
    rows = runs.value_runs(df, by, time, busy, "_run")
    run = Window.partitionBy(*by, "_run")
    rows = rows.withColumn("_bout", F.col(busy) & (F.max(t).over(run) - F.min(t).over(run) >= least))
    rows = runs.value_runs(rows, by, time, covered, "_cover")
    rows = rows.withColumns({"_next": F.lead(t).over(order), "_before": F.lag(t).over(order), "_ahead": F.lead(covered).over(order)})
    bouts = F.when(F.col("_bout"), t)
    rows = rows.withColumns({"_first": F.min(bouts).over(whole), "_last": F.max(bouts).over(whole), "_final": F.max(t).over(whole), "_start": F.min(t).over(whole)})
    rows = rows.withColumn("_end", F.min(F.when((t > F.col("_last")) & (t >= F.col("_last") + hold), t)).over(whole))
    first, last, end = F.col("_first"), F.col("_last"), F.col("_end")
    cover = Window.partitionBy(*by, "_cover")
    open_run = F.when(~F.col(covered) & t.between(first, end), F.least(end, F.max("_next").over(cover)) - F.greatest(first, F.min("_before").over(cover)))
    rows = rows.withColumns({"_open": F.coalesce(open_run, F.when(~F.col(covered) & t.between(first, end), end - first)), "_noisy": F.sum((~F.col(quiet)).cast("long")).over(order.rowsBetween(ever, Window.currentRow))})
    past = order.rowsBetween(ever, -1)
    calm = F.last(F.when(F.col("_bout"), F.col("_noisy")), ignorenulls=True).over(past) == F.lag("_noisy").over(order)
    rested = t - F.last(bouts, ignorenulls=True).over(past) >= step_quiet
    held = [F.coalesce(F.last(F.when(t >= first, F.col(c)), ignorenulls=True).over(past), F.lit(False)) for c in opens]
    cut = F.col("_bout") & (F.lag("_run").over(order) != F.col("_run")) & rested & calm
    for c in held:
        cut = cut & ~c
    pre, post = (t < first) & (t >= first - edge), (t > last) & (t <= end + edge)
    share = F.sum(F.when((t >= first) & (t < end) & F.col(covered) & F.col("_ahead"), F.col("_next") - t).otherwise(0)).over(whole) / F.when(end > first, end - first)
    rows = rows.withColumns({
        "_cut": F.coalesce(cut, F.lit(False)) | (t == first),
        "_gap": F.max(F.col("_next") - t).over(whole),
        "_tracks": F.size(F.collect_set(F.when(F.col(busy) & t.between(first, last), F.col(track))).over(whole)),
        "_edges": F.coalesce(F.bool_or(pre).over(whole) & F.bool_or(post).over(whole) & F.bool_and(F.when(pre | post, F.col(quiet))).over(whole), F.lit(False)),
        "_share": share,
        "_worst": F.coalesce(F.max("_open").over(whole), F.lit(0)),
    })
    verdict = (
        F.when(F.col("_gap") > gap, "native_sampling_gap")
        .when(first.isNull(), "no_sustained_activity")
        .when(F.col("_tracks") < tracks, "insufficient_multi_track_activity")
        .when(end.isNull() | (F.col("_final") - end < edge), "terminal_hold_or_post_roll_not_observed")
        .when(first - F.col("_start") < edge, "pre_roll_not_observed")
        .when(~F.col("_edges"), "edge_context_unknown_or_active")
        .when((F.col("_share") < coverage) | (F.col("_worst") > unknown), "insufficient_continuous_evidence")
        .otherwise("segmented")
    )
    rows = rows.withColumn("verdict", verdict)
    told = F.col("verdict") == "segmented"
    kept = rows.filter(F.when(told, F.col("_cut") & (t < end)).otherwise(t == F.col("_start")))
    steps = {"step": F.when(told, F.row_number().over(order) - 1), "start": F.when(told, t), "end": F.when(told, F.coalesce(F.lead(t).over(order), end)), "score": F.when(told, F.col("_share"))}
    return kept.withColumns(steps).select(*by, "verdict", "step", "start", "end", "score")


def proven_increase(df: DataFrame, by: list[str], time: str, value: str, sigma: str, prominence: float, multiple: float) -> DataFrame:
    """at: when each key's value has first risen over its first one by more than the prominence and the uncertainties; all rows until then must be known."""
    order = Window.partitionBy(*by).orderBy(time)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    margin = F.greatest(F.lit(prominence), multiple * (F.first(sigma).over(so_far) + F.max(sigma).over(so_far)))
    known = F.bool_and(F.col(value).isNotNull() & F.col(sigma).isNotNull()).over(so_far)
    rows = df.withColumn("_proven", known & (F.col(value) - F.first(value).over(so_far) > margin))
    return rows.groupBy(*by).agg(F.min(F.when(F.col("_proven"), F.col(time))).alias("at"))


def covered_spans(df: DataFrame, by: list[str], time: str, valid: str, gap: int) -> DataFrame:
    """start, end, n_spans of the time that valid rows cover: their instants, and what lies between two at most ``gap`` apart with none invalid between."""
    order = Window.partitionBy(*by).orderBy(time)
    joined = F.lead(valid).over(order) & (F.lead(time).over(order) - F.col(time) <= gap)
    spans = df.withColumn("end", F.when(joined, F.lead(time).over(order)).otherwise(F.col(time))).filter(F.col(valid))
    return intervals.merge_spans(spans.select(*by, F.col(time).alias("start"), "end"), by)


def keyframe_anchors(df: DataFrame, by: list[str], time: str, is_key: Column, low: int, high: int) -> DataFrame:
    """The rows whose ordinal is in [low, high], with the ordinal of the keyframe that decoding has to start from."""
    order = Window.partitionBy(*by).orderBy(time)
    rows = df.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    anchor = F.last(F.when(is_key, F.col("ordinal")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("anchor", anchor).filter(F.col("ordinal").between(low, high))
