"""Recordings and their channels: checks on ingest, paired files, clocks, grids, variants, and levels of a signal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import asof


def ingest_violations(sources: DataFrame, camera: str, digest: str) -> DataFrame:
    """check, value, n: camera ids and content hashes that more than one source has; too_few_sources below two."""
    repeated = [sources.groupBy(F.lit(f"repeated_{c}").alias("check"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).filter("n > 1") for c in (camera, digest)]
    few = sources.agg(F.count("*").alias("n")).filter("n < 2").select(F.lit("too_few_sources").alias("check"), F.lit(None).cast("string").alias("value"), "n")
    return reduce(DataFrame.unionByName, [*repeated, few])


def paired_files(files: DataFrame, path: str, pattern: str, kinds: list[str]) -> DataFrame:
    """form, view, one path column for each kind, and state: paired, incomplete, repeated, or unknown_layout.

    The pattern's groups are form, view and kind. A path that doesn't match, or has another kind, stands alone.
    """
    parts = {n: F.regexp_extract(path, pattern, i + 1) for i, n in enumerate(("form", "view", "kind"))}
    rows = files.withColumns(parts).withColumn("_known", F.col("kind").isin(kinds))
    known = rows.filter("_known").groupBy("form", "view").agg(*(F.min(F.when(F.col("kind") == k, F.col(path))).alias(k) for k in kinds), *(F.count_if(F.col("kind") == k).alias(f"_{k}") for k in kinds))
    most, least = F.greatest(*(f"_{k}" for k in kinds)), F.least(*(f"_{k}" for k in kinds))
    paired = known.withColumn("state", F.when(most > 1, "repeated").when(least == 0, "incomplete").otherwise("paired")).select("form", "view", *kinds, "state")
    unknown = rows.filter("not _known").select(F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("view"), *((F.col(path) if i == 0 else F.lit(None).cast("string")).alias(k) for i, k in enumerate(kinds)), F.lit("unknown_layout").alias("state"))
    return paired.unionByName(unknown)


def time_mapping(times: DataFrame, frames: DataFrame, by: list[str], time: str, frame: str, gap: int) -> DataFrame:
    """times with the frames before, after and nearest (the earlier of two), and whether they lie in a gap of the frames (none on a side counts)."""
    rows = asof.bracket(times, frames, by, time, [frame])
    before, after = F.col("before"), F.col("after")
    early = after.isNull() | (F.col(time) - before[time] <= after[time] - F.col(time))
    nearest = F.when(before.isNotNull() & early, before[frame]).otherwise(after[frame])
    in_gap = F.coalesce(after[time] - before[time] > gap, F.lit(True))
    out = rows.withColumns({"_nearest": nearest, "in_gap": in_gap, "_before": before[frame], "_after": after[frame]})
    return out.drop("before", "after").withColumnsRenamed({"_nearest": "nearest", "_before": "before", "_after": "after"})


def resampled(samples: DataFrame, by: list[str], time: str, value: str, step: int) -> DataFrame:
    """The value on a grid of multiples of ``step`` that covers each key, linear between samples, the end samples held beyond them."""
    extent = samples.groupBy(*by).agg(F.floor(F.min(time) / step).alias("_low"), F.ceil(F.max(time) / step).alias("_high"))
    grid = extent.select(*by, F.explode(F.transform(F.sequence("_low", "_high"), lambda i: i * step)).alias(time))
    rows = asof.bracket(grid, samples, by, time, [value])
    held = F.coalesce(asof.lerp(time, value), F.col("before")[value], F.col("after")[value])
    return rows.select(*by, time, held.alias(value))


def re_timed(frames: DataFrame, time: str, low: Column, factor: float, dropped: DataFrame, ordinal: str) -> DataFrame:
    """Frames but the dropped ordinals, with ``source_time`` and their time in the variant: from ``low`` on, slowed by the factor."""
    kept = frames.join(dropped.select(ordinal).distinct(), ordinal, "left_anti")
    return kept.withColumn("source_time", F.col(time)).withColumn(time, F.round((F.col(time) - low) * factor).cast("long"))


def chunk_levels(df: DataFrame, by: list[str], value: str, clip: float) -> DataFrame:
    """Root mean square of each chunk, and the share of its samples at or beyond the clip level."""
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.avg((F.abs(value) >= clip).cast("double")).alias("clipped"))


def top_decile(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The mean of each key's largest tenth of values (one at least)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))
    rows = df.withColumns({"_rank": rank, "_n": F.count("*").over(Window.partitionBy(*by))})
    return rows.filter(F.col("_rank") <= F.ceil(F.col("_n") / 10)).groupBy(*by).agg(F.avg(value).alias("energy"), F.count("*").alias("n"))


def event_quality(evidence: DataFrame, by: list[str], sigma: str, score: str, source: str) -> DataFrame:
    """The worst uncertainty and score of each event's evidence, and its sources in order; duplicates are merged before the shuffle."""
    merged = evidence.groupBy(*by, source).agg(F.max(sigma).alias("_sigma"), F.min(score).alias("_score"))
    return merged.groupBy(*by).agg(F.max("_sigma").alias("sigma"), F.min("_score").alias("score"), F.array_sort(F.collect_list(source)).alias("sources"))


def accepted_revisions(edits: DataFrame, by: list[str], order: str, expected: str) -> DataFrame:
    """Edits with the revision that an optimistic log gives them: accepted only if they expect the number of those accepted before, else null.

    Each edit depends on all before it, so that a key is one fold: keys are for logs written by hand.
    """

    def step(state: Column, edit: Column) -> Column:
        fits = edit["expected"] == state["revision"]
        told = F.struct(edit["order"].alias("order"), F.when(fits, state["revision"] + 1).alias("revision"))
        return F.struct((state["revision"] + F.when(fits, 1).otherwise(0)).alias("revision"), F.concat(state["told"], F.array(told)).alias("told"))

    rows = edits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(expected).cast("long").alias("expected")))).alias("_log"))
    start = F.struct(F.lit(0).cast("long").alias("revision"), F.expr(f"cast(array() as array<struct<order:{dict(edits.dtypes)[order]},revision:bigint>>)").alias("told"))
    folded = rows.select(*by, F.inline(F.aggregate("_log", start, step, lambda s: s["told"])))
    return folded.withColumnRenamed("order", order)
