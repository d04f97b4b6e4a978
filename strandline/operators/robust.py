"""Robust aggregates: percentile scaling, medians with outlier cuts, coverage in time, travelled paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.storage import free_names, stored

#: Makes a median of absolute deviations comparable to a standard deviation.
MAD_SCALE = 1.4826


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, place (of a share in the list), quantile: exact, in a straight line between the two nearest ranks; nulls don't count.

    Values are dealt out by range and counted there, which tells the range and the place in it of each rank: a key with many
    values is spread over many tasks, and none holds its values. Values that are equal are told apart by where they came
    from, so that they may lie in several ranges. Keys aren't null.
    """
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.filter(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("nth"))
    laid = stored(rows.repartitionByRange(*keys, "v", "nth").select(*keys, "v", F.spark_partition_id().alias("part")))
    of_key = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = laid.groupBy(*keys, "part").agg(F.count("*").alias("n")).withColumns({"before": before, "all": F.sum("n").over(of_key)})
    asked = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)))
    ranks = counts.select("*", F.inline(asked)).withColumn("at", F.col("share") * (F.col("all") - 1))
    ranks = ranks.select(*keys, "part", "before", "n", "place", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    picks = stored(ranks.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).drop("n"))
    holding = laid.join(picks.select(*keys, "part", "before").distinct(), [*keys, "part"])
    numbered = holding.select(*keys, "v", (F.col("before") + F.row_number().over(Window.partitionBy(*keys, "part").orderBy("v")) - 1).alias("rank"))
    found = picks.select(*keys, "place", "at", "rank").join(numbered, [*keys, "rank"])
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    out = found.groupBy(*keys, "place").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("quantile"))
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), "place", "quantile")


def normalised(df: DataFrame, by: list[str], value: str, low: float = 0.1, high: float = 0.95, to: str = "normalized") -> DataFrame:
    """df with the value scaled from its key's low percentile, over the larger of high - low and max - low, cut to [0, 1]; null without spread."""
    p, top = free_names(["p", "max"], df.columns)
    found = quantiles(df, by, value, [low, high])
    ends = found.groupBy(*by).agg(*(F.max(F.when(F.col("place") == k, F.col("quantile"))).alias(f"{p}{k}") for k in (0, 1)))
    bounds = ends.join(df.groupBy(*by).agg(F.max(value).alias(top)), by)
    spread = F.greatest(F.col(f"{p}1") - F.col(f"{p}0"), F.col(top) - F.col(f"{p}0"))
    scaled = F.when(spread > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col(f"{p}0")) / spread)))
    return df.join(bounds, by).withColumn(to, scaled).drop(f"{p}0", f"{p}1", top)


def robust_estimate(df: DataFrame, by: list[str], value: str, cut: float = 3.5) -> DataFrame:
    """For each key: n, center (median), dispersion (scaled MAD), and n_kept and estimate without values beyond cut dispersions."""
    median = df.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("center"))
    off = df.join(median, by).withColumn("_off", F.abs(F.col(value) - F.col("center")))
    mad = off.groupBy(*by).agg((F.median("_off") * MAD_SCALE).alias("dispersion"))
    kept = off.join(mad, by).filter(F.col("_off") <= F.col("dispersion") * cut)
    estimate = kept.groupBy(*by).agg(F.count("*").alias("n_kept"), F.median(value).alias("estimate"))
    return median.join(mad, by).join(estimate, by, "left")


def neighbour_median(df: DataFrame, by: list[str], time: str, value: str, radius: int, to: str = "local_median") -> DataFrame:
    """df with the median of the ``radius`` values before and after a row, its own left out."""
    order = Window.partitionBy(*by).orderBy(time)
    around = F.sort_array(F.array_compact(F.concat(F.collect_list(value).over(order.rowsBetween(-radius, -1)), F.collect_list(value).over(order.rowsBetween(1, radius)))))
    n = F.size("_around")
    middle = (F.get("_around", F.floor((n - 1) / 2).cast("int")) + F.get("_around", F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("_around", around).withColumn(to, middle).drop("_around")


def coverage(df: DataFrame, by: list[str], time: str, covered: Column) -> DataFrame:
    """For each key the share of its time between rows that are both covered; null for a single instant."""
    order = Window.partitionBy(*by).orderBy(time)
    rows = df.withColumn("_covered", covered).withColumns({"_next": F.lead(time).over(order), "_both": F.col("_covered") & F.lead("_covered").over(order)})
    span = F.max(time) - F.min(time)
    held = F.coalesce(F.sum(F.when(F.col("_both"), F.col("_next") - F.col(time))), F.lit(0))
    return rows.groupBy(*by).agg(span.alias("extent"), held.alias("covered")).withColumn("ratio", F.when(F.col("extent") > 0, F.col("covered") / F.col("extent")))


def travelled(df: DataFrame, by: list[str], time: str, axes: list[str]) -> DataFrame:
    """For each key path (sum of steps), displacement (first to last) and excursion (farthest from the first)."""
    order = Window.partitionBy(*by).orderBy(time)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def far(other: dict[str, Column]) -> Column:
        return F.sqrt(sum(((F.col(a) - other[a]) ** 2 for a in axes[1:]), (F.col(axes[0]) - other[axes[0]]) ** 2))

    rows = df.withColumns({"_step": far({a: F.lag(a).over(order) for a in axes}), "_out": far({a: F.first(a).over(whole) for a in axes})})
    return rows.groupBy(*by).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"), F.max_by("_out", time).alias("displacement"), F.max("_out").alias("excursion"))
