"""Orders, ranks, distinct values by first sight, and joins that look at neighbours of other kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], score: str, tie: str, n: int, keep: Column | None = None) -> DataFrame:
    """The n rows of each key with the best scores, among those to be kept; rank from 1."""
    rows = df if keep is None else df.filter(keep)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))).filter(F.col("rank") <= n)


def ranked(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """df with the ordinal (from 0) of each row in the order."""
    return df.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def first_seen(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The distinct values of each key in the order of their first sight, with its place."""
    seen = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(order).alias("first"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("first", value)))


def truncated(df: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """Each key's sorted distinct values, the first ``most`` of them, and whether there are more; no more than that is ever gathered."""
    distinct = df.select(*by, value).filter(F.col(value).isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    kept = distinct.withColumn("_place", place).filter(F.col("_place") <= most + 1)
    values = F.array_sort(F.collect_list(F.when(F.col("_place") <= most, F.col(value))))
    return kept.groupBy(*by).agg(values.alias("values"), (F.max("_place") > most).alias("truncated"))


def offset_page(df: DataFrame, ordinal: str, offset: int, limit: int) -> DataFrame:
    """Rows with ordinals from offset on, limit of them at most."""
    return df.filter(F.col(ordinal).between(offset, offset + limit - 1))


def fresh_evidence(df: DataFrame, by: list[str], order: str, evidence: str) -> DataFrame:
    """df with fresh: whether the row's evidence wasn't seen before in its key."""
    seen = F.row_number().over(Window.partitionBy(*by, evidence).orderBy(order))
    return df.withColumn("fresh", seen == 1)


def speed_of_new_evidence(df: DataFrame, by: list[str], order: str, value: str, evidence: str) -> DataFrame:
    """df with the speed (a second) since the row before, null where that has the same evidence or the same time."""
    w = Window.partitionBy(*by).orderBy(order)
    dt = (F.col(order) - F.lag(order).over(w)) * 1e-6
    new = F.col(evidence) != F.lag(evidence).over(w)
    return df.withColumn("speed", F.when(new & (dt > 0), F.abs(F.col(value) - F.lag(value).over(w)) / dt))


def clock_gaps(df: DataFrame, by: list[str], start: str, end: str, expected: Column, least: int) -> DataFrame:
    """Pauses between neighbouring samples that are longer than 2.5 expected steps and than ``least``: gap_start, gap_end."""
    before = F.lag(end).over(Window.partitionBy(*by).orderBy(start))
    rows = df.withColumns({"gap_start": before, "gap_end": F.col(start), "_expected": expected})
    return rows.filter(F.col("gap_end") - F.col("gap_start") > F.greatest(2.5 * F.col("_expected"), F.lit(least))).drop("_expected")


def neighbours_by_side(df: DataFrame, by: list[str], order: str, side: str, sides: tuple[str, str], payload: str) -> DataFrame:
    """df with the payload of the previous row of the same side and of the latest one of the other side."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    latest = {s: F.last(F.when(F.col(side) == s, F.col(payload)), ignorenulls=True).over(before) for s in sides}
    same = F.when(F.col(side) == sides[0], latest[sides[0]]).otherwise(latest[sides[1]])
    other = F.when(F.col(side) == sides[0], latest[sides[1]]).otherwise(latest[sides[0]])
    return df.withColumns({"same_side": same, "other_side": other})


def in_window(df: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Rows whose span meets [low, high]; rows without a start are always in it."""
    return df.filter(F.col(start).isNull() | ((F.col(start) <= high) & (F.col(end) >= low)))


def all_shared_near(left: DataFrame, right: DataFrame, by: list[str], name: str, values: list[str], sigma: str, distance: float) -> DataFrame:
    """For each key with shared names, how many there are and whether all lie within distance plus both uncertainties."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*by, name]]
    far = F.sqrt(sum(((F.col(f"a.{v}") - F.col(f"b.{v}")) ** 2 for v in values), F.lit(0.0)))
    near = far <= F.lit(distance) + F.col(f"a.{sigma}") + F.col(f"b.{sigma}")
    return a.join(b, on).groupBy(*(F.col(f"a.{c}").alias(c) for c in by)).agg(F.count("*").alias("n_shared"), F.bool_and(near).alias("near"))


def channel_join(raw: DataFrame, canonical: DataFrame, keys: list[str]) -> DataFrame:
    """Raw channel points whose canonical point is usable at the same keys; canonical holds the usable ones alone."""
    return raw.join(canonical.select(*keys).distinct(), keys, "left_semi")


def set_relation(left: Column, right: Column) -> Column:
    """equal, subset, superset, overlapping or disjoint, of two arrays taken as sets."""
    missing, more, both = F.size(F.array_except(left, right)), F.size(F.array_except(right, left)), F.size(F.array_intersect(left, right))
    return F.when((missing == 0) & (more == 0), "equal").when(missing == 0, "subset").when(more == 0, "superset").when(both > 0, "overlapping").otherwise("disjoint")


def emitted(events: DataFrame, evidence: DataFrame, key: str, state: str) -> DataFrame:
    """Events none of whose evidence is unknown or interpolated; events without evidence are dropped."""
    sound = evidence.groupBy(key).agg(F.bool_and(F.col(state).isin("observed", "inferred")).alias("_sound")).filter("_sound")
    return events.join(sound.select(key), key, "left_semi")
