"""Statistics of recordings, scenes and products as grouped aggregates, all with partial aggregation before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.operators.robust import quantiles


def bounds(df: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """The least and largest value of each axis; nulls where a key has none."""
    return df.groupBy(*by).agg(*(f(a).alias(f"{a}_{n}") for a in axes for n, f in (("min", F.min), ("max", F.max))))


def recording_facts(df: DataFrame, by: list[str], time: str, tolerance: float) -> DataFrame:
    """For each recording: its frames, the rate of the median step, how many steps differ from it by more than the tolerance (a share), and the first five such times."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(time))
    steps = df.withColumn("_step", step)
    median = steps.groupBy(*by).agg(F.count("*").alias("n_frames"), F.median("_step").alias("median_step"))
    odd = F.abs(F.col("_step") - F.col("median_step")) > tolerance * F.col("median_step")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(time))
    off = steps.join(median, by).filter(odd).withColumn("_place", place)
    found = off.groupBy(*by).agg(F.count("*").alias("n_mismatch"), F.array_sort(F.collect_list(F.when(F.col("_place") <= 5, F.col(time)))).alias("examples"))
    rate = F.when(F.col("median_step") > 0, 1e6 / F.col("median_step"))
    return median.join(found, by, "left").select(*by, "n_frames", rate.alias("fps"), F.coalesce("n_mismatch", F.lit(0)).alias("n_mismatch"), F.coalesce("examples", F.array()).alias("examples"))


def residual_quantiles(df: DataFrame, by: list[str], residual: str, depth: str) -> DataFrame:
    """For each scene: median, nine tenths and largest residual, and the share of points in front of the camera."""
    found = quantiles(df, by, residual, [0.5, 0.9])
    middle = found.groupBy(*by).agg(*(F.max(F.when(F.col("place") == k, F.col("quantile"))).alias(name) for k, name in enumerate(("median", "p90"))))
    rest = df.groupBy(*by).agg(F.max(residual).alias("worst"), F.avg((F.col(depth) > 0).cast("double")).alias("positive_depth"))
    return rest.join(middle, by, "left").select(*by, "median", "p90", "worst", "positive_depth")


def occupancy(df: DataFrame, by: list[str], x: Column, y: Column, cells: int = 4) -> DataFrame:
    """How many cells of a grid over the unit square have a point; points outside count for the nearest cell."""
    place = [F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor(c * cells).cast("int"))) for c in (x, y)]
    return df.select(*by, (place[0] * cells + place[1]).alias("_cell")).groupBy(*by).agg(F.count_distinct("_cell").alias("n_cells"))


def common_interval(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Where all spans of a key overlap: from the last start to the first end; nulls where they don't."""
    spans = df.groupBy(*by).agg(F.max(start).alias("_low"), F.min(end).alias("_high"))
    meets = F.col("_low") <= F.col("_high")
    return spans.select(*by, F.when(meets, F.col("_low")).alias("start"), F.when(meets, F.col("_high")).alias("end"))


def contributing_sources(df: DataFrame, by: list[str], source: str, contributes: Column) -> DataFrame:
    """For each key the sorted sources that contribute, empty if none, and how many are there at all."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(contributes, F.col(source)))).alias("sources"), F.count_distinct(source).alias("n_available"))


def peak(df: DataFrame, by: list[str], order: str, value: str, largest: bool = True) -> DataFrame:
    """Each key's extreme value and where it is; the first one of equals in order."""
    pick = F.max if largest else F.min
    at = F.struct(F.col(value).alias("value"), (-F.col(order) if largest else F.col(order)).alias("place"))
    found = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(pick(at).alias("_at"))
    return found.select(*by, F.col("_at.value").alias(value), (-F.col("_at.place") if largest else F.col("_at.place")).alias(order))


def best_subset(df: DataFrame, by: list[str], members: str, score: str) -> DataFrame:
    """Each key's largest array of members, the better score of equals, then the first in order."""
    first = F.transform(members, lambda m: -m)
    return df.groupBy(*by).agg(F.max_by(F.struct(members, score), F.struct(F.size(members), F.col(score), first)).alias("_best")).select(*by, "_best.*")


def reachable(edges: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    """How many components the nodes fall into, and whether all hang together; label: node, component of the edges' nodes."""
    found = nodes.join(label, "node", "left").select(F.coalesce("component", "node").alias("component"))
    return found.agg(F.count_distinct("component").alias("n_components"), (F.count_distinct("component") <= 1).alias("connected"))


#: Tasks that a key's partial hulls are merged in before the last one.
MERGERS = 64


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of points, counter-clockwise from the leftmost; of points on a line their ends."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    chains = []
    for run in (points, points[::-1]):
        chain: list = []
        for p in run.tolist():
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


def hull_area(df: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """by, n_corners and area of the convex hull of each key's points; those without a coordinate don't count.

    Hulls are merged like sums: each task takes the hull of its own points of a key, and only corners travel. Fewer than
    three corners have no area. A key of all points is spread over as many tasks as there are.
    """
    keys = [f"k{i}" for i in range(len(by))]
    known = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    points = df.filter(known).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), x.cast("double").alias("x"), y.cast("double").alias("y"))
    names = [*keys, "x", "y"]

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            number = table.select(keys).append_column("row", pa.array(np.arange(len(table)))).group_by(keys).aggregate([("row", "list")]) if keys else None
            groups = number.column("row_list").to_pylist() if keys else [list(range(len(table)))]
            place = np.column_stack([table.column(c).to_numpy() for c in ("x", "y")])
            for rows in groups:
                hull = convex_hull(place[rows])
                own = [table.column(k).combine_chunks().take(pa.array([rows[0]] * len(hull))) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(hull[:, 0]), pa.array(hull[:, 1])], names)

    def merged(table: pa.Table) -> pa.Table:
        hull = convex_hull(np.column_stack([table.column(c).to_numpy() for c in ("x", "y")]))
        own = [table.column(k).combine_chunks().take(pa.array([0] * len(hull))) for k in keys]
        return pa.table([*own, pa.array(hull[:, 0]), pa.array(hull[:, 1])], names=names)

    def measured(table: pa.Table) -> pa.Table:
        hull = merged(table)
        a, b = hull.column("x").to_numpy(), hull.column("y").to_numpy()
        a, b = a - a[0], b - b[0]
        area = abs(float(np.dot(a, np.roll(b, -1)) - np.dot(b, np.roll(a, -1)))) / 2
        return hull.select(keys).slice(0, 1).append_column("n_corners", pa.array([len(a)])).append_column("area", pa.array([area if len(a) > 2 else 0.0]))

    partial = points.mapInArrow(corners, points.schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
    fewer = partial.groupBy(*keys, "part").applyInArrow(merged, points.schema)
    kinds = StructType([*points.schema.fields[: len(keys)], *StructType.fromDDL("n_corners long, area double")])
    out = fewer.groupBy(*keys).applyInArrow(measured, kinds)
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), "n_corners", "area")
