"""Aggregates that no task holds whole, rays with a gate, and names that clash."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import geometry
from strandline.operators import asof, matching, robust, statistics, storage


def test_quantiles_of_a_hot_key_ties_and_few_values(spark):
    rng = random.Random(9)
    rows = [("hot", float(rng.randrange(50))) for _ in range(2000)] + [("tied", 3.0)] * 200 + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {(r.k, r.place): r.quantile for r in robust.quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    for key in ("hot", "tied", "one", "two"):
        values = [v for k, v in rows if k == key]
        for place, share in enumerate([0.0, 0.1, 0.5, 0.95, 1.0]):
            assert found[key, place] == pytest.approx(np.quantile(values, share))
    assert len(found) == 20 and robust.quantiles(df.limit(0), ["k"], "v", [0.5]).collect() == []
    whole = robust.quantiles(df, [], "v", [0.5]).collect()
    assert whole[0].quantile == pytest.approx(np.median([v for _, v in rows if v is not None]))


@pytest.mark.parametrize("points", [[(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0), (2, 1), (0, 0)], [(0, 0), (1, 1), (2, 2), (2, 2)], [(5, 5), (5, 5)], [(3, 4)]])
def test_hulls_of_collinear_repeated_and_few_points(spark, points):
    rows = [("a", float(x), float(y)) for x, y in points] + [("a", None, 1.0), ("b", 1.0, math.nan)]
    found = statistics.hull_area(spark.createDataFrame(rows, "k string, x double, y double").repartition(3), ["k"], F.col("x"), F.col("y")).collect()
    corners = {8: (4, 4.0), 4: (2, 0.0), 2: (1, 0.0), 1: (1, 0.0)}[len(points)]
    assert [tuple(r) for r in found] == [("a", *corners)]


def test_hull_of_many_points(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.cos("id").alias("x"), F.sin("id").alias("y"))
    (r,) = statistics.hull_area(df.repartition(4), ["k"], F.col("x"), F.col("y")).collect()
    assert r.area == pytest.approx(math.pi, rel=1e-4) and r.n_corners > 4000


def test_rays_go_through_their_points_or_are_null(spark):
    lens, wild = [0.1, -0.05, 0.001, -0.002, 0.01], [-3.0, 0.0, 0.0, 0.0, 0.0]
    pose = [0.0, -1.0, 0.0, 0.3, 1.0, 0.0, 0.0, -0.1, 0.0, 0.0, 1.0, 2.0]
    df = spark.createDataFrame([(0.2, -0.3, 1.0), (0.0, 0.0, 0.5), (-0.4, 0.4, 2.0)], "x double, y double, z double")
    seen = geometry.vector(-F.col("y") + 0.3, F.col("x") - 0.1, F.col("z") + 2)
    camera = (F.lit(800.0), F.lit(820.0), F.lit(320.0), F.lit(240.0))
    array = lambda values: F.array(*map(F.lit, values))
    df = df.withColumn("p", geometry.projected(seen, *camera, array(lens)))
    df = df.withColumns({"ray": geometry.pixel_ray(F.col("p.x"), F.col("p.y"), *camera, array(lens), array(pose)), "none": geometry.pixel_ray(F.lit(9000.0), F.lit(100.0), *camera, array(wild), array(pose))})
    for r in df.collect():
        centre, along = np.array(r.ray.centre), np.array(r.ray.direction)
        assert centre == pytest.approx([0.1, 0.3, -2.0]) and np.linalg.norm(along) == pytest.approx(1)
        assert np.linalg.norm(np.cross(np.array([r.x, r.y, r.z]) - centre, along)) < 1e-9 and r.none is None


def test_names_of_columns_are_free(spark):
    left = spark.createDataFrame([("a", 5, 1, 2)], "k string, t long, _r int, own int")
    right = spark.createDataFrame([("a", 4, 9)], "k string, t long, r int")
    found = asof.asof(left, right, ["k"], "t", ["r"])
    assert found.columns == ["k", "t", "_r", "own", "match"] and found.first().match.r == 9
    with pytest.raises(ValueError):
        asof.asof(left.withColumn("match", F.lit(1)), right, ["k"], "t", ["r"])
    assert storage.free_names(["a", "b"], ["A", "_a"]) == ["__a", "b"]


def test_lags_need_votes_and_a_clear_lead(spark):
    rng = np.random.default_rng(10)
    noise = np.convolve(rng.normal(0, 1, 240), np.ones(5) / 5, "same")
    wave = np.sin(np.arange(240) * 2 * np.pi / 10)
    rows = [("a", t, float(v)) for t, v in enumerate(noise)] + [("b", t + 9, float(v)) for t, v in enumerate(noise)] + [("c", t, 1.0) for t in range(240)]
    rows += [("x", t, float(v)) for t, v in enumerate(wave)] + [("y", t + 3, float(v)) for t, v in enumerate(wave)]
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "y")], "a string, b string")
    found = {(r.a, r.b): r for r in matching.voted_lags(spark.createDataFrame(rows, "source string, bin long, value double"), pairs, list(range(-20, 21)), 0.05).collect()}
    assert found["a", "b"].shift == 9 and found["a", "b"].reasons == [] and found["a", "b"].score > 0.99
    assert found["a", "c"].shift is None and found["a", "c"].reasons == ["no_useful_overlap"]
    assert "ambiguous_peak" in found["x", "y"].reasons
