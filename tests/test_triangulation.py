"""Noisy views: planted points within their uncertainty, outliers left out, what can't be settled is null with its reason."""

from __future__ import annotations

import numpy as np
import pytest

from strandline.operators import triangulation as tri

#: Cameras around the origin, five away, that look at it.
POINT = np.array([0.2, -0.1, 0.3])


def camera(angle: float, height: float = 0.0) -> np.ndarray:
    centre = np.array([5 * np.sin(angle), height, -5 * np.cos(angle)])
    ahead = -centre / np.linalg.norm(centre)
    right = np.cross([0.0, 1.0, 0.0], ahead)
    right /= np.linalg.norm(right)
    turn = np.stack([right, np.cross(ahead, right), ahead])
    lens = np.array([[800.0, 0, 320], [0, 800, 240], [0, 0, 1]])
    return lens @ np.column_stack([turn, -turn @ centre])


def seen(matrix: np.ndarray, point=POINT) -> np.ndarray:
    image = matrix @ [*point, 1.0]
    return image[:2] / image[2]


def views_of(matrices, pixels, sigma=2.0) -> tri.Views:
    return tri.Views.of(np.stack(matrices)[None], np.stack(pixels)[None], np.full((1, len(matrices)), float(sigma)))


def solve(spark, points, by="who", **config):
    """points: by key, views (camera, matrix, pixel, sigma)."""
    rows = [(k, c, *map(float, uv), float(s), [float(x) for x in np.ravel(p)]) for k, views in points.items() for c, p, uv, s in views]
    table = spark.createDataFrame(rows, f"`{by}` string, camera string, u double, v double, sigma double, p array<double>")
    return {r[by]: r for r in tri.located_points(table, [by], tri.Consensus(**config)).collect()}


RING = [camera(a, h) for a, h in ((-0.8, 0.3), (-0.3, -0.4), (0.3, 0.5), (0.9, 0.0), (1.6, 0.2))]


@pytest.mark.parametrize("n", [2, 3, 5])
def test_exact_views_give_the_point(spark, n):
    r = solve(spark, {"a": [(str(c), p, seen(p), 2.0) for c, p in enumerate(RING[:n])]})["a"]
    assert np.allclose([r.x, r.y, r.z], POINT, atol=1e-9) and r.reason is None
    assert r.used == [str(c) for c in range(n)] and max(r.residuals) < 1e-6 and r.sigma > 0 and r.angle > 20


def test_noisy_views_stay_within_their_uncertainty():
    rng = np.random.default_rng(3)
    n, sigma = 400, 1.5
    pixels = np.stack([np.stack([seen(p) for p in RING])] * n) + rng.normal(0, sigma, (n, 5, 2))
    found = tri.located(tri.Views.of(np.stack([np.stack(RING)] * n), pixels, np.full((n, 5), sigma)), tri.Consensus())
    assert all(isinstance(f, dict) for f in found)
    far = [((np.array([f["x"], f["y"], f["z"]]) - POINT) @ np.linalg.inv(np.reshape(f["covariance"], (3, 3))) @ (np.array([f["x"], f["y"], f["z"]]) - POINT)) ** 0.5 for f in found]
    assert np.mean(np.array(far) < 3) > 0.97  # 97.1 % within three sigmas in three dimensions, were it not for the wider robust covariance
    assert np.mean([np.linalg.norm([f["x"] - POINT[0], f["y"] - POINT[1], f["z"] - POINT[2]]) <= 3 * f["sigma"] for f in found]) > 0.99


def test_refinement_is_the_least_robust_error_and_its_covariance_is_its_curvature():
    rng = np.random.default_rng(4)
    pixels = [seen(p) + rng.normal(0, 2, 2) for p in RING]
    sigma = np.array([1.0, 2.0, 1.5, 3.0, 2.0])
    views = tri.Views.of(np.stack(RING)[None], np.stack(pixels)[None], sigma[None])
    (r,) = tri.located(views, tri.Consensus())
    x = np.array([r["x"], r["y"], r["z"]])

    def errors(x):
        return np.concatenate([(seen(p, x) - uv) / s for p, uv, s in zip(RING, pixels, sigma, strict=True)])

    def cost(x):
        return (2 * (np.sqrt(1 + errors(x) ** 2) - 1)).sum()

    for _ in range(300):
        assert cost(x + rng.normal(0, 1e-3, 3)) >= cost(x) - 1e-12
    h = 1e-6
    jacobian = np.stack([(errors(x + h * e) - errors(x - h * e)) / (2 * h) for e in np.eye(3)], 1)
    f = errors(x)
    curvature = jacobian.T @ (jacobian * ((1 + f * f) ** -1.5)[:, None])
    expected = np.linalg.inv(curvature) * max(1.0, f @ f / (len(f) - 3))
    assert np.allclose(np.reshape(r["covariance"], (3, 3)), expected, rtol=1e-4)
    assert r["sigma"] == pytest.approx(np.linalg.eigvalsh(expected)[-1] ** 0.5, rel=1e-4)


@pytest.mark.parametrize("n", [3, 5])
def test_an_outlier_is_left_out_and_named(spark, n):
    views = [(str(c), p, seen(p) + (60 if c == 1 else 0), 2.0) for c, p in enumerate(RING[:n])]
    r = solve(spark, {"a": views})["a"]
    assert np.allclose([r.x, r.y, r.z], POINT, atol=1e-8) and "1" not in r.used and len(r.used) == n - 1 and r.residuals[1] > 50


def test_what_cannot_be_settled_is_null_with_a_reason(spark):
    def view(name, matrix, point=POINT):
        return (name, matrix, seen(matrix, point), 2.0)

    other = POINT + [0, 0.6, 0]
    near = [camera(0.0), camera(0.001)]
    back = [camera(0.2), camera(-0.4)]
    behind = np.array([0.0, 0.0, -20.0])  # pixels of a point behind both cameras
    found = solve(spark, {
        "one": [view("a", RING[0])],
        "twice": [view("a", RING[0]), view("a", RING[1]), view("b", RING[2])],
        "parallel": [view("a", near[0]), view("b", near[1])],
        "behind": [view("a", back[0], behind), view("b", back[1], behind)],
        "split": [view("a", RING[0]), view("b", RING[1]), view("c", RING[2], other), view("d", RING[3], other)],
        "nothing": [("a", RING[0], (float("nan"), 1.0), 2.0), ("b", RING[1], (1.0, 1.0), 0.0), ("c", RING[2], (1.0, float("inf")), 1.0)],
        "enough": [view("a", RING[0]), view("b", RING[1]), ("b", RING[1], (float("nan"), 1.0), 2.0), ("c", RING[2][:, :3], (1.0, 1.0), 2.0)],
    })
    reasons = {k: r.reason for k, r in found.items()}
    assert reasons == {"one": tri.FEW, "twice": tri.DOUBLE, "parallel": tri.NO_PAIR, "behind": tri.NO_PAIR, "split": tri.AMBIGUOUS, "nothing": tri.FEW, "enough": None}
    assert all(r.x is None and r.sigma is None and r.used is None for r in found.values() if r.reason) and found["enough"].used == ["a", "b"]


def test_more_noise_makes_a_point_less_certain_but_less_never_more():
    exact = tri.located(views_of(RING, [seen(p) for p in RING], 2.0), tri.Consensus())[0]
    wide = tri.located(views_of(RING, [seen(p) for p in RING], 4.0), tri.Consensus())[0]
    assert wide["sigma"] == pytest.approx(2 * exact["sigma"], rel=1e-6)
    sure, off = (tri.located(views_of(RING, [seen(p) + e * np.array([(-1) ** c, 1]) for c, p in enumerate(RING)], 0.5), tri.Consensus())[0] for e in (0, 2))
    assert off["sigma"] > 2 * sure["sigma"]


def test_names_nulls_and_nothing(spark):
    for name in ("x", "views", "k0", "n", "camera_"):
        r = solve(spark, {None: [(str(c), p, seen(p), 2.0) for c, p in enumerate(RING[:3])]}, by="who")
        assert np.allclose(r[None].x, POINT[0])
        found = tri.located_points(spark.createDataFrame([], f"`{name}` string, camera string, u double, v double, sigma double, p array<double>"), [name])
        assert found.columns[0] == name and found.collect() == []
    with pytest.raises(ValueError):
        tri.Consensus(max_reprojection=0.0)
