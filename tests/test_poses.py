"""Poses pulled to measured lengths: planted poses come back, bounds hold, infeasible fits are refused, the optimum is one."""

from __future__ import annotations

import numpy as np
import pytest

from strandline.operators import poses

ARM = [("upper", "shoulder", "elbow", 0.3), ("fore", "elbow", "wrist", 0.25)]
TRUE = {"shoulder": (0.0, 0.0, 0.0), "elbow": (0.3, 0.0, 0.0), "wrist": (0.3, 0.25, 0.0)}


def fit(spark, samples, bones=ARM, sigma=0.01, doubt=1e-5, **config):
    points = [("p", i, name, *map(float, xyz), sigma) for i, sample in enumerate(samples) for name, xyz in sample.items()]
    points = spark.createDataFrame(points, "who string, t long, name string, x double, y double, z double, sigma double")
    lengths = spark.createDataFrame([("p", *b, doubt) for b in bones], "who string, bone string, a string, b string, length double, sigma double")
    return poses.fitted(points, lengths, ["who", "t"], ["who"], poses.FitConfig(**config)).orderBy("t").collect()


def test_lengths_are_met_and_points_stay_near(spark):
    rng = np.random.default_rng(1)
    noisy = [{n: np.array(p) + rng.normal(0, 0.005, 3) for n, p in TRUE.items()} for _ in range(20)]
    for sample, r in zip(noisy, fit(spark, noisy), strict=True):
        assert r.status == poses.CONVERGED and all(abs(b.residual) < 1e-6 for b in r.bones)
        for p in r.points:
            assert p.moved == pytest.approx(np.linalg.norm(np.array([p.x, p.y, p.z]) - sample[p.name]), abs=1e-12) and p.moved <= 0.025 and p.sigma >= max(0.01, p.moved)


def test_a_true_pose_stays_as_it_is(spark):
    (r,) = fit(spark, [TRUE])
    assert r.status == poses.CONVERGED and all(p.moved == 0 and p.sigma == 0.01 for p in r.points) and r.cost == pytest.approx(0, abs=1e-12)


def test_the_solution_is_a_minimum(spark):
    rng = np.random.default_rng(2)
    start = np.array([[*TRUE.values()]]) + rng.normal(0, 0.02, (1, 3, 3))
    ends, lengths, doubt = np.array([[0, 1], [1, 2]]), np.array([[0.3, 0.25]]), np.array([[0.01, 0.02]])
    sigma, reach = np.full((1, 3), 0.01), np.full((1, 3), 0.1 * 0.25)
    x, cost, good = poses.solved(start, sigma, reach, ends, lengths, doubt, poses.FitConfig())

    def value(x):
        far = np.linalg.norm(x[ends[:, 1]] - x[ends[:, 0]], axis=1)
        return ((((x - start[0]) / 0.01) ** 2).sum() + ((4 * (far - lengths[0]) / doubt[0]) ** 2).sum()) / 2

    assert good[0] and cost[0] == pytest.approx(value(x[0]))
    for _ in range(300):
        near = np.clip(x[0] + rng.normal(0, 1e-3, (3, 3)), start[0] - reach[0, 0] / 3**0.5, start[0] + reach[0, 0] / 3**0.5)
        assert value(near) >= cost[0] - 1e-9


def test_what_is_out_of_reach_stops_at_the_bound_or_is_refused(spark):
    far = TRUE | {"wrist": (0.3, 0.5, 0.0)}
    (r,) = fit(spark, [far])
    assert r.status == poses.CONVERGED and max(p.moved for p in r.points) <= 0.025 + 1e-9 and max(abs(b.residual) for b in r.bones) > 0.1
    (r,) = fit(spark, [far], refuse=0.05)
    assert r.status == poses.REJECTED and all(p.moved == 0 for p in r.points) and {p.name: (p.x, p.y, p.z) for p in r.points} == far


def test_uncertain_and_absent_points_are_left_alone(spark):
    found = fit(spark, [TRUE | {"nose": (1, 1, 1)}, {"elbow": TRUE["elbow"]}, {k: v for k, v in TRUE.items() if k != "wrist"}])
    assert [r.status for r in found] == [poses.CONVERGED, poses.NOTHING, poses.CONVERGED]
    assert [len(r.bones) for r in found] == [2, 0, 1] and {p.name: p.moved for p in found[0].points}["nose"] == 0
    assert fit(spark, [TRUE], sigma=0.2)[0].status == poses.NOTHING
    with pytest.raises(ValueError):
        poses.FitConfig(max_displacement=0.0)
