"""Points of noisy views: consensus over pairs of rays, robust refinement, covariance.

Views of a point lie in one row, as many as there are cameras. Each pair of
rays proposes a position; the one that most views agree with is refined over
all of them with a loss that grows linearly for outliers, and views are taken
in and left out until they stay the same. Points seen by equally many views are
solved side by side in numpy.

Edge cases: a point whose views can't settle it has null coordinates and a
reason; views with a null or non-finite pixel, matrix or sigma, or a sigma not
above 0, count as none; two views of one camera give no point, as they can't
both be right; no views give no row; other columns are ignored, and keys may be
null and have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOCATED = "x double, y double, z double, sigma double, covariance array<double>, angle double, condition double, used array<string>, residuals array<double>, reason string"
#: Points that are solved side by side.
TOGETHER = 1 << 11
#: Why a point has no position.
FEW, DOUBLE, NO_PAIR, AMBIGUOUS = "insufficient_independent_views", "multiple_views_of_one_camera", "no_consistent_front_facing_geometry", "ambiguous_equal_support_consensus"
UNSTABLE, RAYS, FAILED, LOST, REPROJECTION = "unstable_consensus_after_refinement", "ill_conditioned_ray_geometry", "refinement_failed", "insufficient_views_after_refinement", "ill_conditioned_reprojection_geometry"


@dataclass(frozen=True)
class Consensus:
    """How far a view may be off (pixels), the least angle of two rays (degrees), and the largest condition of a solution."""

    max_reprojection: float = 8.0
    min_angle: float = 1.0
    max_condition: float = 1e6
    max_evaluations: int = 100

    def __post_init__(self):
        if self.max_reprojection <= 0 or not 0 < self.min_angle < 90 or self.max_condition <= 1 or self.max_evaluations < 1:
            raise ValueError("consensus needs positive limits, an angle below 90 degrees and a condition above 1")


@dataclass
class Views:
    """Views of n points by m cameras each: matrices (n, m, 3, 4), pixels (n, m, 2), sigma (n, m), and from them centres and rays."""

    matrices: np.ndarray
    pixels: np.ndarray
    sigma: np.ndarray
    centres: np.ndarray
    rays: np.ndarray

    @classmethod
    def of(cls, matrices: np.ndarray, pixels: np.ndarray, sigma: np.ndarray) -> Views:
        turned = np.linalg.pinv(matrices[..., :3])
        centres = -np.einsum("nmij,nmj->nmi", turned, matrices[..., 3])
        rays = np.einsum("nmij,nmj->nmi", turned, np.concatenate([pixels, np.ones((*sigma.shape, 1))], 2))
        return cls(matrices, pixels, sigma, centres, rays / np.maximum(np.linalg.norm(rays, axis=2, keepdims=True), 1e-300))

    def at(self, rows: np.ndarray) -> Views:
        return Views(*(x[rows] for x in (self.matrices, self.pixels, self.sigma, self.centres, self.rays)))

    def errors(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Errors (n, m, 2) of positions in pixels, and their depths; infinite where a position isn't in front of a camera."""
        image = np.einsum("nmij,nj->nmi", self.matrices[..., :3], points) + self.matrices[..., 3]
        depth = image[..., 2]
        front = depth > 1e-9
        out = image[..., :2] / np.where(front, depth, 1.0)[..., None] - self.pixels
        return np.where(front[..., None], out, np.inf), depth

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.errors(points)[0], axis=2)

    def met(self, inside: np.ndarray, config: Consensus) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the rays that are inside meet best, whether they tell, their largest angle, and the condition."""
        between = np.abs(np.einsum("nai,nbi->nab", self.rays, self.rays))
        apart = np.linalg.norm(self.centres[:, :, None] - self.centres[:, None], axis=3) > 1e-9
        apart &= inside[:, :, None] & inside[:, None]
        angle = np.where(apart, np.degrees(np.arccos(np.minimum(between, 1.0))), 0.0).max(axis=(1, 2))
        across = (np.eye(3) - self.rays[..., :, None] * self.rays[..., None, :]) * (inside / self.sigma**2)[..., None, None]
        normal = across.sum(axis=1)
        condition = _condition(normal)
        good = (angle >= config.min_angle) & (condition <= config.max_condition)
        goal = np.einsum("nmij,nmj->ni", across, self.centres)
        return _solved(np.where(good[:, None, None], normal, np.eye(3)), goal), good, angle, condition


def _condition(normal: np.ndarray) -> np.ndarray:
    size = np.abs(np.linalg.eigvalsh(normal))
    return np.where(size.min(1) > 0, size.max(1) / np.maximum(size.min(1), 1e-300), np.inf)


def _solved(matrix: np.ndarray, goal: np.ndarray) -> np.ndarray:
    return np.linalg.solve(matrix, goal[..., None])[..., 0]


def refined(views: Views, inside: np.ndarray, start: np.ndarray, config: Consensus) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of least robust error, whether each was found, the curvature there, and the squared errors in sigmas.

    An error of e sigmas (each of the two of a pixel) costs 2 (sqrt(1 + e^2) - 1): damped Newton steps that never make a
    position worse.
    """
    x = start.copy()

    def look(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        error, _ = views.errors(x)
        error = np.where(inside[..., None], error / views.sigma[..., None], 0.0)
        return error, np.where(np.isfinite(error), 2 * (np.sqrt(1 + error * error) - 1), np.inf).sum(axis=(1, 2))

    error, now = look(x)
    done, lost = ~np.isfinite(now), ~np.isfinite(now)
    damping = np.full(len(x), 1e-6)
    curvature = np.zeros((len(x), 3, 3))
    for _ in range(config.max_evaluations):
        curvature, slope = _curvature(views, inside, x, np.where(lost[:, None, None], 0.0, error))
        size = np.maximum(np.einsum("nii->ni", curvature), 1e-300)
        damped = curvature.copy()
        damped[:, np.arange(3), np.arange(3)] += damping[:, None] * size
        damped[lost] = np.eye(3)
        step = -_solved(damped, slope)
        tried, then = look(x + step)
        better = (then <= now) & ~done
        small = np.abs(step).max(1) <= 1e-12 * (1e-12 + np.abs(x).max(1))
        slow = better & (now - then <= 1e-12 * now)
        x, error, now = np.where(better[:, None], x + step, x), np.where(better[:, None, None], tried, error), np.where(better, then, now)
        damping = np.where(better, np.maximum(damping / 10, 1e-12), damping * 10)
        done |= small | slow
        if done.all():
            break
    curvature, _ = _curvature(views, inside, x, np.where(lost[:, None, None], 0.0, error))
    return x, done & ~lost & np.isfinite(x).all(1), curvature, np.where(np.isfinite(error), error * error, 0.0).sum(axis=(1, 2))


def _curvature(views: Views, inside: np.ndarray, x: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and slope of the robust error at positions."""
    image = np.einsum("nmij,nj->nmi", views.matrices[..., :3], x) + views.matrices[..., 3]
    depth = np.where(image[..., 2] > 1e-9, image[..., 2], 1.0)[..., None, None]
    rows = views.matrices[..., :3]
    slope = rows[..., :2, :] / depth - image[..., :2, None] * rows[..., 2:, :] / depth**2
    slope = np.where(inside[..., None, None], slope / views.sigma[..., None, None], 0.0)
    square = 1 + error * error
    return np.einsum("nmki,nmk,nmkj->nij", slope, square**-1.5, slope), np.einsum("nmki,nmk->ni", slope, square**-0.5 * error)


def located(views: Views, config: Consensus) -> list[dict | str]:
    """For each point its position and what is known of it, or the reason why it has none."""
    n, m = views.sigma.shape
    out: list = [FEW] * n
    if m < 2:
        return out
    # each pair of views proposes a position
    a, b = np.triu_indices(m, 1)
    support, cost = np.zeros((n, len(a)), np.int64), np.full((n, len(a)), np.inf)
    agree, proposed = np.zeros((n, len(a), m), bool), np.zeros((n, len(a), 3))
    for k, pair in enumerate(zip(a, b, strict=True)):
        inside = np.zeros((n, m), bool)
        inside[:, pair] = True
        proposed[:, k], good, _, _ = views.met(inside, config)
        far = views.distances(proposed[:, k])
        near = (far <= config.max_reprojection) & good[:, None]
        enough = near.sum(1) >= 2
        agree[:, k] = near & enough[:, None]
        support[:, k] = np.where(enough, near.sum(1), 0)
        cost[:, k] = np.where(enough, (np.where(near, far, 0.0) / views.sigma) ** 2 @ np.ones(m), np.inf)
    best = np.lexsort((np.broadcast_to(np.arange(len(a)), cost.shape), cost, -support), axis=1)[:, 0]
    every = np.arange(n)
    inside = agree[every, best]
    ambiguous = np.zeros(n, bool)
    for k in range(len(a)):  # as many other views that can't be reconciled with these
        rival = (support[:, k] == support[every, best]) & (agree[:, k] != inside).any(1)
        ambiguous |= rival & (inside & ~(views.distances(proposed[:, k]) <= config.max_reprojection)).any(1)
    found = support[every, best] >= 2
    for i in every[~found]:
        out[i] = NO_PAIR
    for i in every[found & ambiguous]:
        out[i] = AMBIGUOUS
    todo, inside = every[found & ~ambiguous], inside[found & ~ambiguous]
    tried = {int(i): set() for i in todo}
    for turn in range(2 * m):
        again = np.array([inside[j].tobytes() in tried[int(i)] for j, i in enumerate(todo)], bool)
        for i in todo[again]:
            out[i] = UNSTABLE
        todo, inside = todo[~again], inside[~again]
        if not len(todo):
            break
        for j, i in enumerate(todo):
            tried[int(i)].add(inside[j].tobytes())
        own = views.at(todo)
        start, good, angle, condition = own.met(inside, config)
        x, settled, curvature, square = refined(own, inside, start, config)
        far = own.distances(np.where(np.isfinite(x), x, 0.0))
        near = far <= config.max_reprojection
        same = (near == inside).all(1)
        stays = np.zeros(len(todo), bool)
        for j, i in enumerate(todo):
            if not good[j]:
                out[i] = RAYS
            elif not settled[j]:
                out[i] = FAILED
            elif near[j].sum() < 2:
                out[i] = LOST
            elif same[j]:
                out[i] = _told(x[j], curvature[j], float(square[j]), inside[j], far[j], float(angle[j]), config)
            elif turn == 2 * m - 1:
                out[i] = UNSTABLE
            else:
                stays[j] = True
        todo, inside = todo[stays], near[stays]
    return out


def _told(x: np.ndarray, curvature: np.ndarray, square: float, inside: np.ndarray, far: np.ndarray, angle: float, config: Consensus) -> dict | str:
    condition = float(_condition(curvature[None])[0])
    if not condition <= config.max_condition:
        return REPROJECTION
    # errors larger than assumed make the point less certain, smaller ones never more so
    covariance = np.linalg.inv(curvature) * max(1.0, square / max(1, 2 * int(inside.sum()) - 3))
    sigma = float(np.sqrt(np.linalg.eigvalsh(covariance)[-1]))
    residuals = [float(r) if np.isfinite(r) else None for r in far]
    return {"x": float(x[0]), "y": float(x[1]), "z": float(x[2]), "sigma": sigma, "covariance": covariance.ravel().tolist(), "angle": angle, "condition": condition, "inside": inside, "residuals": residuals}


def _solve(config: Consensus):
    names = [field.name for field in StructType.fromDDL(LOCATED)]
    kinds = {"covariance": pa.list_(pa.float64()), "used": pa.list_(pa.string()), "residuals": pa.list_(pa.float64()), "reason": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("views").to_pylist()
            told: list = [None] * len(rows)
            alike: dict[int, list[int]] = {}
            for k, row in enumerate(rows):
                if any(v["n"] > 1 for v in row):
                    told[k] = DOUBLE
                else:
                    alike.setdefault(len(row), []).append(k)
            for m, members in alike.items():
                for first in range(0, len(members), TOGETHER):
                    own = members[first : first + TOGETHER]
                    seen = [rows[k] for k in own]
                    matrices = np.array([[v["p"] for v in row] for row in seen], float).reshape(len(own), m, 3, 4)
                    pixels = np.array([[(v["u"], v["v"]) for v in row] for row in seen], float).reshape(len(own), m, 2)
                    sigma = np.array([[v["sigma"] for v in row] for row in seen], float).reshape(len(own), m)
                    for k, answer in zip(own, located(Views.of(matrices, pixels, sigma), config) if m else [FEW] * len(own), strict=True):
                        told[k] = answer
            out = []
            for row, answer in zip(rows, told, strict=True):
                if isinstance(answer, str):
                    out.append({"reason": answer})
                else:
                    out.append(answer | {"used": [v["camera"] for v, i in zip(row, answer["inside"], strict=True) if i]})
            keys = [c for c in batch.schema.names if c != "views"]
            columns = [pa.array([o.get(name) for o in out], kinds.get(name, pa.float64())) for name in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *columns], [*keys, *names])

    return run


def located_points(views: DataFrame, by: list[str], config: Consensus | None = None) -> DataFrame:
    """by, x, y, z, sigma, covariance, angle, condition, used, residuals and reason of each point that has a view.

    views has by, camera, u, v (pixels without distortion, see geometry.pixel_ray), sigma (their noise in pixels, see
    gates.view_sigma) and p (the 12 numbers of a 3x4 projection by rows, whose third row gives the depth). covariance (nine
    numbers by rows) and sigma, its largest standard deviation, hold for the assumed noise or the noise met, whichever is
    larger. residuals are by camera, in the order of their names, of all views that count, null behind a camera; used names
    those that the point rests on. reason is null where there is a point.
    """
    config = config or Consensus()
    keys = [f"k{i}" for i in range(len(by))]
    numbers = [F.col(c).cast("double").alias(c) for c in ("u", "v", "sigma")]
    rows = views.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col("camera").cast("string").alias("camera"), *numbers, F.col("p").cast("array<double>").alias("p"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    counts = finite(F.col("u")) & finite(F.col("v")) & finite(F.col("sigma")) & (F.col("sigma") > 0) & (F.size("p") == 12) & F.forall("p", finite)
    view = F.struct("u", "v", "sigma", "p")
    # many rows of one camera stay two numbers and a view
    once = rows.groupBy(*keys, "camera").agg(F.count_if(counts).alias("n"), F.min(F.when(counts, view)).alias("view"))
    seen = F.when(F.col("n") > 0, F.struct("camera", "n", "view.*"))
    points = once.groupBy(*keys).agg(F.sort_array(F.collect_list(seen)).alias("views"))  # one for each camera
    schema = StructType([*(points.schema[k] for k in keys), *StructType.fromDDL(LOCATED)])
    out = points.mapInArrow(_solve(config), schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *(field.name for field in StructType.fromDDL(LOCATED)))
