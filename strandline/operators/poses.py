"""Poses pulled to a body's measured lengths: bounded nonlinear least squares for many samples at once.

A sample's points and a body's lengths are a row each, so that samples are
fitted where they lie; those of one topology are solved together. A step solves
the normal equations of the points that aren't at their bounds, damped until it
lowers the cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed names of what a fit comes to.
CONVERGED, REJECTED, NOTHING = "converged", "fit_rejected", "no_supported_constraints"
FITTED = "status string, cost double, points array<struct<name: string, x: double, y: double, z: double, sigma: double, moved: double>>, bones array<struct<bone: string, length: double, residual: double>>"


@dataclass(frozen=True)
class FitConfig:
    """The default values are fixed; refuse is the share of a length that may stay unmet, None if any may."""

    max_relative_uncertainty: float = 0.15
    length_weight: float = 4.0
    max_displacement: float = 0.1
    max_evaluations: int = 100
    refuse: float | None = None

    def __post_init__(self) -> None:
        if not 0 < self.max_displacement <= 0.5 or not 0 < self.length_weight <= 100:
            raise ValueError("displacement or length weight out of range")


def solved(start: np.ndarray, sigma: np.ndarray, reach: np.ndarray, ends: np.ndarray, lengths: np.ndarray, doubt: np.ndarray, config: FitConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, costs and whether each of F samples converged.

    start is (F, points, 3), sigma and reach (F, points), ends (bones, 2), lengths and doubt (F, bones).
    """
    f, n = start.shape[:2]
    x, first = start.reshape(f, -1).copy(), start.reshape(f, -1)
    bound = np.repeat(reach / np.sqrt(3), 3, axis=1)
    low, high, precision = first - bound, first + bound, np.repeat(sigma**-2.0, 3, axis=1)
    pull, rows = config.length_weight / doubt, np.arange(len(ends))
    columns = 3 * ends[:, :, None] + np.arange(3)

    def apart(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = x.reshape(f, n, 3)[:, ends[:, 1]] - x.reshape(f, n, 3)[:, ends[:, 0]]
        return gap, np.linalg.norm(gap, axis=2)

    def cost(x: np.ndarray) -> np.ndarray:
        return (((x - first) ** 2 * precision).sum(axis=1) + ((pull * (apart(x)[1] - lengths)) ** 2).sum(axis=1)) / 2

    now, damping, done = cost(x), np.full(f, 1e-3), np.zeros(f, bool)
    for _ in range(config.max_evaluations):
        gap, far = apart(x)
        slope = np.zeros((f, len(ends), 3 * n))
        along = pull[:, :, None] * gap / np.maximum(far, 1e-300)[:, :, None]
        slope[:, rows[:, None], columns[:, 1]] = along
        slope[:, rows[:, None], columns[:, 0]] = -along
        force = (x - first) * precision + np.einsum("fmk,fm->fk", slope, pull * (far - lengths))
        held = (x <= low) & (force > 0) | (x >= high) & (force < 0)
        force = np.where(held, 0.0, force)
        normal = np.einsum("fmk,fml->fkl", slope, slope)
        normal[:, np.arange(3 * n), np.arange(3 * n)] += precision
        normal = np.where(held[:, :, None] | held[:, None, :], 0.0, normal)
        diagonal = np.einsum("fkk->fk", normal)
        normal[:, np.arange(3 * n), np.arange(3 * n)] = np.where(held, 1.0, diagonal + damping[:, None] * precision)
        step = np.clip(x - np.linalg.solve(normal, force[:, :, None])[:, :, 0], low, high) - x
        new = cost(x + step)
        better = (new <= now) & ~done
        x = np.where(better[:, None], x + step, x)
        small = (np.abs(step) <= 1e-10 * bound).all(axis=1) | (better & (now - new <= 1e-12 * now))
        now = np.where(better, new, now)
        damping = np.where(better, damping / 10, damping * 10)
        done |= small
        if done.all():
            break
    return x.reshape(f, n, 3), now, done


def _fit(config: FitConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = list(zip(batch.column("points").to_pylist(), batch.column("lengths").to_pylist(), strict=True))
            alike: dict[tuple, list[int]] = {}
            active = []
            for k, (points, bones) in enumerate(samples):
                own = {p["name"]: p for p in points or [] if None not in (p["name"], p["x"], p["y"], p["z"], p["sigma"])}
                sure = [b for b in bones or [] if b["length"] and b["length"] > 0 and all(e in own and own[e]["sigma"] <= config.max_relative_uncertainty * b["length"] for e in (b["a"], b["b"]))]
                sure.sort(key=lambda b: b["bone"])
                active.append((own, sure))
                alike.setdefault(tuple((b["bone"], b["a"], b["b"]) for b in sure), []).append(k)
            told: list = [None] * len(samples)
            for topology, members in alike.items():
                names = sorted({e for _, *pair in topology for e in pair})
                if not names:
                    for k in members:
                        told[k] = (NOTHING, None, [p | {"moved": 0.0} for p in samples[k][0] or []], [])
                    continue
                index = {name: i for i, name in enumerate(names)}
                ends = np.array([[index[a], index[b]] for _, a, b in topology])
                start = np.array([[[active[k][0][name][c] for c in "xyz"] for name in names] for k in members], float)
                lengths = np.array([[b["length"] for b in active[k][1]] for k in members], float)
                scale = np.array([[min(length for (_, *pair), length in zip(topology, row, strict=True) if name in pair) for name in names] for row in lengths])
                sigma = np.maximum([[active[k][0][name]["sigma"] for name in names] for k in members], scale * 1e-6)
                doubt = np.maximum([[b["sigma"] or 0.0 for b in active[k][1]] for k in members], lengths * 1e-6)
                x, cost, good = solved(start, sigma, config.max_displacement * scale, ends, lengths, doubt, config)
                residual = np.linalg.norm(x[:, ends[:, 1]] - x[:, ends[:, 0]], axis=2) - lengths
                if config.refuse is not None:
                    good &= (np.abs(residual) <= config.refuse * lengths).all(axis=1)
                moved = np.where(good[:, None], np.linalg.norm(x - start, axis=2), 0.0)
                for i, k in enumerate(members):
                    points = []
                    for p in samples[k][0]:
                        j = index.get(p["name"])
                        if j is not None and good[i] and moved[i, j] > 1e-10 * scale[i, j]:
                            near = max(d for (_, *pair), d in zip(topology, (b["sigma"] or 0.0 for b in active[k][1]), strict=True) if p["name"] in pair)
                            p = p | {c: float(v) for c, v in zip("xyz", x[i, j], strict=True)} | {"sigma": max(p["sigma"], float(moved[i, j]), near), "moved": float(moved[i, j])}
                        points.append({"moved": 0.0} | p)
                    bones = [{"bone": b, "length": float(v), "residual": float(r)} for (b, *_), v, r in zip(topology, lengths[i], residual[i], strict=True)]
                    told[k] = (CONVERGED if good[i] else REJECTED, float(cost[i]), points, bones)
            kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("name", pa.string()), *((c, pa.float64()) for c in ("x", "y", "z", "sigma", "moved"))])), pa.list_(pa.struct([("bone", pa.string()), ("length", pa.float64()), ("residual", pa.float64())]))]
            keys = [c for c in batch.schema.names if c not in ("points", "lengths")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(pa.array([t[i] for t in told], kind) for i, kind in enumerate(kinds))], [*keys, "status", "cost", "points", "bones"])

    return run


def fitted(points: DataFrame, lengths: DataFrame, by: list[str], of: list[str], config: FitConfig | None = None) -> DataFrame:
    """by, status, cost, points and bones of each sample, its points moved so that bones have a body's lengths.

    points has by, name, x, y, z and sigma, one row for each landmark that was observed; lengths has of (a part of by: whose
    body it is), bone, a, b (names of its ends), length and sigma. A bone counts where both its ends are certain to a share
    of its length. Points move by a share of the shortest bone that they are part of, at most, and become as uncertain as
    they have moved. bones tells what is left of each length. A fit that doesn't converge, or leaves more than ``refuse`` of
    a length unmet, is refused: the points stay. Absent points are never made up. Keys aren't null.
    """
    config = config or FitConfig()
    keys = [f"k{i}" for i in range(len(by))]
    rows = points.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.struct("name", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "sigma"))).alias("p"))
    frames = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("points"))  # as many as a body has landmarks
    owners = [f"k{by.index(c)}" for c in of]
    bones = lengths.select(*(F.col(c).alias(k) for c, k in zip(of, owners, strict=True)), F.struct("bone", "a", "b", F.col("length").cast("double").alias("length"), F.col("sigma").cast("double").alias("sigma")).alias("b"))
    bodies = bones.groupBy(*owners).agg(F.sort_array(F.collect_list("b")).alias("lengths"))
    both = frames.join(bodies, owners, "left") if owners else frames.crossJoin(F.broadcast(bodies))  # one row of lengths
    both = both.select(*keys, "points", "lengths")
    schema = StructType([*(both.schema[k] for k in keys), *StructType.fromDDL(FITTED)])
    out = both.mapInArrow(_fit(config), schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), "status", "cost", "points", "bones")
