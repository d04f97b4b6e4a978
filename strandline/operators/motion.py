"""Regularised motion: short gaps, positions, velocities and accelerations with their uncertainty, and rotations about each sample.

A quadratic is fitted around each sample over those within a radius of it that
no gap, jump or missing sample parts from it. What a fit needs lies within a
margin of time, so that a key is cut into buckets that overlap by it, and a key
with many rows is spread over many tasks. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MICRO = 1e-6
#: Margins in a bucket, and pairs of rows that are fitted at once.
BUCKET, PAIRS = 16, 1 << 18
STATES = ("observed", "inferred", "interpolated", "unknown")


@dataclass(frozen=True)
class MotionConfig:
    """Windows and gaps in microseconds, uncertainties in the units of values (radians of rotations); the default values are fixed."""

    filter_window: int = 60_000
    derivative_window: int = 80_000
    regularization: float = 0.001
    max_interval: int = 150_000
    short_gap: int = 40_000
    max_uncertainty: float = 0.05
    max_angle_uncertainty: float = 0.35
    floor: float = 1e-6
    inferred_weight: float = 0.5
    interpolated_weight: float = 0.25
    max_step: float | None = None
    breaks: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if self.short_gap > self.max_interval:
            raise ValueError("a short gap can't exceed the longest interval")
        if list(self.breaks) != sorted(set(self.breaks)):
            raise ValueError("breaks must be sorted and unique")


def _linked(t: np.ndarray, values: np.ndarray, known: np.ndarray, config: MotionConfig, steps: bool = True) -> np.ndarray:
    """Whether each row goes on from the one before it."""
    out = np.zeros(len(t), bool)
    if len(t) > 1:
        out[1:] = known[1:] & known[:-1] & (np.diff(t) <= config.max_interval)
        if config.breaks:
            passed = np.searchsorted(np.array(config.breaks), t, "right")
            out[1:] &= passed[1:] == passed[:-1]
        if steps and config.max_step is not None:
            out[1:] &= np.linalg.norm(np.diff(values, axis=0), axis=1) <= config.max_step
    return out


def _pairs(t: np.ndarray, known: np.ndarray, linked: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with at least three in their window, where their pairs begin, and the other row of each pair; about PAIRS at once."""
    run = np.cumsum(~linked)
    first = np.searchsorted(run, run, "left")
    last = np.searchsorted(run, run, "right")
    low = np.maximum(first, np.searchsorted(t, t - radius, "left"))
    high = np.minimum(last, np.searchsorted(t, t + radius, "right"))
    every = np.flatnonzero(known & (high - low >= 3))
    part = np.cumsum(high[every] - low[every]) // PAIRS
    for rows in np.split(every, np.flatnonzero(np.diff(part)) + 1):
        n = high[rows] - low[rows]
        starts = np.cumsum(n) - n
        yield rows, starts, np.arange(n.sum()) - np.repeat(starts - low[rows], n)


def _fitted(t: np.ndarray, rows: np.ndarray, starts: np.ndarray, other: np.ndarray, values: np.ndarray, sigma: np.ndarray, weight: np.ndarray, radius: float, config: MotionConfig, ridge: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (row, power, axis) in units of the radius, their uncertainties (row, power), and which rows determine them.

    values are of the pairs, sigma and weight of the rows.
    """
    n = np.diff(np.append(starts, len(other)))
    u = (t[other] - np.repeat(t[rows], n)) / radius
    doubt = sigma[other]
    w = weight[other] / np.maximum(doubt, config.floor) ** 2
    w = w / np.repeat(np.maximum.reduceat(w, starts), n)
    design = np.stack([np.ones(len(u)), u, u * u], axis=1)
    system = np.add.reduceat(w[:, None, None] * design[:, :, None] * design[:, None, :], starts, axis=0)
    system[:, 2, 2] += (config.regularization if ridge is None else ridge) * np.add.reduceat(w, starts)
    determined = np.abs(np.linalg.det(system)) > 1e-12 * system[:, 0, 0] * system[:, 1, 1] * system[:, 2, 2]
    system[~determined] = np.eye(3)
    operator = np.einsum("pij,pj->pi", np.repeat(np.linalg.inv(system), n, axis=0), design * w[:, None])
    found = np.add.reduceat(operator[:, :, None] * values[:, None, :], starts, axis=0)
    return found, np.add.reduceat(np.abs(operator) * doubt[:, None], starts, axis=0), determined


def _weights(state: np.ndarray, config: MotionConfig) -> np.ndarray:
    return np.select([state == "inferred", state == "interpolated"], [config.inferred_weight, config.interpolated_weight], 1.0)


def _bridged(t: np.ndarray, values: np.ndarray, sigma: np.ndarray, state: np.ndarray, config: MotionConfig) -> None:
    """Fill short gaps in a straight line; what lies between is as uncertain as the ends and half the way, and no more than allowed."""
    known = np.flatnonzero(state != "unknown")
    for a, b in zip(known[:-1], known[1:], strict=True):
        if b == a + 1 or t[b] - t[a] > config.short_gap or any(t[a] < x <= t[b] for x in config.breaks):
            continue
        delta = values[b] - values[a]
        far = float(np.linalg.norm(delta))
        doubt = max(sigma[a], sigma[b]) + far / 2
        if (config.max_step is not None and far > config.max_step) or doubt > config.max_uncertainty:
            continue
        own = slice(a + 1, b)
        values[own] = values[a] + ((t[own] - t[a]) / (t[b] - t[a]))[:, None] * delta
        sigma[own], state[own] = doubt, "interpolated"


def _regular(t: np.ndarray, values: np.ndarray, sigma: np.ndarray, state: np.ndarray, config: MotionConfig) -> None:
    """Values, uncertainties and states as the fit has them, in place; of 0 rows too."""
    _bridged(t, values, sigma, state, config)
    if config.regularization == 0:
        return
    known = state != "unknown"
    radius = config.filter_window / 2
    weight = _weights(state, config)
    new_values, new_sigma, new_state = values.copy(), sigma.copy(), state.copy()
    for rows, starts, other in _pairs(t, known, _linked(t, values, known, config), radius):
        if not len(rows):
            continue
        found, doubt, determined = _fitted(t, rows, starts, other, values[other], sigma, weight, radius, config)
        rows, found, doubt = rows[determined], found[determined], doubt[determined]
        moved = np.linalg.norm(found[:, 0] - values[rows], axis=1)
        new_values[rows], new_sigma[rows], new_state[rows] = found[:, 0], np.maximum.reduce([doubt[:, 0], moved, sigma[rows]]), "inferred"
        new_state[rows[new_sigma[rows] > config.max_uncertainty]] = "unknown"
    values[:], sigma[:], state[:] = new_values, new_sigma, new_state


def _rates(t: np.ndarray, known: np.ndarray, linked: np.ndarray, values_of, sigma: np.ndarray, state: np.ndarray, config: MotionConfig, axes: int) -> dict[str, np.ndarray]:
    """velocity, acceleration, their uncertainties, and the support of each row; NaN where there are none.

    values_of(rows, starts, other) gives the values of the pairs, and which rows may be used.
    """
    radius = config.derivative_window / 2
    out = {"velocity": np.full((len(t), axes), np.nan), "acceleration": np.full((len(t), axes), np.nan), "velocity_sigma": np.full(len(t), np.nan), "acceleration_sigma": np.full(len(t), np.nan)}
    out |= {name: np.zeros(len(t), np.int64) for name in ("n_support", "support_from", "support_to")}
    weight, r = _weights(state, config), radius * MICRO
    for rows, starts, other in _pairs(t, known, linked, radius):
        if not len(rows):
            continue
        values, fit = values_of(rows, starts, other)
        found, doubt, determined = _fitted(t, rows, starts, other, values, sigma, weight, radius, config, 0.0)
        fit &= determined
        ends = np.append(starts[1:], len(other)) - 1
        told = {"velocity": found[:, 1] / r, "acceleration": 2 * found[:, 2] / r**2, "velocity_sigma": doubt[:, 1] / r, "acceleration_sigma": 2 * doubt[:, 2] / r**2, "n_support": ends - starts + 1, "support_from": t[other[starts]], "support_to": t[other[ends]]}
        for name, value in told.items():
            out[name][rows[fit]] = value[fit]
    return out


def _rotation_vectors(q: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Logarithm of the rotation from base to q (scalars first), of a half turn at most."""
    w, x, y, z = q.T
    a, b, c, d = base[:, 0], -base[:, 1], -base[:, 2], -base[:, 3]
    scalar = w * a - x * b - y * c - z * d
    vector = np.stack([w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a], axis=1)
    vector = np.where(scalar[:, None] < 0, -vector, vector)
    length = np.linalg.norm(vector, axis=1)
    angle = 2 * np.arctan2(length, np.abs(scalar))
    return vector * np.where(length > 1e-300, angle / np.maximum(length, 1e-300), 2.0)[:, None]


RATES = {"velocity": "array<double>", "acceleration": "array<double>", "velocity_sigma": "double", "acceleration_sigma": "double", "n_support": "long", "support_from": "long", "support_to": "long"}


def _over_buckets(df: DataFrame, by: list[str], time: str, margin: int, columns: dict[str, str], fit, outputs: dict[str, str]) -> DataFrame:
    """df with the outputs of fit(t, table) for each bucket's own rows."""
    width = margin * BUCKET
    t = F.col(time).cast("long")
    start = lambda x: x - F.pmod(x, F.lit(width))
    keys = [f"k{i}" for i in range(len(by))]
    near = F.array_distinct(F.array(start(t - margin), start(t), start(t + margin)))
    rows = df.filter(t.isNotNull()).select(F.struct("*").alias("row"), *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), t.alias("t"), *(F.col(c).alias(name) for name, c in columns.items()), start(t).alias("own"), F.explode(near).alias("bucket"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        found = fit(table.column("t").to_numpy().astype(float), table)
        own = pa.array(table.column("own").to_numpy() == table.column("bucket").to_numpy())
        arrays = [_told(found[name], kind) for name, kind in outputs.items()]
        return pa.table([table.column("row"), *arrays], names=["row", *outputs]).filter(own)

    schema = StructType([rows.schema["row"], *StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in outputs.items()))])
    out = rows.groupBy(*keys, "bucket").applyInArrow(run, schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c not in outputs), *outputs)


def _told(values: np.ndarray, kind: str) -> pa.Array:
    """As Arrow, null for NaN and for no support."""
    if kind == "array<double>":
        gone = np.isnan(values).any(axis=1)
        return pa.array([None if g else v for v, g in zip(values.tolist(), gone, strict=True)], pa.list_(pa.float64()))
    if kind == "long":
        return pa.array(values.astype(np.int64))
    return pa.array(values, pa.string()) if kind == "string" else pa.array(values, pa.float64(), from_pandas=True)


def _evidence(table: pa.Table, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Uncertainty and state of each row; unknown without an uncertainty within the limit."""
    sigma = table.column("sigma").to_numpy(zero_copy_only=False).astype(float)
    state = np.array([s or "unknown" for s in table.column("state").to_pylist()], dtype="U12")
    state[~(sigma <= limit)] = "unknown"
    return np.nan_to_num(sigma), state


def _vectors(table: pa.Table, name: str, size: int) -> np.ndarray:
    rows = table.column(name).to_pylist()
    return np.array([[np.nan] * size if r is None or len(r) != size or None in r else r for r in rows], float).reshape(-1, size)


def regularised(df: DataFrame, by: list[str], time: str, position: str, sigma: str, state: str, config: MotionConfig | None = None, axes: int = 3) -> DataFrame:
    """df with smooth, smooth_sigma, smooth_state, and velocity and acceleration with their uncertainties and support.

    position is an array; state is observed, inferred, interpolated or unknown, and without sources a row must be given as
    unknown. Rows without a position, or without an uncertainty within the limit, count as unknown. Short gaps are filled
    in a straight line. Each row with at least three in its window is moved to the fit there, whose sum of squares is
    weighted by state and uncertainty and pulled to a line by the regularization; it is as uncertain as the fit, as it was,
    and as far as it was moved, at least; beyond the limit it is unknown, its value null. Velocities come from a second
    fit over the derivative's window, at the ends of a run over what is there. Rows of one time are in no order; rows
    without a time are dropped. The columns that it adds replace those of their names.
    """
    config = config or MotionConfig()

    def fit(t: np.ndarray, table: pa.Table) -> dict[str, np.ndarray]:
        values = _vectors(table, "value", axes)
        doubt, states = _evidence(table, config.max_uncertainty)
        states[~np.isfinite(values).all(axis=1)] = "unknown"
        _regular(t, values, doubt, states, config)
        known = states != "unknown"
        rates = _rates(t, known, _linked(t, values, known, config), lambda rows, starts, other: (values[other], np.ones(len(rows), bool)), doubt, states, config, axes)
        return rates | {"smooth": np.where(known[:, None], values, np.nan), "smooth_sigma": np.where(known, doubt, np.nan), "smooth_state": states}

    margin = (config.filter_window + config.derivative_window) // 2 + config.short_gap + 1
    outputs = {"smooth": "array<double>", "smooth_sigma": "double", "smooth_state": "string"} | RATES
    return _over_buckets(df, by, time, margin, {"value": position, "sigma": sigma, "state": state}, fit, outputs)


def angular_derivatives(df: DataFrame, by: list[str], time: str, orientation: str, sigma: str, state: str, config: MotionConfig | None = None) -> DataFrame:
    """df with the angular velocity and acceleration (radians a second) of orientation, an array (w, x, y, z), and their support.

    Rotations are taken about each sample, so that no angle wraps; a window that reaches half a turn from its sample may be
    either way round and tells nothing. The sign of a quaternion doesn't matter. Otherwise as regularised(), without its
    smoothing.
    """
    config = config or MotionConfig()

    def fit(t: np.ndarray, table: pa.Table) -> dict[str, np.ndarray]:
        q = _vectors(table, "value", 4)
        doubt, states = _evidence(table, config.max_angle_uncertainty)
        length = np.linalg.norm(q, axis=1)
        known = (states != "unknown") & np.isfinite(length) & (length > 0)
        q = q / np.where(known, length, 1.0)[:, None]

        def relative(rows: np.ndarray, starts: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = np.diff(np.append(starts, len(other)))
            vectors = _rotation_vectors(q[other], np.repeat(q[rows], n, axis=0))
            return vectors, np.maximum.reduceat(np.linalg.norm(vectors, axis=1), starts) < np.pi - 1e-6

        return _rates(t, known, _linked(t, q, known, config, steps=False), relative, doubt, states, config, 3)

    return _over_buckets(df, by, time, config.derivative_window // 2 + 1, {"value": orientation, "sigma": sigma, "state": state}, fit, RATES)
