"""Grouped numeric solvers: one small dense system for each group, many groups at once on the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.storage import stored

#: So many different points of a group are held against its planes at once.
BLOCK = 1 << 16
SUMS = ["sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]


def solve_offsets(pairs: DataFrame, by: list[str], most: float) -> DataFrame:
    """by, source, offset, residual: constant offsets of sources from measured pair offsets (a, b, offset of b minus a, weight).

    For each group the least-squares offsets, the first source at 0. While a residual is above ``most`` the worst pair
    is left out, as long as the rest still connects its sources; residual is the largest that stays.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*by).schema)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["a"]) | set(rows["b"]))
        at = {n: k for k, n in enumerate(names)}
        rows = rows.sort_values(["a", "b"]).reset_index(drop=True)
        keep = np.ones(len(rows), bool)
        while True:
            own = rows[keep]
            design = np.zeros((len(own) + 1, len(names)))
            design[-1, 0] = 1
            i = np.arange(len(own))
            design[i, own["b"].map(at)] += 1
            design[i, own["a"].map(at)] -= 1
            weight = np.append(np.sqrt(own["weight"].to_numpy(float)), 1)
            goal = np.append(own["offset"].to_numpy(float), 0)
            x, *_ = np.linalg.lstsq(design * weight[:, None], goal * weight, rcond=None)
            residual = np.abs(design[:-1] @ x - goal[:-1])
            worst = int(residual.argmax()) if len(residual) else -1
            if worst < 0 or residual[worst] <= most:
                break
            trial = keep.copy()
            trial[np.flatnonzero(keep)[worst]] = False
            left = np.zeros((int(trial.sum()), len(names)))
            j = np.arange(len(left))
            left[j, rows[trial]["b"].map(at)] += 1
            left[j, rows[trial]["a"].map(at)] -= 1
            if not len(left) or np.linalg.matrix_rank(left) < len(names) - 1:
                break
            keep = trial
        out = pd.DataFrame({"source": names, "offset": x, "residual": float(residual.max(initial=0))})
        for position, name in enumerate(by):
            out.insert(position, name, rows[name].iloc[0])
        return out

    return pairs.groupBy(*by).applyInPandas(solve, f"{kinds}, source string, offset double, residual double")


def triangulate(views: DataFrame, by: list[str], most: float) -> DataFrame:
    """by, x, y, z, n_views, error: points from views (camera, u, v in pixels, p: the 12 numbers of a 3x4 projection by rows).

    The linear solution of all views; while the largest reprojection error is above ``most`` pixels and more than two
    views are left, the view with the largest goes. Null coordinates where fewer than two views agree.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in views.select(*by).schema)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("camera")
        cameras = np.stack([np.asarray(p, float).reshape(3, 4) for p in rows["p"]])
        seen = rows[["u", "v"]].to_numpy(float)
        point, error, n = np.full(3, np.nan), np.nan, 0
        keep = np.arange(len(rows))
        while len(keep) >= 2:
            p, uv = cameras[keep], seen[keep]
            system = np.concatenate([uv[:, :1] * p[:, 2] - p[:, 0], uv[:, 1:] * p[:, 2] - p[:, 1]])
            h = np.linalg.svd(system)[2][-1]
            if abs(h[3]) < 1e-12:
                break
            image = p @ (h / h[3])
            if (image[:, 2] <= 0).any():
                off = np.where(image[:, 2] <= 0, np.inf, 0.0)
            else:
                off = np.sqrt(((image[:, :2] / image[:, 2:] - uv) ** 2).sum(1))
            if off.max() <= most:
                point, error, n = h[:3] / h[3], float(off.max()), len(keep)
                break
            keep = np.delete(keep, int(off.argmax()))
        out = pd.DataFrame({"x": [point[0]], "y": [point[1]], "z": [point[2]], "n_views": [n], "error": [error]})
        for position, name in enumerate(by):
            out.insert(position, name, rows[name].iloc[0])
        return out

    return views.groupBy(*by).applyInPandas(solve, f"{kinds}, x double, y double, z double, n_views long, error double")


def ground_plane(points: DataFrame, by: list[str], distance: float, trials: int = 256, seed: int = 17) -> DataFrame:
    """by, nx, ny, nz, offset, inliers, n: the plane n.p = offset that most points (x, y, z) of a group lie near, nz not negative.

    Planes through random triples are tried with a fixed seed, all points held against each of them, and the best one's
    inliers refined by their principal axes. Equal points are one that weighs as many; a group's points are dealt out over
    blocks, so that no task holds a group. Points that lack a coordinate count in n alone; null keys are a key, and normal
    and offset are null where no three points span a plane.
    """
    keys = [f"k{i}" for i in range(len(by))]
    kinds = "".join(f"{k} {points.schema[c].dataType.simpleString()}, " for c, k in zip(by, keys, strict=True))
    whole = points.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    whole = whole.groupBy(*keys, *"xyz").agg(F.count("*").alias("m"))
    sizes = whole.groupBy(*keys).agg(F.sum("m").alias("n"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    known = whole.filter(" AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('infinity')" for c in "xyz"))
    dealt = known.alias("p").join(sizes.alias("s"), same).select("p.*", F.pmod(F.xxhash64(*"xyz"), F.col("s.blocks")).alias("block"))
    dealt = stored(dealt)
    sizes = stored(sizes)
    # the smallest of exponential variates are a sample without replacement, by weight
    drawn = -F.log((F.shiftrightunsigned(F.xxhash64(*"xyz", F.lit(seed)), 11) + 1) * 2.0**-53) / F.col("m")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("drawn", *"xyz"))
    pool = dealt.withColumn("drawn", drawn).withColumn("rank", first).filter(F.col("rank") <= 3 * trials)

    def propose(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.sort_values("rank")[["x", "y", "z"]].to_numpy(float)
        rng = np.random.default_rng(seed)
        picks = np.arange(3 * trials).reshape(trials, 3) if len(p) == 3 * trials else np.array([rng.choice(len(p), 3, replace=False) for _ in range(trials if len(p) >= 3 else 0)], int).reshape(-1, 3)
        a, b, c = (p[picks[:, j]] for j in range(3))
        normal = np.cross(b - a, c - a)
        size = np.linalg.norm(normal, axis=1)
        kept = np.flatnonzero(size > 1e-12)
        out = pd.DataFrame({"trial": kept, "at": pd.Series(list(a[kept]), dtype=object), "normal": pd.Series(list(normal[kept] / size[kept, None]), dtype=object)})
        for position, name in enumerate(keys):
            out.insert(position, name, rows[name].iloc[0])
        return out

    plane = "trial long, at array<double>, normal array<double>"
    tried = stored((pool.groupBy(*keys) if keys else pool.groupBy(F.lit(0))).applyInPandas(propose, f"{kinds}{plane}"))

    def near(rows: pd.DataFrame, at: np.ndarray, normal: np.ndarray) -> np.ndarray:
        return np.abs((rows[["x", "y", "z"]].to_numpy(float) - at) @ normal) <= distance

    def count(rows: pd.DataFrame, planes: pd.DataFrame) -> pd.DataFrame:
        weight = rows["m"].to_numpy()
        out = planes[[*keys, "trial"]].copy()
        out["inliers"] = [int(weight[near(rows, a, v)].sum()) for a, v in zip(planes["at"], planes["normal"], strict=True)]
        return out

    def sums(rows: pd.DataFrame, planes: pd.DataFrame) -> pd.DataFrame:
        # about a point of the plane, so that far groups lose no digits
        out = planes[keys].copy()
        for j, (a, v) in enumerate(zip(planes["at"], planes["normal"], strict=True)):
            own = near(rows, a, v)
            off, weight = rows.loc[own, ["x", "y", "z"]].to_numpy(float) - a, rows.loc[own, "m"].to_numpy(float)
            told = [*(weight @ off), *((off * weight[:, None]).T @ off)[np.triu_indices(3)]]
            out.loc[out.index[j], SUMS] = told
        return out[[*keys, *SUMS]] if len(planes) else pd.DataFrame(columns=[*keys, *SUMS])

    def over_blocks(planes: DataFrame, fold, schema: str) -> DataFrame:
        spread = planes.alias("p").join(sizes.alias("s"), same).select("p.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.blocks") - 1)).alias("block"))
        return dealt.groupBy(*keys, "block").cogroup(spread.groupBy(*keys, "block")).applyInPandas(fold, f"{kinds}{schema}")

    counted = over_blocks(tried, count, "trial long, inliers long").groupBy(*keys, "trial").agg(F.sum("inliers").alias("inliers"))
    best = counted.groupBy(*keys).agg(F.max_by(F.struct("trial", "inliers"), F.struct("inliers", -F.col("trial"))).alias("b")).filter("b.inliers >= 3")
    match = [F.col(f"p.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("p.trial") == F.col("b.b.trial")]
    chosen = stored(tried.alias("p").join(best.alias("b"), match).select("p.*", F.col("b.b.inliers").alias("inliers")))
    totals = over_blocks(chosen, sums, ", ".join(f"{c} double" for c in SUMS)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS))
    refined = chosen.alias("p").join(totals.alias("s"), same).select("p.*", *(F.col(f"s.{c}") for c in SUMS))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n = rows["inliers"].to_numpy(float)
            mean = rows[SUMS[:3]].to_numpy(float) / n[:, None]
            spread = np.zeros((len(rows), 3, 3))
            for (i, j), c in zip(zip(*np.triu_indices(3), strict=True), SUMS[3:], strict=True):
                spread[:, i, j] = spread[:, j, i] = rows[c].to_numpy(float) - n * mean[:, i] * mean[:, j]
            normal = np.linalg.eigh(spread)[1][:, :, 0]
            normal = np.where(normal[:, 2:] < 0, -normal, normal)
            out = rows[[*keys, "inliers"]].copy()
            out["nx"], out["ny"], out["nz"] = normal.T
            out["offset"] = (normal * (np.array(rows["at"].tolist(), float).reshape(-1, 3) + mean)).sum(1)
            yield out

    planes = refined.mapInPandas(turn, f"{kinds}inliers long, nx double, ny double, nz double, offset double")
    found = sizes.alias("s").join(planes.alias("p"), same, "left")
    return found.select(*(F.col(f"s.{k}").alias(c) for c, k in zip(by, keys, strict=True)), *(F.col(f"p.{c}") for c in ("nx", "ny", "nz", "offset")), F.coalesce("p.inliers", F.lit(0)).alias("inliers"), F.col("s.n").alias("n"))
