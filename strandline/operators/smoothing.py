"""Local weighted polynomial regression over centred windows of time.

A window of two radii meets exactly two blocks of that width: the end of one
and the beginning of the next. Sums from a row to the end of its block and from
the beginning of a block to a row are running sums, so that a fit costs the
same whatever the density of rows, and none is a difference of larger sums.
Moments are taken about the middle of a block, in radii, and shifted to the row
by the binomial theorem. Each row goes to two pairs of blocks: a key with many
rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1e-6
#: Moments of the weights and of the values.
WEIGHTS, VALUES = 5, 3


def _shifted(moments: list[Column], by: Column) -> list[Column]:
    """Moments about a point that lies so far beyond the one that these are about."""
    binomial = [[1], [1, 1], [1, 2, 1], [1, 3, 3, 1], [1, 4, 6, 4, 1]]
    powers = [F.lit(1.0), -by, by * by, -by * by * by, by * by * by * by]
    return [sum((binomial[k][j] * powers[k - j] * moments[j] for j in range(k)), moments[k]) for k in range(len(moments))]


def local_quadratic(df: DataFrame, by: list[str], time: str, value: str, radius: int, ridge: float = 0.0, least: int = 3, sigma: str | None = None, weight: str | None = None, floor: float = 0.0) -> DataFrame:
    """df with n_fit, smooth, velocity, acceleration and smooth_sigma of the value from a quadratic over the rows within radius (microseconds).

    Rows weigh as the inverse square of sigma, where that column is given, but of ``floor`` at least, times the column
    ``weight``, where given (what a state of evidence is worth). Rows without a value, with a null or negative sigma, a
    sigma of 0 without a floor, or a weight that isn't above 0 don't count. smooth_sigma is the fit's own uncertainty, that
    of a unit uncertainty without sigma. Null where fewer than ``least`` rows are near or they don't determine a quadratic.
    ``ridge`` times the sum of the weights is added to the equation of the square, in units of the radius. Rows without a
    time are dropped. The columns that it adds replace those of their names; others may have any name.
    """
    block = 2 * radius
    t = F.col(time).cast("long")
    start = lambda x: x - F.pmod(x, F.lit(block))
    doubt = F.lit(1.0) if sigma is None else F.when(F.col(sigma) >= 0, F.greatest(F.col(sigma).cast("double"), F.lit(floor)))
    worth = F.lit(1.0) if weight is None else F.when(F.col(weight) > 0, F.col(weight).cast("double"))
    w = worth / F.when(doubt > 1e-150, doubt) / doubt
    y = F.when(w.isNotNull(), F.col(value).cast("double"))
    inner = {"t": t, "y": y, "w": F.when(y.isNotNull(), w), "own": start(t), "asks": start(t - radius)}
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    rows = df.filter(F.col(time).isNotNull()).select(F.struct("*").alias("row"), *keys, *(x.alias(name) for name, x in inner.items()))
    rows = rows.withColumn("pair", F.explode(F.array(F.col("own") - block, F.col("own"))))
    u = (F.col("t") - F.col("own") - radius) / F.lit(float(radius))
    powers = [F.lit(1.0), u, u * u, u * u * u, u * u * u * u]
    terms = {f"s{k}": F.col("w") * powers[k] for k in range(WEIGHTS)} | {f"m{k}": F.col("w") * powers[k] * F.col("y") for k in range(VALUES)} | {"n": F.when(F.col("w").isNotNull(), 1.0)}
    rows = rows.withColumns(terms | {"back": -F.col("t")})
    of_pair = [f"k{i}" for i in range(len(by))] + ["pair"]
    sums = {}
    for side, order, here in (("a", "back", F.col("own") == F.col("pair")), ("b", "t", F.col("own") > F.col("pair"))):
        frame = Window.partitionBy(*of_pair).orderBy(order).rangeBetween(Window.unboundedPreceding, radius)
        sums |= {f"{side}_{name}": F.coalesce(F.sum(F.when(here, F.col(name))).over(frame), F.lit(0.0)) for name in terms}
    rows = rows.withColumns(sums).filter("pair = asks")
    away = (F.col("t") - F.col("pair") - radius) / F.lit(float(radius))
    moved = {}
    for kind, count in (("s", WEIGHTS), ("m", VALUES)):
        sides = [_shifted([F.col(f"{side}_{kind}{k}") for k in range(count)], shift) for side, shift in (("a", away), ("b", away - 2))]
        moved |= {f"{kind}{k}": sides[0][k] + sides[1][k] for k in range(count)}
    rows = rows.select("row", *(x.alias(name) for name, x in moved.items()), (F.col("a_n") + F.col("b_n")).cast("long").alias("n_fit"))
    n, u1, u2, u3, u4 = (F.col(f"s{k}") for k in range(WEIGHTS))
    u4 = u4 + ridge * n
    y0, y1, y2 = (F.col(f"m{k}") for k in range(VALUES))
    det = n * (u2 * u4 - u3 * u3) - u1 * (u1 * u4 - u2 * u3) + u2 * (u1 * u3 - u2 * u2)
    a = y0 * (u2 * u4 - u3 * u3) - u1 * (y1 * u4 - y2 * u3) + u2 * (y1 * u3 - y2 * u2)
    b = n * (y1 * u4 - y2 * u3) - y0 * (u1 * u4 - u2 * u3) + u2 * (u1 * y2 - u2 * y1)
    q = n * (u2 * y2 - u3 * y1) - u1 * (u1 * y2 - u2 * y1) + y0 * (u1 * u3 - u2 * u2)
    good = (F.col("n_fit") >= least) & (u2 > 0) & (det > 1e-6 * n * u2 * u4)
    r = radius * MICRO
    fit = {"smooth": a / det, "velocity": b / det / r, "acceleration": 2 * q / det / (r * r), "smooth_sigma": F.sqrt((u2 * u4 - u3 * u3) / det)}
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c not in ("n_fit", *fit)]
    return rows.select(*kept, "n_fit", *(F.when(good, x).alias(name) for name, x in fit.items()))


def local_slope(df: DataFrame, by: list[str], time: str, value: str, before: int, after: int, to: str = "slope") -> DataFrame:
    """df with the least-squares slope (per second) over the rows from ``before`` rows earlier to ``after`` later."""
    frame = Window.partitionBy(*by).orderBy(time).rowsBetween(-before, after)
    first = F.min(time).over(Window.partitionBy(*by))
    return df.withColumn("_t", (F.col(time) - first) * MICRO).withColumn(to, F.regr_slope(value, "_t").over(frame)).drop("_t")
