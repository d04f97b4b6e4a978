"""Matching of descriptors and of lag series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.storage import stored

#: Rows of both sides that are compared at once.
BLOCK = 1_024
#: Parts of each side, between all pairs of which tasks compare; a side has more once a part would have more rows than PART.
PARTS, PART = 8, 1 << 17
#: Pairs whose distance is measured at once.
MEASURED = 1 << 14


#: In place of an id: there is no second row; it is another row with the vector of the first one, so that its distance is the same.
ABSENT, TWIN = np.iinfo(np.int64).max, np.iinfo(np.int64).max - 1


def _vectors(column: pa.Array) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors must have the same number of components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Nearest:
    """The two nearest others of each vector so far, by distance and id."""

    def __init__(self, ids: np.ndarray, twins: np.ndarray, vectors: np.ndarray):
        self.ids, self.twins, self.vectors = ids, twins, vectors
        self.d = np.full((len(ids), 2), np.nan)
        self.other = np.full((len(ids), 2), ABSENT, np.int64)
        self.norms = (vectors**2).sum(1)

    def limits(self, own: slice, near: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared distances, beyond which others are none of the two nearest, whatever the rounding; near: those of a block, by row."""
        error = 1e-11 * (self.norms[own] + np.max(norms, where=np.isfinite(norms), initial=0.0))
        limit = self.d[own, 1] ** 2
        open_ = np.flatnonzero(np.isnan(limit))
        if len(open_):
            limit[open_] = np.inf if near.shape[1] < 2 else np.partition(near[open_], 1, axis=1)[:, 1]
        return limit + error

    def take(self, rows: np.ndarray, others: Nearest, found: np.ndarray) -> None:
        """Measure and keep found ones of others, each for its row."""
        if not len(rows):
            return
        d = np.concatenate([np.sqrt(((self.vectors[rows[k : k + MEASURED]] - others.vectors[found[k : k + MEASURED]]) ** 2).sum(1)) for k in range(0, len(rows), MEASURED)])
        ids, twice = others.ids[found], others.twins[found]
        touched = np.unique(rows)
        rows = np.concatenate([rows, rows[twice], np.repeat(touched, 2)])
        d, ids = np.concatenate([d, d[twice], self.d[touched].ravel()]), np.concatenate([ids, np.full(int(twice.sum()), TWIN), self.other[touched].ravel()])
        order = np.lexsort((ids, d, rows))
        first = order[np.searchsorted(rows[order], touched)]
        second = order[np.searchsorted(rows[order], touched) + 1]
        self.d[touched], self.other[touched] = np.stack([d[first], d[second]], 1), np.stack([ids[first], ids[second]], 1)

    def told(self, side: int) -> pa.RecordBatch:
        known = (self.other != ABSENT).ravel()
        columns = (np.full(int(known.sum()), side, np.int32), np.repeat(self.ids, 2)[known], self.other.ravel()[known], self.d.ravel()[known])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["side", "id", "other", "d"])


def _compared(left: Nearest, right: Nearest, block: int) -> None:
    for k in range(0, len(left.ids), block):
        own, every = slice(k, k + block), slice(None)
        near = left.norms[own, None] + right.norms[None, :] - 2 * left.vectors[own] @ right.vectors.T
        rows, columns = np.nonzero(~(near > left.limits(own, near, right.norms)[:, None]))
        left.take(rows + k, right, columns)
        rows, columns = np.nonzero(~(near > right.limits(every, near.T, left.norms[own])[None, :]))
        right.take(columns, left, rows + k)


def _tiles(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a tile's left side first, which stay, then those of its right one, a block at a time."""
        tile, held, left = None, [], None
        for batch in batches:
            places = batch.column("tile").to_numpy() * 2 + batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if places[a] // 2 != tile:
                    if left is not None:
                        yield left.told(0)
                    tile, held, left = places[a] // 2, [], None
                part = batch.slice(a, b - a)
                if places[a] % 2 == 0:
                    held.append((part.column("id").to_numpy(), part.column("twins").to_numpy(zero_copy_only=False), _vectors(part.column("v"))))
                    continue
                if left is None and held:
                    left = Nearest(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                for k in range(0, b - a if left is not None else 0, block):
                    few = part.slice(k, block)
                    right = Nearest(few.column("id").to_numpy(), few.column("twins").to_numpy(zero_copy_only=False), _vectors(few.column("v")))
                    _compared(left, right, block)
                    yield right.told(1)
        if left is not None:
            yield left.told(0)

    return run


def _both_nearest(a: DataFrame, b: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """side (0 for a, 1 for b), id, best, d1, d2 of the smallest id of each vector of a and b, on the other side; and a table of these with v."""
    vectors = [df.groupBy("v").agg(F.min("id").alias("id"), (F.count("*") > 1).alias("twins")).select("id", "twins", "v", F.lit(side).alias("side")) for side, df in enumerate((a, b))]
    vectors = stored(vectors[0].unionByName(vectors[1]))
    n = {r["side"]: r["n"] for r in vectors.groupBy("side").agg(F.count("*").alias("n")).collect()}
    few = max(n.values(), default=0) <= 4 * block
    parts = [1 if few else max(PARTS, -(-n.get(side, 0) // PART)) for side in (0, 1)]
    own = F.when(F.col("side") == 0, F.pmod(F.xxhash64("id"), F.lit(parts[0]))).otherwise(F.pmod(F.xxhash64("id"), F.lit(parts[1])))
    others = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.lit(parts[1])).otherwise(F.lit(parts[0])) - 1)
    spread = vectors.withColumn("own", own).withColumn("with", F.explode(others))
    tile = F.when(F.col("side") == 0, F.col("own") * parts[1] + F.col("with")).otherwise(F.col("with") * parts[1] + F.col("own"))
    spread = spread.select(tile.cast("long").alias("tile"), "side", "id", "twins", "v")
    found = spread.repartition(1 if few else 2 * parts[0] * parts[1], "tile").sortWithinPartitions("tile", "side").mapInArrow(_tiles(block), "side int, id long, other long, d double")
    two = found.groupBy("side", "id").agg(F.sort_array(F.collect_list(F.struct("d", "other"))).alias("x"))  # two rows from each part
    told = two.select("side", "id", F.get("x", F.lit(0))["other"].alias("best"), F.get("x", F.lit(0))["d"].alias("d1"), F.get("x", F.lit(1))["d"].alias("d2"))
    return told, vectors


def two_nearest(a: DataFrame, b: DataFrame, size_of_block: int = BLOCK) -> DataFrame:
    """For each row of a (id, v): id, best (of b), d1 and d2, the distances to its two nearest rows of b; ties by id.

    Equal vectors are compared once. Both sides come in parts, whose number doesn't grow before they have PART rows; a task
    holds one part of a, and a block of b at a time.
    """
    told, vectors = _both_nearest(a, b, size_of_block)
    named = told.filter("side = 0").select(F.col("id").alias("first"), "best", "d1", "d2")
    first = vectors.filter("side = 0").select(F.col("id").alias("first"), F.col("v"))
    return a.join(first, "v").join(named, "first").select("id", "best", "d1", "d2")


def mutual_matches(a: DataFrame, b: DataFrame, ratio: float) -> DataFrame:
    """a_id, b_id, d: pairs that are each other's nearest, each clearly nearer than the second (d1 < ratio * d2, or no second)."""
    told = stored(_both_nearest(a, b, BLOCK)[0].filter(F.col("d2").isNull() | (F.col("d1") < F.col("d2") * ratio)))
    x = told.filter("side = 0").select(F.col("id").alias("a_id"), F.col("best").alias("b_id"), F.col("d1").alias("d"))
    y = told.filter("side = 1").select(F.col("id").alias("b_id"), F.col("best").alias("a_id"))
    return x.join(y, ["a_id", "b_id"])


#: The least standard deviation and bins of a correlation that counts, of its score, of its lead, and of a part's vote.
FLAT, BINS, SCORE, LEAD, VOTE = 0.03, 8, 0.55, 0.08, 0.2


def lag_correlation(series: DataFrame, pairs: DataFrame, shifts: list[int], least: int = BINS) -> DataFrame:
    """a, b, shift, n, r: for each pair of sources the correlation of a at bin t with b at bin t + shift.

    series: source, bin, value with one row for each bin. A correlation over fewer than ``least`` bins, or of a flat series,
    is 0.
    """
    a = series.select(F.col("source").alias("a"), F.col("bin"), F.col("value").alias("x"))
    b = series.select(F.col("source").alias("b"), F.col("bin").alias("bin_b"), F.col("value").alias("y"))
    left = pairs.join(a, "a").withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("bin_b", F.col("bin") + F.col("shift"))
    both = left.join(b, ["b", "bin_b"])
    return both.groupBy("a", "b", "shift").agg(F.count("*").alias("n"), _guarded(F.lit(True), least).alias("r"))


def _guarded(own: Column, least: int = BINS) -> Column:
    """An aggregate: the correlation of x and y where own holds, 0 for few bins and flat series."""
    x, y = F.when(own, F.col("x")), F.when(own, F.col("y"))
    a, b = F.stddev_pop(x), F.stddev_pop(y)  # not corr, which divides by the spread of a constant before it can be guarded
    return F.when((F.count(x) < least) | (a < FLAT) | (b < FLAT), 0.0).otherwise(F.covar_pop(x, y) / a / b)


def voted_lags(series: DataFrame, pairs: DataFrame, shifts: list[int], step: float) -> DataFrame:
    """a, b, shift, score, separation, n, votes and reasons (none if the lag is reliable) of each pair of sources.

    series: source, bin, value on a grid of ``step`` seconds, as resampling gives it. At each shift the bins that both have
    are cut into three parts of the same size; at least two must correlate by more than VOTE. The score is the correlation
    of all, less where a part disagrees or the overlap is short of two seconds; the best shift must lead all that aren't
    next to it (ties: the larger shift), or the signal is flat, periodic or unrelated. Pairs without a useful overlap have
    null shift.
    """
    a = series.select(F.col("source").alias("a"), "bin", F.col("value").alias("x"))
    b = series.select(F.col("source").alias("b"), F.col("bin").alias("bin_b"), F.col("value").alias("y"))
    left = pairs.select("a", "b").join(a, "a").withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("bin_b", F.col("bin") + F.col("shift"))
    both = left.join(b, ["b", "bin_b"]).withColumn("part", F.ntile(3).over(Window.partitionBy("a", "b", "shift").orderBy("bin")))
    parts = F.array(*(_guarded(F.col("part") == k) for k in (1, 2, 3)))
    told = both.groupBy("a", "b", "shift").agg(F.count("*").alias("n"), ((F.max("bin") - F.min("bin")) * step).alias("seconds"), _guarded(F.lit(True)).alias("r"), parts.alias("parts"))
    told = told.withColumn("votes", F.size(F.filter("parts", lambda v: v > VOTE)))
    useful = told.filter((F.col("votes") >= 2) & (F.col("n") >= BINS) & (F.col("seconds") >= max(0.4, BINS * step)))
    useful = useful.withColumn("score", F.col("r") * F.col("votes") / 3 * F.least(F.lit(1.0), F.col("seconds") / 2))
    pair = Window.partitionBy("a", "b")
    ranked = useful.withColumn("rank", F.row_number().over(pair.orderBy(F.desc("score"), F.desc("shift"))))
    ranked = ranked.withColumn("top", F.max(F.when(F.col("rank") == 1, F.col("shift"))).over(pair))
    ranked = ranked.withColumn("rival", F.max(F.when(F.abs(F.col("shift") - F.col("top")) > 2, F.col("score"))).over(pair))
    best = ranked.filter("rank = 1").withColumn("separation", F.col("score") - F.coalesce("rival", F.lit(0.0)))
    found = pairs.select("a", "b").join(best, ["a", "b"], "left")
    rules = {"no_useful_overlap": F.col("shift").isNull(), "ambiguous_peak": F.col("separation") < LEAD, "weak_correlation": F.col("score") < SCORE}
    reasons = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return found.select("a", "b", "shift", "score", "separation", "n", "votes", reasons.alias("reasons"))


def best_lag(correlations: DataFrame, near: int) -> DataFrame:
    """a, b, shift, r, margin: each pair's best shift and its lead over the best one more than ``near`` shifts away."""
    pair = Window.partitionBy("a", "b")
    ranked = correlations.withColumn("rank", F.row_number().over(pair.orderBy(F.desc("r"), "shift")))
    top = F.max(F.when(F.col("rank") == 1, F.col("shift"))).over(pair)
    ranked = ranked.withColumn("top", top).withColumn("rival", F.max(F.when(F.abs(F.col("shift") - F.col("top")) > near, F.col("r"))).over(pair))
    return ranked.filter("rank = 1").select("a", "b", "shift", "r", (F.col("r") - F.col("rival")).alias("margin"))
