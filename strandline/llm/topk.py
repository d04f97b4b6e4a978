"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(1024 x). Candidates are laid out by falling
length in parts of about ``PART_ROWS`` rows, queries in blocks of about
``QUERY_ROWS``; each pair of a part and a block is one group, so that no task
holds more, however many vectors or equal vectors there are. The longest part
first gives every query a score that its k-th hit reaches at least; queries
whose score asks for similar lengths then share a block, and a part whose
longest vector is too short for a block isn't paired with it.

Within a group, buckets of ``BUCKET`` vectors of similar length are searched.
A query's best score so far, over both lengths, is the cosine that a bucket's
vectors must reach: above 1 the bucket is skipped; from ``STEEP`` on a sorted
coordinate of the unit vectors, in which the query is largest, leaves a range
of them; below, the lengths leave the first ones. What is left is verified by
exact integer products.

Edge cases: rows with a null id or vector, or a null or non-finite component,
take no part; vectors are compared with those of the same number of components
only; rows with the query's own id are no candidates, other rows that repeat
each are; a query id that repeats asks once, with its first vector in array
order; ties go to the smaller id; an empty table gives no rows. Scores are exact; one
that needs more than 64 bits raises OverflowError. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tables import stored

K = 10
SCALE = 1024
PART_ROWS = 16_384
QUERY_ROWS = 4_096
BUCKET = 1_024
STEEP = 0.8
#: Bounds computed in floating point are loosened by this share of the lengths' product.
SLACK = 1e-9
HIT = "query_id long, vec_id long, score long"


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of doubles that hold integers) and length of the rows that take part."""
    def whole(c: Column) -> Column:
        scaled = c.cast("double") * scale
        return F.when(F.abs(scaled) < F.lit(2.0**53), F.floor(scaled).cast("double")).otherwise(scaled)  # larger doubles are integers

    x = F.transform("embedding", whole)
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, c: total + c * c))
    return good.select("vec_id", x.alias("v")).withColumn("length", length)


def _matrices(table: pa.Table, key: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of components: that number, the ids, vectors and lengths of its rows."""
    vectors = table.column("v").combine_chunks()
    ids, lengths = table.column(key).to_numpy(), table.column("length").to_numpy()
    sizes = np.asarray(vectors.value_lengths())
    values, offsets = vectors.values.to_numpy(), vectors.offsets.to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        at = offsets[rows][:, None] + np.arange(d)
        yield int(d), ids[rows], values[at.ravel()].reshape(len(rows), d), lengths[rows]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: doubles hold them below 2**53, 64-bit integers below 2**63, Python's above; those that end beyond 2**63 raise."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    out = exact(a) @ exact(b).T
    if any(abs(x) >= 1 << 63 for x in out.ravel()):
        raise OverflowError("an inner product needs more than 64 bits")
    return out.astype(np.int64)


class Best:
    """The k best hits of each query so far, and the score that a new hit must reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.hits = [np.empty(0, np.int64)] * 3
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        keep = score >= self.floors[query]
        self.waiting.append((query[keep], score[keep], vec_id[keep]))

    def settle(self) -> None:
        query, score, vec_id = (np.concatenate([own, *more]) for own, more in zip(self.hits, zip(*self.waiting, strict=True) if self.waiting else [()] * 3, strict=True))
        self.waiting = []
        order = np.lexsort((vec_id, -score, query))
        query, score, vec_id = query[order], score[order], vec_id[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kth = place == self.k - 1
        self.floors[query[kth]] = np.maximum(self.floors[query[kth]], score[kth])
        keep = place < self.k
        self.hits = [query[keep], score[keep], vec_id[keep]]


def search(queries: tuple, candidates: tuple, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, score and id of the k best candidates of each query, of those that reach its floor.

    queries, candidates: ids, vectors and lengths.
    """
    q_ids, q, q_length = queries
    order = np.argsort(-candidates[2], kind="stable")
    ids, p, p_length = (x[order] for x in candidates)
    best = Best(floors, k)
    for first in range(0, len(ids), BUCKET):
        own = slice(first, first + BUCKET)
        b_ids, b, b_length = ids[own], p[own], p_length[own]
        reach = q_length * b_length[0]
        floor = best.floors - SLACK * (reach + 1)
        open_ = np.flatnonzero(floor <= reach)
        if not len(open_):
            continue
        cosine = np.where(reach > 0, floor / np.maximum(reach, 1e-300), -1.0)
        steep = open_[cosine[open_] >= STEEP]
        flat = open_[cosine[open_] < STEEP]
        if len(flat):
            need = np.where(floor[flat] > 0, floor[flat] / np.maximum(q_length[flat], 1e-300), 0.0)
            reaches = np.searchsorted(-b_length, -need, "right")
            n = int(reaches.max())
            score = _products(q[flat], b[:n])
            row, column = np.nonzero((score >= best.floors[flat][:, None]) & (np.arange(n) < reaches[:, None]) & (q_ids[flat][:, None] != b_ids[None, :n]))
            best.add(flat[row], score[row, column], b_ids[column])
        if len(steep):
            unit = b / np.maximum(b_length, 1e-300)[:, None]
            sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i in steep:
                f = int(np.abs(q[i]).argmax())
                if f not in sorted_by:
                    by = np.argsort(unit[:, f])
                    sorted_by[f] = by, unit[by, f]
                by, values = sorted_by[f]
                mine, c = q[i, f] / q_length[i], min(1.0, cosine[i])
                spread = np.sqrt(max(0.0, 1 - c * c) * max(0.0, 1 - mine * mine))
                low = -1.0 if mine < -c else mine * c - spread
                high = 1.0 if mine > c else mine * c + spread
                left = by[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, "right")]
                left = left[b_ids[left] != q_ids[i]]
                best.add(np.full(len(left), i), _products(q[i : i + 1], b[left])[0], b_ids[left])
        best.settle()
    return tuple(best.hits)


def _searched(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out = []
    by_size = {d: rest for d, *rest in _matrices(candidates, "vec_id")} if candidates.num_rows else {}
    floors = queries.column("floor").to_numpy(zero_copy_only=False) if queries.num_rows else np.empty(0)
    floor_of = dict(zip(queries.column("query_id").to_pylist(), np.nan_to_num(np.asarray(floors, np.float64), nan=-np.inf), strict=True))
    for d, ids, q, length in _matrices(queries, "query_id") if queries.num_rows else ():
        if d in by_size:
            query, score, vec_id = search((ids, q, length), tuple(by_size[d]), np.array([floor_of[i] for i in ids]), k)
            out.append((ids[query], vec_id, score))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
    return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(c.astype(np.int64)) for c in columns), strict=True)))


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows of vectors (vec_id, embedding) where is_query holds, their k best among all."""
    every = stored(prepared(vectors))
    n, n_queries = every.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    parts, blocks = max(1, -(-n // PART_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    spread = F.xxhash64("vec_id", "v")
    laid_out = every.repartitionByRange(parts, F.desc("length"), spread).select("vec_id", "v", "length", F.spark_partition_id().alias("part"))
    candidates = stored(laid_out)
    queries = every.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).join(every.select(F.col("vec_id").alias("query_id"), "v", "length").distinct(), ["query_id", "v"])
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
    keys = ["part", "block"]

    def against(some: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        left, right = some.join(pairs, "part"), asked.join(pairs, "block")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _searched(a, b, k), HIT)

    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    longest, last = candidates.agg(F.min("part"), F.max("part")).first()
    unknown = queries.withColumn("floor", F.lit(None).cast("double"))
    first = against(candidates.filter(F.col("part") == longest), unknown, every.sparkSession.range(1).select(F.lit(longest or 0).alias("part"), every_block))
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    need = F.when(F.col("floor") > 0, F.col("floor") / F.col("length")).otherwise(0.0)  # the length that a hit has at least
    known = queries.drop("block").join(floors, "query_id", "left").withColumn("need", need)
    asked = stored(known.repartitionByRange(blocks, "need", "query_id").withColumn("block", F.spark_partition_id()))
    needs = asked.groupBy("block").agg(F.min("need").alias("least"))
    lengths = candidates.groupBy("part").agg(F.max("length").alias("most"))
    pairs = needs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last or 0)))).join(lengths, "part")
    pairs = stored(pairs.filter(F.col("most") * (1 + 4 * SLACK) >= F.col("least") * (1 - 4 * SLACK)).select("part", "block"))
    hits = against(candidates, asked.drop("need"), pairs)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
