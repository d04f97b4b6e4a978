"""Centroid clustering by dual-tree Lloyd rounds, in exact integers.

Vectors are packed once into blocks, each with a cover tree: centres chosen
farthest first form nested nets, whose spacing halves from level to level, and
a node's points lie in one range of the block. Each round builds such a tree
over the centroids, too, and walks both down together: a pair of nodes goes
where the distance of the centres less both radii is beyond what another pair
promises for all points of the node. A node left with one centroid takes it for
all its points by their sum; what remains at the leaves is compared exactly.

Bounds are floating point with a margin and only ever keep too much. Blocks are
stored and never move: a round reads them, and what comes back is a sum for
each cluster and component.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tables import stored

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
#: Vectors in a block; a leaf of its tree has some LEAF.
BLOCK, LEAF = 2048, 16
#: Pairs whose distances are taken at once.
PAIRS = 1 << 15
SLACK = 1e-9
#: Up to this size of components sums of squares are exact in doubles; beyond it, Python's integers are used.
EXACT = 1 << 22
LONGEST = (1 << 63) - 1
TREE = ["begin", "end", "centre", "radius", "kid", "kids"]


@dataclass
class Tree:
    """Nodes, the root first: points begin .. end of ``order``, centre (an index of a point), radius, and kids from number kid on."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    kid: np.ndarray
    kids: np.ndarray


def cover_tree(points: np.ndarray, leaf: int) -> Tree:
    """A cover tree of points (doubles), refined until nets have as many centres as there are leaves of about leaf points."""
    n = len(points)
    most = max(1, -(-n // leaf))
    nearest, owner = np.full(n, np.inf), np.zeros(n, np.int64)
    centres, spacing = [], []
    at = 0
    while True:
        away = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        closer = away < nearest
        closer[at] = True
        spacing.append(nearest[at])
        nearest[closer], owner[closer] = away[closer], len(centres)
        nearest[at] = 0.0
        centres.append(at)
        at = int(nearest.argmax())
        if len(centres) >= most or nearest[at] == 0:
            break
    spacing, m = np.array(spacing), len(centres)
    levels = [1]  # centres of each net: those chosen while the spacing was over a power of two
    scale = 2.0 ** np.ceil(np.log2(max(spacing[1], 1e-300))) if m > 1 else 1.0
    while levels[-1] < m:
        scale /= 2
        count = int((spacing > scale).sum())
        if count > levels[-1]:
            levels.append(count)
    paths = np.zeros((m, len(levels)), np.int64)
    paths[:, -1] = np.arange(m)
    net = points[centres]
    for level in range(len(levels) - 2, -1, -1):
        inner, outer = levels[level], levels[level + 1]
        up = np.arange(outer)
        for c in range(inner, outer):
            up[c] = ((net[:inner] - net[c]) ** 2).sum(axis=1).argmin()
        paths[:, level] = up[paths[:, level + 1]]
    path = paths[owner]
    order = np.lexsort([np.arange(n), *path.T[::-1]])
    path = path[order]
    begin, end, centre, radius, kid, kids, deeper = [], [], [], [], [], [], []
    frontier = [(0, n, 0)]
    ordered = points[order]
    while frontier:
        coming = []
        for first, last, level in frontier:
            own = path[first, level]
            while level + 1 < len(levels) and (path[first:last, level + 1] == own).all():
                level += 1
            begin.append(first)
            end.append(last)
            centre.append(centres[own])
            radius.append(np.sqrt(((ordered[first:last] - net[own]) ** 2).sum(axis=1).max()))
            cuts = [] if level + 1 >= len(levels) else [first, *(first + 1 + np.flatnonzero(np.diff(path[first:last, level + 1]))), last]
            coming += [(a, b, level + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            kids.append(max(0, len(cuts) - 1))
        deeper.append(len(frontier))
        frontier = coming
    kids = np.array(kids)
    kid = 1 + np.cumsum(kids) - kids
    return Tree(order, np.array(begin), np.array(end), np.array(centre), np.array(radius) * (1 + SLACK), kid, kids)


def _distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] and b[j]; exact where components are within EXACT."""
    out = np.empty(len(i))
    for k in range(0, len(i), PAIRS):
        own = slice(k, k + PAIRS)
        gap = a[i[own]] - b[j[own]]
        out[own] = np.einsum("ij,ij->i", gap, gap)
    return out


def _children(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the pair and the node below it; a leaf stays."""
    n = np.maximum(1, tree.kids[nodes])
    pair = np.repeat(np.arange(len(nodes)), n)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return pair, np.where(tree.kids[nodes][pair] > 0, tree.kid[nodes][pair] + place, nodes[pair])


def walk(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes that have one centroid left, with it; and pairs of the leaves that don't and the centroids left to them.

    over has one centroid at each leaf.
    """
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    promised = np.full(len(tree.begin), np.inf)
    settled, open_ = [], []
    while len(q):
        away = np.sqrt(_distances(points, tree.centre[q], centroids, over.centre[r]))
        slack = SLACK * (away + tree.radius[q] + over.radius[r])
        np.minimum.at(promised, q, away + tree.radius[q] + slack)
        left = away - tree.radius[q] - over.radius[r] - slack <= promised[q]
        q, r = q[left], r[left]
        alone = (np.bincount(q, minlength=len(promised))[q] == 1) & (over.kids[r] == 0)
        settled.append((q[alone], over.centre[r[alone]]))
        q, r = q[~alone], r[~alone]
        several = np.bincount(q, over.kids[r] > 0, minlength=len(promised))[q] > 0
        done = (tree.kids[q] == 0) & ~several
        open_.append((q[done], over.centre[r[done]]))
        q, r = q[~done], r[~done]
        pair, below = _children(tree, q)
        above, r = q[pair], r[pair]
        promised[below] = np.minimum(promised[below], promised[above])
        pair, r = _children(over, r)
        q = below[pair]
    return *(np.concatenate(x) for x in zip(*settled, strict=True)), *(np.concatenate(x) for x in zip(*open_, strict=True))


def _expanded(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the node and place of each of its points."""
    n = tree.end[nodes] - tree.begin[nodes]
    pair = np.repeat(np.arange(len(nodes)), n)
    return pair, tree.begin[nodes][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)


def assigned(vectors: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Cluster of each place of tree.order, exactly, the smaller of equals; and the nodes settled whole, with their clusters."""
    points, middles = vectors.astype(float), centroids.astype(float)
    node, one, leaf, left = walk(points, tree, middles, over)
    cluster = np.full(len(vectors), -1, np.int64)
    pair, place = _expanded(tree, node)
    cluster[place] = one[pair]
    pair, place = _expanded(tree, leaf)
    best = {}
    if max(np.abs(points).max(initial=0), np.abs(middles).max(initial=0)) <= EXACT:
        away, candidate = _distances(points, tree.order[place], middles, left[pair]), left[pair]
        order = np.lexsort((candidate, away, place))
        first = np.flatnonzero(np.diff(place[order], prepend=-1))
        cluster[place[order][first]] = candidate[order][first]
    else:
        for at, candidate in zip(place.tolist(), left[pair].tolist(), strict=True):
            key = squared(vectors[tree.order[at]], centroids[candidate]), candidate
            best[at] = min(best.get(at, key), key)
        for at, (_, candidate) in best.items():
            cluster[at] = candidate
    return cluster, (node, one)


def squared(a: np.ndarray, b: np.ndarray) -> int:
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True))


def _packed(dimensions: int):
    def row(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        tree = cover_tree(vectors.astype(float), LEAF)
        data = [vectors[tree.order].astype("<i8").tobytes(), *(getattr(tree, c) for c in TREE)]
        place = np.argsort(tree.order)
        data[3] = place[tree.centre]  # vectors lie in the tree's order
        lists = [pa.array([x.tolist()]) for x in data[1:]]
        return pa.RecordBatch.from_arrays([pa.array([ids.take(pa.array(tree.order)).to_pylist()], pa.list_(pa.int64())), pa.array([data[0]], pa.binary()), *lists], ["ids", "vectors", *TREE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                some = batch.slice(first, BLOCK)
                ids.append(some.column("id"))
                parts.append(some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
                held += some.num_rows
                if held >= BLOCK:
                    yield row(pa.concat_arrays(ids), np.concatenate(parts))
                    ids, parts, held = [], [], 0
        if held:
            yield row(pa.concat_arrays(ids), np.concatenate(parts))

    return run


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            vectors = np.frombuffer(batch.column("vectors")[k].as_py(), "<i8").reshape(-1, dimensions)
            yield batch.column("ids")[k].values, vectors, Tree(np.arange(len(vectors)), *(batch.column(c)[k].values.to_numpy() for c in TREE))


def _summed(centroids: list[list[int]]):
    """cluster, component (-1: the count) and sum over all blocks of a task."""
    middles = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, total = cover_tree(middles.astype(float), 1), np.zeros((len(middles), middles.shape[1] + 1), object)
        over = _single(over)
        for _, vectors, tree in _blocks(batches, middles.shape[1]):
            cluster, (node, one) = assigned(vectors, tree, middles, over)
            small = len(vectors) * np.abs(vectors.astype(float)).max(initial=0) < 1 << 62
            counted = np.column_stack([np.ones(len(vectors), np.int64), vectors]) if small else np.column_stack([np.ones(len(vectors), object), vectors.astype(object)])
            running = np.concatenate([np.zeros((1, counted.shape[1]), counted.dtype), np.cumsum(counted, axis=0)])
            whole = running[tree.end[node]] - running[tree.begin[node]]
            np.add.at(total, one, whole.astype(object))
            rest = np.ones(len(vectors), bool)
            rest[_expanded(tree, node)[1]] = False
            for c in np.unique(cluster[rest]):
                total[c] += counted[rest & (cluster == c)].sum(axis=0).astype(object)
        own = np.flatnonzero(total[:, 0].astype(bool))
        size = middles.shape[1] + 1
        sums = pa.array([decimal.Decimal(int(x)) for x in total[own].ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, size).astype(np.int32)), pa.array(np.tile(np.arange(-1, size - 1), len(own)).astype(np.int32)), sums], ["cluster", "component", "total"])

    return run


def _single(tree: Tree) -> Tree:
    """tree with each leaf of several equal points cut into leaves of one."""
    many = np.flatnonzero((tree.kids == 0) & (tree.end - tree.begin > 1))
    parts = {name: [getattr(tree, name)] for name in TREE}
    n = len(tree.begin)
    tree.kid[many] = n + np.cumsum(tree.end[many] - tree.begin[many]) - (tree.end[many] - tree.begin[many])
    tree.kids[many] = tree.end[many] - tree.begin[many]
    for k in many:
        places = np.arange(tree.begin[k], tree.end[k])
        zeros = np.zeros(len(places), np.int64)
        for name, values in zip(TREE, (places, places + 1, tree.order[places], zeros.astype(float), zeros, zeros), strict=True):
            parts[name].append(values)
    return Tree(tree.order, *(np.concatenate(parts[name]) for name in TREE))


def _told(centroids: list[list[int]]):
    middles = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = _single(cover_tree(middles.astype(float), 1))
        for ids, vectors, tree in _blocks(batches, middles.shape[1]):
            cluster, _ = assigned(vectors, tree, middles, over)
            if max(np.abs(vectors.astype(float)).max(initial=0), np.abs(middles.astype(float)).max()) <= EXACT:
                distance = pa.array(((vectors - middles[cluster]) ** 2).sum(axis=1))
            else:
                each = [squared(v, middles[c]) for v, c in zip(vectors, cluster, strict=True)]
                distance = pa.array([x if x <= LONGEST else None for x in each], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), distance], ["vec_id", "cluster", "distance"])

    return run


def prepared(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """id and v: the floors of scale * x of the vectors of exactly so many components, all of them finite and within 62 bits then."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fits = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(1 << 62) / scale))
    return vectors.filter((F.size("embedding") == dimensions) & fits).select(F.col("vec_id").cast("long").alias("id"), x.alias("v"))


def lloyd(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance of each vector (stored), and the final centroids.

    The first centroids are the k vectors with the smallest SHA-256 of ``2:<vec_id>``, in that order; vectors of one id in
    order of their components, those without an id last. Fewer vectors give fewer centroids, none an empty table. A round
    gives each vector to the nearest centroid, the smaller number of equals, and moves each centroid that has vectors to
    the floor of their mean. Distances that no long holds are null. Vectors that are null, of another size, or hold a null,
    a non-finite component or one that no long holds are left out. The driver holds k centroids and their sums.
    """
    every = prepared(vectors, dimensions, scale)
    order = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    centroids = [list(r.v) for r in every.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()]
    schema = "ids array<long>, vectors binary, begin array<long>, end array<long>, centre array<long>, radius array<double>, kid array<long>, kids array<long>"
    blocks = stored(every.mapInArrow(_packed(dimensions), schema))
    for _ in range(rounds if centroids else 0):
        sums = blocks.mapInArrow(_summed(centroids), "cluster int, component int, total decimal(38,0)").groupBy("cluster", "component").agg(F.sum("total").alias("total"))
        found = {(r.cluster, r.component): int(r.total) for r in sums.collect()}
        centroids = [[found[c, j] // found[c, -1] for j in range(dimensions)] if (c, -1) in found else old for c, old in enumerate(centroids)]
    if not centroids:
        return blocks.select(F.explode("ids").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    return stored(blocks.mapInArrow(_told(centroids), "vec_id long, cluster int, distance long")), centroids


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that lloyd() keeps.

    Sums that no long holds are null. A row for each row of vectors: repeated ids and vectors stay.
    """
    found, centroids = lloyd(vectors, k, rounds, dimensions, scale)
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    told = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), whole).alias("total")).collect()  # k rows at most
    inertia = {r.cluster: None if r.total is None else int(r.total) for r in told}
    every = sum(inertia.values()) if None not in inertia.values() else None
    held = lambda x: x if x is not None and x <= LONGEST else None
    texts = [",".join(map(str, c)) for c in centroids]
    rows = [(c, held(x), held(every), texts[c]) for c, x in inertia.items()]
    each = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    out = found.join(F.broadcast(each), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
