"""Exact Jaccard self-join on word shingles with vertical partitioning.

The global order puts shingles of one document alone first and those that most
documents have last, by powers of two and by hash among equals. Documents of one shingle set are one class. A
class is a candidate by the first shingles of its set in that order, its
prefix, of which two similar sets share one at least. Candidates that hang
together by shared prefix shingles are laid out side by side in blocks.

The order by hash is cut into ``FRAGMENTS`` ranges. Two blocks have a table of
partial overlaps of their sets for each range; these tables go on by pair of
blocks, where they are summed and held against the threshold. A pair of blocks
returns no more links than it needs to connect what it found to be linked.

Each block is compared with itself first. The smallest members of the groups
that this connects are laid out and compared alone, as long as that halves
them; so a large group of near copies shrinks by a block's size at each turn.
Pairs of blocks come last, and only of those documents that share a prefix
shingle with one they aren't connected with yet.

No list of a shingle's documents is ever built, and classes, links and
components stay in Spark. Nothing is broadcast by the operator.

Edge cases: null, empty and wordless texts have an empty set and link with
nothing; an empty table gives no rows; a null doc_id gets its n_shingles and no
component; rows that share a doc_id are one node with all their links; very long
texts take a block alone, about 150 bytes of memory for each of theirs; other
columns are ignored. Shingles are equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import packs
from strandline.llm.components import components, labels, stars
from strandline.llm.tables import stored
from strandline.llm.tokens import ASCII_LOWER, mix, range_hashes, shingle_hashes, text_buffer, word_ranges

WORDS = 4
PERCENT = 85
#: A block has at most so many sets, and so many shingles unless one set has more.
BLOCK = 256
BLOCK_SHINGLES = 1 << 16
#: Ranges that the global order is cut into; a power of two.
FRAGMENTS = 4
#: Shingles of a range that one dense product takes at once.
COLUMNS = 2_048


def shingle_sets(texts: pa.Array | pa.ChunkedArray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, and where those of each text begin (and the last end); sorted within a text."""
    data, offsets = text_buffer(texts)
    data = ASCII_LOWER[data]
    starts, ends, first = word_ranges(data, offsets)
    hashes, of = shingle_hashes(range_hashes(data, starts, ends), first, words)
    order = np.argsort(hashes)
    order = order[np.argsort(of[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(len(texts) + 1))


def _class_keys(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of each set that don't depend on order."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (hashes, mix(hashes ^ np.uint64(0xA5A5A5A5)))]
    return [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]


def _shared_order(hashes: np.ndarray, of: np.ndarray, levels: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The global order within each text: shingles of few documents first, then by hash; and which ones several documents may have."""
    level = levels[np.searchsorted(names, hashes >> np.uint64(64 - packs.KEY_BITS))]
    return np.argsort(of * 64 + level, kind="stable"), level > 0  # they are in order of hash


def _described(bits: int, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, texts, i in packs.opened(batch):
                hashes, first = shingle_sets(texts, words)
                n = np.diff(first)
                keys = _class_keys(hashes, first)
                of = np.repeat(np.arange(len(n)), n)
                names, _ = packs.distinct(hashes)
                order, common = _shared_order(hashes, of, packs.levels_of(names, batch.column("flags")[i].as_py(), bits), names)
                length = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                prefix = (np.arange(len(hashes)) - first[:-1][of] < length[of]) & common[order]
                counts = np.bincount(of[prefix], minlength=len(n))
                prefixes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(hashes[order][prefix].view(np.int64)))
                kept = pa.array([packs.squeezed(texts[k].as_buffer() or b"") if c else None for k, c in enumerate(counts)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), *map(pa.array, keys), prefixes, kept], ["doc_id", "n_shingles", "key1", "key2", "prefix", "text"])

    return run


def described(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, key1, key2 (of its set), prefix (its prefix's shingles that several documents may have), text (compressed) if there are any."""

    def keys_of(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return packs.counts_of(shingle_sets(texts, words)[0])

    flagged, bits = packs.repeated(*packs.packed(docs), keys_of, 0.2, levels=True)
    return stored(flagged.mapInArrow(_described(bits, words, percent), "doc_id long, n_shingles long, key1 long, key2 long, prefix array<long>, text binary"))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if counts.max(initial=0) <= np.iinfo(t).max))


def _partial(words: int, fragments: int):
    names = ("left", "right", "fragment", "ids", "sizes", "n_left", "counts")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        """For each range of the global order, how many shingles each set of the left block shares with each of the right one there.

        Without a right block, the left one is compared with itself. Ids and sizes come with the first range.
        """
        table = table.sort_by([("side", "ascending"), ("doc_id", "ascending")])
        hashes, first = shingle_sets(pa.array([packs.unsqueezed(x.as_py()) for x in table.column("text")], pa.binary()), words)
        ids, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
        n_left = int((side == 0).sum())
        left, right = (slice(0, n_left), slice(n_left, None)) if n_left < len(ids) else (slice(None), slice(None))
        sizes = np.diff(first).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), sizes)
        found, column, times = np.unique(hashes, return_inverse=True, return_counts=True)  # the global order: by hash
        kept = times > 1
        rank = np.where(kept, np.cumsum(kept) - 1, -1)[column]
        order = np.argsort(rank, kind="stable")
        order = order[int((rank < 0).sum()) :]
        row, rank = row[order], rank[order]
        bounds = np.searchsorted(found[kept], np.arange(1, fragments, dtype=np.uint64) << np.uint64(65 - fragments.bit_length()))
        out: dict[str, list] = {name: [] for name in names}
        for k, (begin, end) in enumerate(zip([0, *bounds], [*bounds, int(kept.sum())], strict=True)):
            overlap = np.zeros((len(ids[left]), len(ids[right])), np.float32)
            for at in range(begin, end, COLUMNS):
                own = slice(*np.searchsorted(rank, [at, min(end, at + COLUMNS)]))
                has = np.zeros((len(ids), COLUMNS), np.float32)
                has[row[own], rank[own] - at] = 1
                overlap += has[left] @ has[right].T
            if k == 0 or overlap.any():
                told = [ids.astype(np.int64).tobytes(), sizes.tobytes()] if k == 0 else [b"", b""]
                for name, value in zip(names, [key[0].as_py(), key[1].as_py(), k, *told, n_left, packs.squeezed(_small(overlap).tobytes())], strict=True):
                    out[name].append(value)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        return pa.table({name: pa.array(out[name], t) for name, t in zip(names, types, strict=True)})

    return run


def _summed(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, sizes = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), np.int64) for c in ("ids", "sizes"))
        n_left = table.column("n_left")[0].as_py()
        shift = n_left if n_left < len(ids) else 0
        left, right = np.arange(n_left), np.arange(shift, len(ids))
        overlap = np.zeros((len(left), len(right)), np.int64)
        for counts in table.column("counts"):
            data = packs.unsqueezed(counts.as_py())
            overlap += np.frombuffer(data, f"<u{len(data) // overlap.size}").reshape(overlap.shape)
        union = sizes[left][:, None] + sizes[right][None, :] - overlap
        a, b = np.nonzero((overlap > 0) & (100 * overlap >= percent * union))
        forest = Forest(len(ids))
        for i, j in zip(a.tolist(), (b + shift).tolist(), strict=True):
            forest.join(i, j)
        # each on its root, so that components() finds stars instead of chains
        pairs = np.array([(i, root) for i in range(len(ids)) if (root := forest.root(i)) != i], np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[pairs[:, 0]], pa.int64()), "b": pa.array(ids[pairs[:, 1]], pa.int64())})

    return run


def compared(sets: DataFrame, work: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect what links; work: doc_id, left, right (blocks) and side (0 in the left one, 1 in the right one)."""
    partial = sets.select("doc_id", "text").join(work, "doc_id").groupBy("left", "right").applyInArrow(_partial(words, FRAGMENTS), "left long, right long, fragment int, ids binary, sizes binary, n_left int, counts binary")
    return stored(partial.groupBy("left", "right").applyInArrow(_summed(percent), "a long, b long"))


def _blocked(most: int):
    names = ["doc_id", "n_shingles", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition in blocks of at most BLOCK_SHINGLES shingles, or one set; a label that fits in a block isn't cut.

        block holds the partition's number before.
        """
        number, held, docs, last = 0, 0, 0, None
        for batch in batches:
            block = []
            columns = (batch.column(c).to_pylist() for c in ("n_shingles", "label", "of_label", "docs_of_label", "block"))
            for n, label, all_, all_docs, part in zip(*columns, strict=True):
                fits = all_ <= BLOCK_SHINGLES and all_docs <= most
                more, more_docs = (all_, all_docs) if label != last and fits else (n, 1)
                if docs and (held + more > BLOCK_SHINGLES or docs + more_docs > most):
                    number, held, docs = number + 1, 0, 0
                held, docs, last = held + n, docs + 1, label
                block.append((part << 32) + number)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(block, pa.int64())], [*names, "block"])

    return run


def blocks_of(placed: DataFrame) -> DataFrame:
    """placed (doc_id, n_shingles, label) with block: neighbours by label and size."""
    order = ["label", "n_shingles", "doc_id"]
    sizes = placed.groupBy("label").agg(F.sum("n_shingles").alias("of_label"), F.count("*").alias("docs_of_label"))
    ordered = placed.join(sizes, "label").repartitionByRange(max(1, placed.count() // (16 * BLOCK)), *order).sortWithinPartitions(*order)
    return stored(ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), 33)).mapInArrow(_blocked(BLOCK), "doc_id long, n_shingles long, label long, block long"))


def _within(blocks: DataFrame) -> DataFrame:
    """Work that compares each block with itself."""
    return blocks.select("doc_id", F.col("block").alias("left"), F.col("block").alias("right"), F.lit(0).alias("side"))


def _grouped(rows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, ...) with the component that the edges put the document in, itself without any; and the edges as stars."""
    hung = stars(edges)
    label = labels(hung)
    return stored(rows.join(label, rows["doc_id"] == label["node"], "left").select(*rows.columns, F.coalesce("component", "doc_id").alias("component"))), hung


def _heads(grouped: DataFrame) -> DataFrame:
    """The smallest member of each group of several documents, where its label has several such groups."""
    groups = grouped.groupBy("label", "component").agg(F.count("*").alias("n")).filter("n > 1")
    several = groups.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
    named = groups.join(several, "label", "left_semi").select(F.col("component").alias("doc_id"))
    return stored(grouped.join(named, "doc_id", "left_semi").select("doc_id", "n_shingles", "label"))


def links(sets: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that connect all that link, between the rows of sets (as described() gives, of one document for each set)."""
    rows = sets.filter(F.size("prefix") > 0).select(F.explode("prefix").alias("token"), "doc_id", "n_shingles")
    shared = stored(rows.groupBy("token").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).filter(F.col("hub") != F.col("other")).drop("other"))
    near = stored(rows.join(shared, "token"))
    # each document hangs on its smallest hub, and its other hubs hang on that one: few pairs, as copies have the same hubs
    first = near.groupBy("doc_id").agg(F.min("hub").alias("first"))
    hubs = near.select("doc_id", "hub").join(first, "doc_id").select(F.col("hub").alias("a"), F.col("first").alias("b")).distinct()
    label = components(first.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).unionByName(hubs))
    placed = stored(sets.join(label, sets["doc_id"] == label["node"]).select("doc_id", "n_shingles", F.col("component").alias("label")))
    blocks = blocks_of(placed)
    edges = compared(sets, _within(blocks), words, percent)
    wide = stored(blocks.groupBy("label").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high").select("label"))
    if wide.isEmpty():
        return edges
    # the smallest members of connected groups, alone, as long as that halves them
    members = stored(blocks.join(wide, "label", "left_semi"))
    grouped, edges = _grouped(members, edges)
    heads = _heads(grouped)
    left = heads.count()
    while left > 1:
        grouped, edges = _grouped(members, edges.unionByName(compared(sets, _within(blocks_of(heads)), words, percent)))
        heads, before = _heads(grouped), left
        left = heads.count()
        if 2 * left > before:
            break
    # those that share a prefix shingle with one that they aren't connected with
    open_ = near.join(grouped.select("doc_id", "block", "component"), "doc_id")
    split = stored(open_.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token"))
    open_ = stored(open_.join(split, "token").select("token", "doc_id", "n_shingles", "block", "component"))
    tokens = open_.groupBy("token", "block").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), F.min("component").alias("low"), F.max("component").alias("high"))
    i, j = tokens.alias("i"), tokens.alias("j")
    may = (F.col("i.token") == F.col("j.token")) & (F.col("i.block") < F.col("j.block")) & (F.col("i.most") * 100 >= F.col("j.least") * percent) & (F.col("j.most") * 100 >= F.col("i.least") * percent)
    may &= F.least("i.low", "j.low") < F.greatest("i.high", "j.high")
    pairs = stored(i.join(j, may).select(F.col("i.block").alias("left"), F.col("j.block").alias("right")).distinct())
    if pairs.isEmpty():
        return edges
    sides = pairs.select(F.col("left").alias("block"), "left", "right", F.lit(0).alias("side")).unionByName(pairs.select(F.col("right").alias("block"), "left", "right", F.lit(1).alias("side")))
    across = open_.select("doc_id", "block").distinct().join(sides, "block").select("doc_id", "left", "right", "side")
    return edges.unionByName(compared(sets, across, words, percent))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    sets = described(docs, words, percent)
    key = ["n_shingles", "key1", "key2"]
    named = sets.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(named.groupBy(*key).agg(F.min("doc_id").alias("rep")))
    chosen = named.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi").filter(F.size("prefix") > 0)
    edges = links(stored(chosen.dropDuplicates([*key, "doc_id"])), words, percent)
    # rows of one doc_id are one node
    same = named.join(classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    twice = same.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).filter("b <> c")
    edges = stored(edges.unionByName(twice.select("a", "b")).unionByName(same.join(twice.select("a"), "a").select("a", "b")))
    label = components(edges)
    of_class = classes.join(label, classes["rep"] == label["node"], "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    found = named.join(of_class, key).select("doc_id", "n_shingles", "component_id")
    alone = sets.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with the rows of one document of each component, the one of the smallest id; rows without an id stay."""
    found = join(docs, words, percent)
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
