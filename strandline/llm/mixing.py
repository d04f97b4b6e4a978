"""Mixing sources to target weights out of fixed-length token blocks.

The words of a source, in an order given by a hash of the row, are packed into
blocks of ``BLOCK`` words. Each source's target in words is made of slots; the
slots are dealt to output shards by a multinomial draw of counts, and slot
numbers run through pseudorandom permutations of the source's block numbers,
one for each pass over the source, so that no block comes twice before all came
once. Slots and blocks are then joined by (source, block). The last slot of a
source is cut to the words that its target still needs.

Everything is a function of the rows and the seed, so reruns agree. Sources
may hold any share of the rows: their words are numbered in ``PART_WORDS``
parts, each a small window of its own. Nothing per row, block or slot reaches
the driver; the table of sources is reduced in Spark, too.

Edge cases: null and empty texts have size 0 and take part with no word; a null
source is a source of its own that comes last; sources without words get target
0; identical rows are packed one after the other and counted apart; an empty
table gives an empty mix. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tables import stored

BLOCK = 64
PART_WORDS = 1 << 20
SHARD_BLOCKS = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20
ROUNDS = 4
#: Slots that a task draws, about.
TASK_SLOTS = 1 << 17
GOLDEN = 0x9E3779B97F4A7C15


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank: their place by source from 0, null last. Sorted ranges count themselves, so no task sees all."""
    ordered = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_range", F.shiftrightunsigned("_id", 33))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    ranges = ordered.groupBy("_range").agg(F.count("*").alias("n"), F.min("_id").alias("_first")).withColumn("_before", before).drop("n")
    return ordered.join(ranges, "_range").withColumn("rank", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_range", "_first", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with rank and target.

    Targets share ``share`` of all sizes by weight; those above ``most`` times their source stop there and the excess is
    shared again, until none is above. Each round is one small aggregate.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("double")
    table = stored(ranked(sources).withColumn("weight", weight))
    cap = F.col("source_size") * F.lit(most)
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0  # words for each unit of weight
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        held, free = table.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not free or (whole - held) / free <= level * (1 + 1e-12):
            break
        level = (whole - held) / free
    return table.withColumn("target", F.least(cap, F.col("weight") * F.lit(level))).drop("weight")


def permuted(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 by a Feistel network over the next even power of two, walked until inside."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = slots.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, r) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def restored(blocks: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots that permuted() sends to the blocks."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = blocks.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in reversed(range(ROUNDS)):
            left, right = right ^ (_round(left, key, r) & mask), left
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    x = (x + np.uint64((key * 31 + r + 1) * GOLDEN % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _key(seed: int, rank: int, turn: int) -> int:
    return (seed * 1_000_003 + rank) * 1_009 + turn


def dealt(source: dict, shards: int, block: int = BLOCK, seed: int = SEED) -> Iterator[np.ndarray]:
    """The slots of a source by shard, an array for each turn: shard, turn, first slot, end slot, words of the last slot.

    Turns are passes over the source; a slot that ends before its block does is the last of the source.
    """
    size, need = source["source_size"], round(source["target"])
    blocks, short = -(-size // block), size % block or block
    for turn in range(-(-need // size) if size else 0):
        left = min(size, need - turn * size)
        if left == size:
            slots, last = blocks, 0
        else:
            at = int(restored(np.array([blocks - 1]), blocks, _key(seed, source["rank"], turn))[0])
            slots = -(-left // block)
            if at < slots:  # the short block is among them
                slots = -(-(left + block - short) // block)
            before = (slots - 1) * block - (block - short) * (at < slots - 1)
            last = left - before
        counts = np.random.default_rng([seed, source["rank"], turn]).multinomial(slots, np.full(shards, 1 / shards))
        ends = np.cumsum(counts)
        own = np.flatnonzero(counts)
        yield np.stack([own, np.full(len(own), turn), (ends - counts)[own], ends[own], np.where(ends[own] == slots, last, 0)], 1)


def placed(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, text: bool = False) -> DataFrame:
    """Every row of docs with its size, the rank, source_size and target of its source, and start: its first word's number in the source.

    (rank, part, nth) names a row. The text is kept on request.
    """
    order = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = stored(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), order.alias("order"), F.xxhash64("text").alias("hash"), *(["text"] * text)))
    sources = stored(targets(stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, share, most))
    parts = F.greatest(F.lit(1), F.ceil(F.col("source_size") / PART_WORDS))
    rows = rows.join(sources.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("part", F.floor(F.shiftrightunsigned("order", 1) / F.lit(float(1 << 63)) * parts).cast("long"))
    in_part = Window.partitionBy("rank", "part").orderBy("order", "doc_id", "size", "hash")
    upto = F.sum("size").over(in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = stored(rows.withColumns({"upto": upto, "nth": F.row_number().over(in_part)}).drop("order", "hash"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy("rank", "part").agg(F.sum("size").alias("n")).withColumn("before", before).drop("n")
    return rows.join(offsets, ["rank", "part"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("before", "upto")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows cut at the borders of blocks: block, place (in the block), first_word (in the row), n_words."""
    last = F.col("start") + F.col("size")
    low, high = F.greatest("start", F.col("block") * block), F.least(last, (F.col("block") + 1) * block)
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((last - 1) / block))
    cut = rows.filter(F.col("size") > 0).select("*", F.explode(blocks).alias("block"))
    return cut.withColumns({"place": low - F.col("block") * block, "first_word": low - F.col("start"), "n_words": high - low}).drop("start")


def slots(rows: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as slots: shard, slot (the order in the shard), rank, turn, block, take (at most so many of its words)."""
    sources = rows.groupBy("rank").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, round(total / block / SHARD_BLOCKS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.to_pylist():
                blocks = -(-source["source_size"] // block)
                for found in dealt(source, shards, block, seed):
                    for k in range(0, len(found), 1 << 16):
                        part = found[k : k + (1 << 16)]
                        same = [pa.array(np.full(len(part), x, np.int64)) for x in (source["rank"], blocks)]
                        yield pa.RecordBatch.from_arrays([*same, *(pa.array(x) for x in part.T)], ["rank", "blocks", "shard", "turn", "first", "end", "last"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                key = _key(seed, x["rank"], x["turn"])
                for first in range(x["first"], x["end"], 1 << 16):
                    number = np.arange(first, min(x["end"], first + (1 << 16)))
                    take = np.full(len(number), block)
                    if x["last"] and number[-1] + 1 == x["end"]:
                        take[-1] = x["last"]
                    same = [pa.array(np.full(len(number), x[name])) for name in ("shard", "rank", "turn")]
                    order = _round(number.astype(np.uint64), key, 77) >> np.uint64(1)
                    yield pa.RecordBatch.from_arrays([*same, pa.array(order.astype(np.int64)), pa.array(permuted(number, x["blocks"], key)), pa.array(take)], ["shard", "rank", "turn", "slot", "block", "take"])

    counts = sources.mapInArrow(deal, "rank long, blocks long, shard long, turn long, first long, end long, last long")
    tasks = max(1, math.ceil(total / block / TASK_SLOTS))  # a number, so that adaptive execution doesn't join these small rows
    return counts.repartition(tasks, "rank", "shard", "turn").mapInArrow(draw, "shard long, rank long, turn long, slot long, block long, take long")


def mix(rows: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix of placed rows: their pieces joined with the slots that take their blocks.

    Pieces of a shard in order of (slot, rank, turn, block, place) make its file. With a text among rows, text is that of the piece,
    its words joined by one space; n_words counts what is taken.
    """
    joined = pieces(rows, block).join(slots(rows, block, seed).hint("merge"), ["rank", "block"])  # slots grow with the input, unlike the sources they come from
    taken = F.least("n_words", F.col("take") - F.col("place"))
    joined = joined.filter(F.col("take") > F.col("place")).withColumn("n_words", taken).drop("take")
    if "text" in rows.columns:
        joined = joined.withColumn("text", F.concat_ws(" ", F.slice(words_of(F.col("text")), (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))))
    return joined


def taken(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mix takes) for each row of docs."""
    rows = stored(placed(docs, seed))
    sums = mix(rows, seed=seed).groupBy("rank", "part", "nth").agg(F.sum("n_words").alias("taken"))
    return rows.join(sums, ["rank", "part", "nth"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
