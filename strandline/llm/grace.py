"""Exact deduplication by Grace hash partitioning.

Each map task first folds its own rows: one row for each distinct text that it
has seen, with the ids that have it. Those rows are dealt out by hash, and each
partition is cut into spill files by further bits of the hash, again and again,
until a bucket's distinct texts fit an open-addressing table, which compares
whole texts. A text that holds a large share of all rows thus arrives once for
each map task (and each ``MEMORY`` bytes of distinct texts there) and is kept
once, whatever its share.

Spill files belong to one task, which deletes them as it goes: a lost executor
loses only what its tasks make again.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tables import free_name, stored

#: Bytes of distinct texts (and of what is kept for each row) that a table holds at most; one text alone may be longer.
MEMORY = 64 << 20
ROW_BYTES = 48
#: Files that a bucket is cut into, by so many bits of the 64-bit hash.
BITS = 4
LAST = (1 << 63) - 1


class Contents:
    """Distinct contents, numbered as they come, in an open-addressing table with linear probing."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.held = 0

    def _start(self, hash_: int) -> int:
        return (hash_ * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20 & len(self.slots) - 1

    def number(self, hash_: int, content: bytes) -> int:
        at, mask = self._start(hash_), len(self.slots) - 1
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == hash_ and self.contents[k] == content:
                return k
            at = at + 1 & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(hash_)
        self.contents.append(content)
        self.held += len(content) + ROW_BYTES
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return len(self.hashes) - 1

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, hash_ in enumerate(self.hashes):
            at = self._start(hash_)
            while self.slots[at] >= 0:
                at = at + 1 & mask
            self.slots[at] = k

    def numbers(self, batch: pa.RecordBatch) -> np.ndarray:
        pairs = zip(batch.column("hash").to_pylist(), batch.column("content").to_pylist(), strict=True)
        return np.fromiter((self.number(h, c) for h, c in pairs), np.int64, batch.num_rows)


def _spilled(batches: Iterator[pa.RecordBatch], folder: str, level: int) -> list[str]:
    """The rows of batches in files by the hash bits of a level."""
    writers: dict[int, pa.RecordBatchStreamWriter] = {}
    options = pa.ipc.IpcWriteOptions(compression="lz4")
    for batch in batches:
        bucket = batch.column("hash").to_numpy() >> (BITS * level) & (1 << BITS) - 1
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange((1 << BITS) + 1))
        for b in np.flatnonzero(np.diff(ends)):
            if b not in writers:
                writers[b] = pa.ipc.new_stream(f"{folder}/{b}", batch.schema, options=options)
            writers[b].write_batch(batch.take(pa.array(order[ends[b] : ends[b + 1]])))
    for writer in writers.values():
        writer.close()
    return [f"{folder}/{b}" for b in writers]


def _read(path: str) -> Iterator[pa.RecordBatch]:
    with pa.OSFile(path) as file:
        yield from pa.ipc.open_stream(file)
    os.remove(path)


def grace(batches: Iterator[pa.RecordBatch], memory: int = MEMORY, level: int = 0) -> Iterator[tuple[pa.Table, np.ndarray, Contents]]:
    """Buckets of rows (hash, content, ...): the rows without their content, the number of each one's content, and the contents.

    All rows of one content are in one bucket. Buckets that don't fit ``memory`` are cut by further bits of the hash; rows
    that agree in all of them stay together.
    """
    contents, rows, numbers, n = Contents(), [], [], 0
    batches = iter(batches)
    for batch in batches:
        numbers.append(contents.numbers(batch))
        rows.append(batch.drop_columns(["content"]))
        n += batch.num_rows
        if contents.held + ROW_BYTES * n > memory and len(contents.contents) > 1 and BITS * level < 64:
            break
    else:
        if n:
            yield pa.Table.from_batches(rows), np.concatenate(numbers), contents
        return

    def again() -> Iterator[pa.RecordBatch]:
        while rows:
            held, number = rows.pop(), numbers.pop()
            yield held.append_column("content", pa.array([contents.contents[k] for k in number], pa.binary())).select(batch.schema.names)
        contents.__init__()
        yield from batches

    with tempfile.TemporaryDirectory() as folder:
        for path in _spilled(again(), folder, level):
            yield from grace(_read(path), memory, level + 1)


def _folded(memory: int):
    """One row for each distinct content of a task: hash, content, sha256, and its items by id, null ids last."""

    def emit(contents: Contents, shas: list, numbers: list, items: list) -> pa.RecordBatch:
        number = np.concatenate(numbers)
        item = pa.concat_arrays(items)
        ids = item.field("id")
        order = np.lexsort((ids.fill_null(LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), number))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(number[order], np.arange(len(shas) + 1)), pa.int32()), item.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([pa.array(contents.hashes, pa.int64()), pa.array(contents.contents, pa.binary()), pa.array(shas, pa.string()), lists], ["hash", "content", "sha", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents, shas, numbers, items, n = Contents(), [], [], [], 0
        for batch in batches:
            number, known = contents.numbers(batch), len(shas)
            fresh, first = np.unique(number, return_index=True)
            shas += batch.column("sha").take(pa.array(first[fresh >= known])).to_pylist()
            numbers.append(number)
            items.append(pa.StructArray.from_arrays([batch.column("id"), batch.column("row")], ["id", "row"]))
            n += batch.num_rows
            if contents.held + ROW_BYTES * n > memory:
                yield emit(contents, shas, numbers, items)
                contents, shas, numbers, items, n = Contents(), [], [], [], 0
        if n:
            yield emit(contents, shas, numbers, items)

    return run


def _merged(memory: int):
    """For each folded row its class: the id that stays, the number of rows, and whether the row that stays is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number, contents in grace(batches, memory):
            least = rows.column("least").combine_chunks()
            unknown = least.is_null().to_numpy(zero_copy_only=False)
            first, slot = least.fill_null(LAST).to_numpy(), rows.column("slot").to_numpy()
            order = np.lexsort((slot, first, unknown, number))
            starts = np.searchsorted(number[order], np.arange(len(contents.contents)))
            size = np.add.reduceat(rows.column("n").to_numpy()[order], starts)
            best = order[starts]
            columns = [pa.array(slot), pa.array(first[best][number], mask=unknown[best][number]), pa.array(size[number]), pa.array(slot == slot[best][number])]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "keep_id", "group_size", "holds"])

    return run


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalised: bool = True, row: str | None = None, memory: int = MEMORY) -> DataFrame:
    """The id, keep_id, group_size, kept and text_sha256 of each row of docs, and the long column ``row``, if one is named.

    Texts are equal if they are identical, or with ``normalised`` if they are once each run of white space is one space;
    null counts as empty, and nothing is trimmed. keep_id is the smallest id of the class, null only if no row has one; of
    rows with that id and text one is kept (one of them, if they repeat). text_sha256 is of the text that was compared.
    Texts are handled whole, at some five times the bytes of the longest text. Other columns, whatever their names, play
    no part. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    content = (F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ") if normalised else text).cast("binary")
    carried = F.lit(None).cast("long") if row is None else F.col(row).cast("long")
    rows = docs.select(content.alias("content"), F.col(id_column).cast("long").alias("id"), carried.alias("row"))
    rows = rows.select("content", "id", "row", F.xxhash64("content").alias("hash"), F.sha2("content", 256).alias("sha"))
    folded = rows.mapInArrow(_folded(memory), "hash long, content binary, sha string, items array<struct<id: long, row: long>>")
    folded = stored(folded.withColumn("slot", F.monotonically_increasing_id()))
    dealt = folded.select("hash", "content", "slot", F.col("items")[0]["id"].alias("least"), F.size("items").cast("long").alias("n")).repartition("hash")
    found = dealt.mapInArrow(_merged(memory), "slot long, keep_id long, group_size long, holds boolean")
    both = folded.select("slot", "sha", "items").join(found.hint("merge"), "slot")  # as many rows as there are texts
    each = both.select("keep_id", "group_size", "holds", F.col("sha").alias("text_sha256"), F.posexplode("items").alias("at", "item"))
    own = [F.col("item.id").alias(id_column), "keep_id", "group_size", (F.col("holds") & (F.col("at") == 0)).alias("kept"), "text_sha256"]
    return each.select(*own, *([] if row is None else [F.col("item.row").alias(row)]))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalised: bool = True) -> DataFrame:
    """The rows of docs that stay, one for each class of equal texts, with all their columns and their text as it was."""
    row = free_name("row", docs.columns)
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    kept = classes(numbered, id_column, text_column, normalised, row).filter("kept").select(row)
    return numbered.join(kept.hint("merge"), row).select(*docs.columns)
