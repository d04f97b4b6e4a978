"""Documents packed into blobs, and which of their keys occur more than once in the corpus.

A blob is one stored row with the ids and texts of neighbouring documents, so
that what is found about its keys can come back to it by one small row. Keys
are 64-bit hashes, of which ``KEY_BITS`` count; each blob sends its distinct
keys once, sorted and as differences, to key ranges ("buckets"), and gets a bit
for each key back. A hot key thus counts once per blob, and a bucket holds about
``BUCKET_KEYS`` keys, whatever the size of the corpus.

Keys that agree in KEY_BITS are taken for equal, so a set bit means that the
key may repeat, and an unset bit that it doesn't. Instead of a bit there may be
a level, which tells how often, by powers of two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.tables import release, stored

BLOB_BYTES = 1 << 20
#: Bytes of an Arrow batch; Spark's default lets a task hold 64 blobs and more at once.
BATCH_BYTES = 8 << 20
KEY_BITS = 40
BUCKET_KEYS = 1 << 20
#: Extra byte of keys that repeat within their blob.
REPEATS = 255
BLOBS = "ids array<long>, texts array<binary>"
#: Bytes of a blob at most, where a corpus is so large that its keys fall into many more buckets than a blob has keys.
LARGE_BLOB_BYTES = 8 << 20


def _packed(most: int, extra: tuple[str, ...]):
    names = ["ids", "texts", *extra]

    def row(columns: list[list[pa.Array]]) -> pa.RecordBatch:
        whole = [pa.concat_arrays(x) for x in columns]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in whole]
        return pa.RecordBatch.from_arrays(lists, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, size = [[] for _ in names], 0
        for batch in batches:
            text = pc.cast(batch.column("text"), pa.binary())
            lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            group = (np.cumsum(lengths) + size) // most
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                if first and columns[0]:
                    yield row(columns)
                    columns = [[] for _ in names]
                for held, values in zip(columns, (batch.column("doc_id"), text, *(batch.column(c) for c in extra)), strict=True):
                    held.append(values.slice(first, end - first))
            size = int(size + lengths.sum()) % most
        if columns[0]:
            yield row(columns)

    return run


def small_batches(spark: SparkSession) -> None:
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting, "64m")
    size = int(now.lower().rstrip("bkmg")) << {"k": 10, "m": 20, "g": 30}.get(now.lower().rstrip("b")[-1:], 0)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def packed(docs: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Stored blobs of docs (doc_id, text): blob, ids, texts and arrays of the boolean columns extra; and the bytes of all texts.

    Blobs grow with the square root of the corpus once it is beyond some tens of terabytes. Arrow batches of this session
    have at most BATCH_BYTES from here on, unless they already are smaller.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = max(BLOB_BYTES, min(LARGE_BLOB_BYTES, int(np.sqrt(total))))
    schema = ", ".join([BLOBS, *(f"{c} array<boolean>" for c in extra)])
    return stored(texts.mapInArrow(_packed(most, extra), schema).withColumn("blob", F.monotonically_increasing_id())), total


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, pa.Array, int]]:
    """Blob id, ids, texts and row number of each blob of a batch."""
    for i in range(batch.num_rows):
        yield batch.column("blob")[i].as_py(), batch.column("ids")[i].values, batch.column("texts")[i].values, i


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, cut to KEY_BITS, and the extra byte of each; REPEATS if it occurs more than once."""
    keys = np.sort(keys >> np.uint64(64 - KEY_BITS))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    many = np.diff(np.append(first, len(keys))) > 1
    return keys[first], np.where(many, REPEATS, 0).astype(np.uint8)


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - bits))


def squeezed(data: bytes) -> bytes:
    """Compressed with an entropy code, which the shuffle's own compression lacks; the size comes first."""
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def _encoded(keys: np.ndarray, extra: np.ndarray) -> bytes:
    """Differences of sorted keys by byte planes, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return squeezed(steps.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].T.tobytes() + extra.tobytes())


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(unsqueezed(data), np.uint8).reshape(KEY_BITS // 8 + 1, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : KEY_BITS // 8] = planes[:-1].T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64), planes[-1]


def bucket_bits(keys: float) -> int:
    """Bits of a bucket's number, for so many keys in all."""
    return max(2, int(np.ceil(np.log2(max(1.0, keys / BUCKET_KEYS)))))


def counts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, cut to KEY_BITS, and how often each occurs; 255 if more often."""
    keys = np.sort(keys >> np.uint64(64 - KEY_BITS))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.minimum(np.diff(np.append(first, len(keys))), 255).astype(np.uint8)


def _levels(counts: np.ndarray) -> np.ndarray:
    """0 for a key that occurs once, k for one that occurs up to 2^k times but more than 2^(k-1) times."""
    return np.ceil(np.log2(counts)).astype(np.uint8)


def repeated(blobs: DataFrame, total: int, keys_of: Callable, keys_per_byte: float, levels: bool = False) -> tuple[DataFrame, int]:
    """blobs, of total bytes, with flags: which of their distinct keys may occur elsewhere too; and the number of bits of a bucket's number.

    keys_of(ids, texts) gives a blob's keys and extras as distinct() does; for levels instead of bits, as counts_of() does.
    """
    bits = bucket_bits(total * keys_per_byte)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, ids, texts, _ in opened(batch):
                keys, extra = keys_of(ids, texts)
                at = _bounds(keys, bits)
                own = np.flatnonzero(np.diff(at))
                data = [_encoded(keys[at[b] : at[b + 1]] & np.uint64((1 << (KEY_BITS - bits)) - 1), extra[at[b] : at[b + 1]]) for b in own]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), blob)), pa.array(data, pa.binary())], ["bucket", "blob", "data"])

    def find(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_decoded(x.as_py()) for x in table.column("data")]
        sizes = [len(k) for k, _ in parts]
        keys, extra = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(keys)
        ordered, own = keys[order], extra[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(first, len(own)))
        flags = np.empty(len(keys), np.uint8 if levels else bool)
        flags[order] = np.repeat(_levels(np.add.reduceat(own, first, dtype=np.int64)) if levels else (times > 1) | (np.maximum.reduceat(own, first) == REPEATS), times)
        bits_of = [squeezed(x.tobytes()) if levels else np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]
        return pa.table({"blob": table.column("blob"), "bucket": pa.array(np.full(len(sizes), key[0].as_py(), np.int32)), "bits": pa.array(bits_of, pa.binary())})

    found = blobs.mapInArrow(send, "bucket int, blob long, data binary").groupBy("bucket").applyInArrow(find, "blob long, bucket int, bits binary")
    found = stored(found)
    release(blobs.sparkSession)
    flags = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("flags"))
    return blobs.join(flags.hint("merge"), "blob", "left"), bits  # flags grow with the input


def levels_of(keys: np.ndarray, flags: list[dict] | None, bits: int) -> np.ndarray:
    """As flags_of(), of levels."""
    at = _bounds(keys, bits)
    out = np.zeros(len(keys), np.uint8)
    for x in flags or []:
        out[at[x["bucket"]] : at[x["bucket"] + 1]] = np.frombuffer(unsqueezed(x["bits"]), np.uint8)
    return out


def flags_of(keys: np.ndarray, flags: list[dict] | None, bits: int) -> np.ndarray:
    """The flags of a blob's distinct keys, from the column that repeated() adds."""
    at = _bounds(keys, bits)
    out = np.zeros(len(keys), bool)
    for x in flags or []:
        first, end = at[x["bucket"]], at[x["bucket"] + 1]
        out[first:end] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=int(end - first)).astype(bool)
    return out


def _whole_planes(numbers: np.ndarray, width: int = 8) -> bytes:
    """Numbers of up to width bytes by byte planes."""
    return np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _of_planes(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def _in_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order in which a blob's sorted keys travel: by bucket, in a bucket even ones first."""
    place = (keys >> np.uint64(64 - bits)) * np.uint64(2) + (keys & np.uint64(1))
    return np.argsort(place, kind="stable")


def counted(blobs: DataFrame, total: int, keys_of: Callable, keys_per_byte: float, odd_bits: int = 63) -> tuple[DataFrame, DataFrame, Callable]:
    """blobs with answers: the corpus counts of their keys; a table of sums (odd, distinct, total) over the keys that count; and a reader.

    keys_of(row number, batch) gives a blob's sorted distinct 64-bit keys, even or odd by kind, and the count of each in
    the blob; of odd ones only the highest odd_bits differ. All counts are kept, whatever they are. The reader gets a
    batch, a row number and the blob's sorted keys, and gives the corpus count of each.
    """
    bits = bucket_bits(total * keys_per_byte)
    shifts = (np.uint64(1), np.uint64(64 - odd_bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, _, _, i in opened(batch):
                keys, counts = keys_of(i, batch)
                order = _in_order(keys, bits)
                keys, counts = keys[order], counts[order].astype(np.uint64)
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                at = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                own = np.flatnonzero(np.diff(at))
                data = []
                for b in own:
                    part, base = keys[at[b] : at[b + 1]], np.uint64(b) << np.uint64(64 - bits)
                    cut = int(np.searchsorted(part & np.uint64(1), 1))
                    steps = [np.diff(k - base >> shift, prepend=np.uint64(0)) for k, shift in zip((part[:cut], part[cut:]), shifts, strict=True)]
                    data.append(squeezed(cut.to_bytes(4, "little") + b"".join(map(_whole_planes, steps)) + _whole_planes(counts[at[b] : at[b + 1]], 4)))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), blob)), pa.array(data, pa.binary())], ["bucket", "blob", "data"])

    def find(key: tuple, table: pa.Table) -> pa.Table:
        base = np.uint64(key[0].as_py()) << np.uint64(64 - bits)
        sizes, keys, counts = [], [], []
        for x in table.column("data"):
            data = unsqueezed(x.as_py())
            cut, n = int.from_bytes(data[:4], "little"), (len(data) - 4) // 12
            sizes.append(n)
            for odd, steps in enumerate((data[4 : 4 + 8 * cut], data[4 + 8 * cut : 4 + 8 * n])):
                keys.append(base + (np.cumsum(_of_planes(steps), dtype=np.uint64) << shifts[odd]) + np.uint64(odd))
            counts.append(_of_planes(data[4 + 8 * n :], 4))
        names, number = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(number, np.concatenate(counts)).astype(np.uint64)
        del keys, counts
        answers = [squeezed(_whole_planes(x)) for x in np.split(sums[number], np.cumsum(sizes)[:-1])]
        odd = (names & np.uint64(1)).astype(np.int64)
        lists = []
        for weights in (sums > 0, sums):
            told = np.zeros((len(sizes), 2), np.int64)
            told[0] = np.bincount(odd, weights, 2)  # once for each bucket
            lists.append(pa.FixedSizeListArray.from_arrays(pa.array(told.ravel()), 2).cast(pa.list_(pa.int64())))
        return pa.table({"blob": table.column("blob"), "bucket": pa.array(np.full(len(sizes), key[0].as_py(), np.int32)), "counts": pa.array(answers, pa.binary()), "distinct": lists[0], "total": lists[1]})

    def read(batch: pa.RecordBatch, i: int, keys: np.ndarray) -> np.ndarray:
        parts = [_of_planes(unsqueezed(x["counts"])) for x in batch.column("answers")[i].as_py() or []]
        out = np.empty(len(keys), np.int64)
        out[_in_order(keys, bits)] = np.concatenate([np.empty(0, np.uint64), *parts])
        return out

    sent = blobs.mapInArrow(send, "bucket int, blob long, data binary")
    found = stored(sent.groupBy("bucket").applyInArrow(find, "blob long, bucket int, counts binary, distinct array<long>, total array<long>"))
    release(blobs.sparkSession)
    sums = found.select(F.posexplode(F.arrays_zip("distinct", "total")).alias("odd", "x")).groupBy("odd").agg(F.sum("x.distinct").alias("distinct"), F.sum("x.total").alias("total"))
    answers = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("answers"))
    return blobs.join(answers.hint("merge"), "blob", "left"), sums, read
