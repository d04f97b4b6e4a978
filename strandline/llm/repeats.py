"""Exact search for windows of a text that repeat in a corpus, by content-defined pieces.

Each window of W units (bytes or words) has an anchor, the lowest hash of the
k-unit grams in it, so that equal windows have equal anchors. Neighbouring
windows with one anchor form a run, whose units are a piece; pieces tile all
windows of a text, each window lies in one piece. Only pieces whose anchor may
occur elsewhere (packs.repeated) are sent on, each distinct piece of a blob
once, to the shard of its anchor; a shard is searched as a whole by the
operator's method, and its answer for each window of each piece comes back to
the blobs. A hot passage thus costs a shard one piece for each blob at most.

Texts of a blob are handled at once: about 150 bytes of memory for each unit of
a blob, or of the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import packs
from strandline.llm.tables import release, stored
from strandline.llm.tokens import SPACE, mix, powers, range_hashes, text_buffer, word_ranges

#: Bytes of pieces in a shard, about, where the pieces sent on are half of the text; walking its buckets pays for large shards.
SHARD_BYTES = 1 << 21


@dataclass
class Units:
    """The texts of a blob as units: data and offsets of the bytes, hashes and byte ranges of the units, first unit of each text.

    Without byte ranges a unit is a byte.
    """

    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None
    first: np.ndarray

    def bytes_of(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes of the units first to last begin and end."""
        return (first, last + 1) if self.starts is None else (self.starts[first], self.ends[last])


def byte_units(texts: pa.Array) -> Units:
    data, offsets = text_buffer(texts)
    return Units(data, offsets, data.astype(np.uint64) + np.uint64(1), None, None, offsets)


def word_units(texts: pa.Array) -> Units:
    data, offsets = text_buffer(texts)
    starts, ends, first = word_ranges(data, offsets, SPACE)
    return Units(data, offsets, range_hashes(data, starts, ends), starts, ends, first)


@dataclass
class Runs:
    """Runs of windows: anchor hash, text, first unit of the first window, number of windows."""

    anchor: np.ndarray
    text: np.ndarray
    start: np.ndarray
    n: np.ndarray

    def chosen(self, keep: np.ndarray) -> Runs:
        return Runs(*(x[keep] for x in (self.anchor, self.text, self.start, self.n)))


def runs_of(units: Units, window: int, gram: int) -> Runs:
    """All windows of the texts as runs of one anchor each."""
    n = len(units.hashes)
    nothing = np.empty(0, np.int64)
    if n < window:
        return Runs(nothing.view(np.uint64), nothing, nothing, nothing)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(units.hashes * up[:-1], out=sums[1:])
    grams = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]  # their high bits, which are compared, are mixed enough
    w = window - gram + 1
    mask = (np.uint64(1) << np.uint64(int(n).bit_length())) - np.uint64(1)
    low = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))  # the last one of equals
    m = n - window + 1
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:m], low[w - span : w - span + m])
    pick = (mask - (low & mask)).astype(np.int64)
    text = np.repeat(np.arange(len(units.first) - 1, dtype=np.int32), np.diff(units.first))[:m]
    last = np.repeat(units.first[1:].astype(np.int32) - window, np.diff(units.first))[:m]
    valid = np.arange(m, dtype=np.int32) <= last
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (pick[1:] != pick[:-1])
    start = np.flatnonzero(new)
    at = np.flatnonzero(valid)
    count = np.diff(np.append(np.searchsorted(at, start), len(at)))
    anchor = mix(grams[pick[start]])  # lowest hashes are low: mixed again they fill shards evenly
    return Runs(anchor, text[start].astype(np.int64), start, count)


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of all ranges one after the other."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def distinct_pieces(units: Units, runs: Runs, window: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the distinct pieces by (shard, hash of the piece's bytes); the shard of each; and for each run the number of its piece."""
    shard = (runs.anchor >> np.uint64(64 - shard_bits)).astype(np.int64)
    piece = range_hashes(units.data, *units.bytes_of(runs.start, runs.start + runs.n + window - 2))
    order = np.lexsort((piece, shard))
    a, b = shard[order], piece[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.empty(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], a[new], number


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes: the high bytes of small ones become runs of zeros, which compress to nothing."""
    return np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes, rows: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(rows, -1)


def ids_of(ids: pa.Array) -> np.ndarray:
    """Document ids; null ones come after all others."""
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Search:
    """What an operator looks for: units of texts, window and gram length in units, units in a byte of text about."""

    units: Callable[[pa.Array], Units]
    window: int
    gram: int
    units_per_byte: float

    def flagged_runs(self, texts: pa.Array, flags: list[dict] | None, bits: int) -> tuple[Units, Runs]:
        units = self.units(texts)
        runs = runs_of(units, self.window, self.gram)
        names, _ = packs.distinct(runs.anchor)
        may = packs.flags_of(names, flags, bits)[np.searchsorted(names, runs.anchor >> np.uint64(64 - packs.KEY_BITS))] if len(names) else np.empty(0, bool)
        return units, runs.chosen(may)


def searched(docs: DataFrame, search: Search, shard: Callable, value_type: type) -> tuple[DataFrame, Callable]:
    """Rows (ids, texts, flags, answers) of blobs, and a function that reads such a row.

    shard(contents, value, window) gets a shard's distinct pieces (bytes of each, the least document id and the count of
    its occurrences) and returns for all windows of all pieces, one after the other, a number. The function returned
    gives for a blob its units, its flagged runs, and the numbers of the windows of each run, one after the other.
    """
    blobs, size = packs.packed(docs)

    def keys_of(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return packs.distinct(runs_of(search.units(texts), search.window, search.gram).anchor)

    per_byte = search.units_per_byte * 2 / (search.window - search.gram + 2)
    flagged, bits = packs.repeated(blobs, size, keys_of, per_byte)
    shard_bits = max(2, int(np.ceil(np.log2(max(1.0, size / 2 / SHARD_BYTES)))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, ids, texts, i in packs.opened(batch):
                units, runs = search.flagged_runs(texts, batch.column("flags")[i].as_py(), bits)
                if not len(runs.start):
                    continue
                first, shards, number = distinct_pieces(units, runs, search.window, shard_bits)
                times = np.bincount(number, minlength=len(first)).astype(np.int64)
                own = ids_of(ids)[runs.text][np.argsort(number, kind="stable")]
                least = np.minimum.reduceat(own, np.cumsum(times) - times)
                begins, ends = units.bytes_of(runs.start[first], runs.start[first] + runs.n[first] + search.window - 2)
                content = gathered(units.data, begins, ends)
                upto = np.concatenate([[0], np.cumsum(ends - begins)])
                cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])), [len(shards)]])
                own = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = {
                    "shard": pa.array(shards[cuts[:-1]].astype(np.int32)),
                    "blob": pa.array(np.full(len(own), blob)),
                    "numbers": pa.array([_planes(np.stack([least[s], times[s], (ends - begins)[s]])) for s in own], pa.binary()),
                    "content": pa.array([content[upto[s.start] : upto[s.stop]].tobytes() for s in own], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def answer(table: pa.Table) -> pa.Table:
        numbers = [_from_planes(x.as_py(), 3) for x in table.column("numbers")]
        least, times, size = np.concatenate(numbers, 1)
        content = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("content")])
        begins = np.cumsum(size) - size
        _, first, number = np.unique(range_hashes(content, begins, begins + size), return_index=True, return_inverse=True)
        counts = np.bincount(number, minlength=len(first))
        low = np.minimum.reduceat(least[np.argsort(number, kind="stable")], np.cumsum(counts) - counts)
        distinct = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size[first])]).astype(np.int64)), pa.py_buffer(gathered(content, begins[first], begins[first] + size[first]))])
        units = search.units(distinct)
        del content
        values = shard(units, low, np.bincount(number, times, len(first)).astype(np.int64), search.window).astype(value_type)
        windows = np.diff(units.first) - search.window + 1
        place = np.cumsum(windows) - windows
        out = []
        for own in np.split(number, np.cumsum([x.shape[1] for x in numbers])[:-1]):
            out.append(gathered(values, place[own], place[own] + windows[own]).tobytes())
        return pa.table({"blob": table.column("blob"), "shard": table.column("shard"), "values": pa.array(out, pa.binary())})

    sent = flagged.mapInArrow(send, "shard int, blob long, numbers binary, content binary")
    found = stored(sent.groupBy("shard").applyInArrow(answer, "blob long, shard int, values binary"))
    release(docs.sparkSession)
    answers = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("shard", "values"))).alias("answers"))

    def look(batch: pa.RecordBatch, i: int, texts: pa.Array) -> tuple[Units, Runs, np.ndarray]:
        units, runs = search.flagged_runs(texts, batch.column("flags")[i].as_py(), bits)
        parts = batch.column("answers")[i].as_py() or []
        values = np.concatenate([np.empty(0, value_type), *(np.frombuffer(x["values"], value_type) for x in parts)])
        first, _, number = distinct_pieces(units, runs, search.window, shard_bits)
        windows = runs.n[first]
        place = np.cumsum(windows) - windows
        return units, runs, gathered(values, place[number], place[number] + runs.n)

    return flagged.join(answers.hint("merge"), "blob", "left"), look


def covered(n: int, runs: Runs, hit: np.ndarray, window: int) -> np.ndarray:
    """Which of n units lie in a hit window; hit: for each window of the runs, one after the other."""
    begins = np.repeat(runs.start - (np.cumsum(runs.n) - runs.n), runs.n) + np.arange(int(runs.n.sum()))
    starts = np.zeros(n + window, np.int32)
    starts[begins[hit] + window] = 1
    upto = np.cumsum(starts)
    # the hit windows that begin at most window - 1 units before
    return upto[window : window + n] > np.concatenate([np.zeros(min(window, n), np.int32), upto[window : window + n - min(window, n)]])
