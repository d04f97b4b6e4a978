"""Exact removal of repeated byte strings by suffix arrays.

Shards of a corpus (see repeats) are sorted by induced sorting; permuted common
prefixes tell which neighbours in the suffix array share ``LENGTH`` bytes, and
so which strings of that length are equal; the smallest document id of equal
ones is where the string stays.

Edge cases: null and empty texts have no bytes and lose none; strings never
cross documents; a string that repeats within one document only stays there;
rows that share a doc_id don't remove from each other; rows without a doc_id
come after all others, and not from each other either. Each input row gives one
result row, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import packs, repeats
from strandline.llm.suffixes import common_prefixes, suffix_array

LENGTH = 50
#: Bytes of the grams that anchors are.
GRAM = 24


def first_documents(units: repeats.Units, least: np.ndarray, times: np.ndarray, window: int) -> np.ndarray:
    """For each window of each text of a shard the smallest document id that has its bytes."""
    n = np.diff(units.offsets)
    # texts one after the other, each with a separator below all bytes behind it
    text = np.zeros(len(units.data) + len(n), np.int32)
    own = np.repeat(np.arange(len(n), dtype=np.int32), n)
    text[np.arange(len(units.data)) + own] = units.data.astype(np.int32) + 1
    sa = suffix_array(text, 257)
    left = np.zeros(len(text), np.int32)  # bytes of the text from here on
    left[np.arange(len(units.data)) + own] = np.repeat(units.offsets[1:].astype(np.int32), n) - np.arange(len(units.data), dtype=np.int32)
    piece = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
    long = sa[left[sa] >= window]
    shared = common_prefixes((text & 0xFF).astype(np.uint8), long, window)
    # suffixes with one such prefix are neighbours, and nothing stands between them
    group = np.cumsum(np.append(True, shared[long[1:]] < window)) - 1 if len(long) else np.empty(0, np.int64)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(long) else np.empty(0, np.int64)
    lowest = np.minimum.reduceat(least[piece[long]], starts) if len(long) else np.empty(0, np.int64)
    out = np.zeros(len(text), np.int64)
    out[long] = lowest[group]
    return out[left >= window]


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kept_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes that stay) for each row of docs."""
    search = repeats.Search(repeats.byte_units, length, gram, 1.0)
    blobs, look = repeats.searched(docs, search, first_documents, np.int64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, texts, i in packs.opened(batch):
                units, runs, first = look(batch, i, texts)
                document = repeats.ids_of(ids)
                gone = repeats.covered(len(units.data), runs, first < np.repeat(document[runs.text], runs.n), length)
                n = np.diff(units.offsets)
                sums = np.concatenate([[0], np.cumsum(gone)])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                at = units.offsets[:-1][n > 0]
                begins[at] = gone[at]
                spans = np.concatenate([[0], np.cumsum(begins)])
                per = [s[units.offsets[1:]] - s[units.offsets[:-1]] for s in (sums, spans)]
                data, stays = units.data, ~gone
                kept = [data[a:b][stays[a:b]].tobytes() for a, b in zip(units.offsets[:-1], units.offsets[1:], strict=True)]
                digest = [sha256(k).hexdigest() for k in kept]
                columns = [ids, *(pa.array(x.astype(np.int64)) for x in (n, *per)), pa.array(digest, pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if kept_bytes else columns, [*names, "kept"] if kept_bytes else names)

    return blobs.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_bytes)
