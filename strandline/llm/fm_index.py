"""Removal of repeated word windows by FM-indexes.

Each shard of a corpus (see repeats) is indexed as a Burrows-Wheeler transform
in a wavelet tree, levels of packed bits with counts for each 64 of them. The
shard's texts are streamed through it from right to left, all at once: a
backward-search step adds a word, and once ``WINDOW`` words match, the interval
is widened to all suffixes that share just these, so that the matching
statistics never fall below what the threshold needs. Windows whose interval
holds more than one occurrence are reported.

Edge cases: null, empty and wordless texts keep nothing and lose nothing; texts
of fewer than WINDOW words lose nothing; rows that repeat, also with the same
doc_id, are occurrences each, and so are those without an id. Each input row
gives one result row, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import packs, repeats
from strandline.llm.suffixes import common_prefixes, suffix_array

WINDOW = 35
#: Words of the grams that anchors are.
GRAM = 12


class WaveletTree:
    """Counts of symbols before a position, for arrays of symbols and positions."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bits = (text >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.counts.append(np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words))
            self.zeros.append(len(bits) - int(bits.sum()))
            text = np.concatenate([text[~bits], text[bits]])
        self.base = self._mapped(np.arange(symbols), np.zeros(symbols, np.int64))

    def _mapped(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        for level, words, counts, zeros in zip(reversed(range(self.levels)), self.words, self.counts, self.zeros, strict=True):
            word = position >> 6
            ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1)))
            position = np.where(symbol >> level & 1, zeros + ones, position - ones)
        return position

    def before(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        return self._mapped(symbol, position) - self.base[symbol]


class FMIndex:
    """A Burrows-Wheeler transform of texts (symbols from 1) that follow one another, each with a 0 behind it."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        self.sa = np.concatenate([[n], suffix_array(text, symbols)])
        before = np.concatenate([text + 1, [0]])[self.sa - 1]
        self.tree = WaveletTree(before, symbols + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=symbols + 1))])
        self.rows = n + 1

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more symbol on the left."""
        symbol = symbol + 1
        return self.below[symbol] + self.tree.before(symbol, low), self.below[symbol] + self.tree.before(symbol, high)


def occurrences(units: repeats.Units, least: np.ndarray, times: np.ndarray, window: int) -> np.ndarray:
    """For each window of each text of a shard: 1 if it occurs more than once, where a text stands for so many times."""
    n = np.diff(units.first)
    names, word = np.unique(units.hashes, return_inverse=True)
    own = np.repeat(np.arange(len(n)), n)
    text = np.zeros(len(word) + len(n), np.int64)
    text[np.arange(len(word)) + own] = word + 1
    index = FMIndex(text, len(names) + 1)
    shared = common_prefixes(text, index.sa[1:], window)[index.sa[1:]]
    edge = np.concatenate([[True], shared < window, [True]])  # of rows that share a window, and the end
    edges = np.flatnonzero(edge)
    group = np.cumsum(edge[:-1]) - 1
    weight = np.append(np.repeat(times, n + 1), 0)
    upto = np.concatenate([[0], np.cumsum(weight[index.sa])])
    windows = n - window + 1
    place = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), np.int8)
    end = units.first[1:] + np.arange(len(n))  # of each text, in the indexed one
    order = np.argsort(-n, kind="stable")
    low, high = np.zeros(len(n), np.int64), np.full(len(n), index.rows)
    for k in range(int(n.max(initial=0))):
        order = order[: int(np.searchsorted(-n[order], -k, "left"))]  # those longer than k
        a, b = index.extend(text[end[order] - 1 - k], low[order], high[order])
        if k >= window - 1:
            a, b = edges[group[a]], edges[group[a] + 1]
            out[place[order] + n[order] - 1 - k] = upto[b] - upto[a] > 1
        low[order], high[order] = a, b
    return out


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by a space) for each row of docs."""
    search = repeats.Search(repeats.word_units, window, gram, 1 / 6)
    blobs, look = repeats.searched(docs, search, occurrences, np.int8)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, texts, i in packs.opened(batch):
                units, runs, hit = look(batch, i, texts)
                gone = repeats.covered(len(units.hashes), runs, hit.astype(bool), window)
                sums = np.concatenate([[0], np.cumsum(gone)])
                counts = sums[units.first[1:]] - sums[units.first[:-1]]
                kept = []
                for k, (text, lost, a, b) in enumerate(zip(texts, counts.tolist(), units.first[:-1], units.first[1:], strict=True)):
                    words = text.as_py().split() if text.is_valid else []
                    kept.append(b" ".join([w for w, g in zip(words, gone[a:b].tolist(), strict=True) if not g] if lost else words))
                digest = [sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(units.first).astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(digest), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return blobs.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
