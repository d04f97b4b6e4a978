"""Vectorised tokenising and hashing of Arrow text batches.

Texts of a batch lie in one byte buffer; words are (start, end) byte ranges
found with numpy. Working memory is about 40 bytes for each byte of a chunk of
at most ``CHUNK`` bytes plus 16 bytes a word, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Ranges of more bytes are hashed one by one.
LONG = 1024
#: An odd multiplier, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: ASCII white space as regular expressions of the contracts write it: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and offsets of each text in them; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split(batch: pa.RecordBatch, column: str, most: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text each, a longer single text alone."""
    sizes = np.diff(text_buffer(batch.column(column))[1])
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)


def word_ranges(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of the first word at or after its start.

    A word is a maximal run of bytes that are no separators; it never crosses texts.
    """
    inside = ~separator[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range.

    Ranges of up to LONG bytes are mixed eight bytes at a time, each step depending on the one before, so that no
    arrangement of bytes cancels out as it can in a polynomial modulo 2**64; longer ones get BLAKE2b.
    """
    sizes = ends - starts
    out = mix((sizes.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each position on
    long = sizes > LONG
    active, done = np.flatnonzero((sizes > 0) & ~long), 0
    while len(active):
        left = sizes[active] - done
        part = eight[starts[active] + done] & (~np.uint64(0) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
        out[active] = mix((out[active] ^ part) * np.uint64(BASE))
        active, done = active[left > 8], done + 8
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two neighbours as one; the order of the two matters."""
    return mix(left * np.uint64(BASE) + right)


def window_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive items (64-bit hashes), joined pair by pair with mixing at each level."""
    m = len(items) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, taken, level, span = None, 0, items, 1
    while True:
        if n & span:
            own = level[taken : taken + m]
            out = own if out is None else _joined(out, own)
            taken += span
        if taken == n:
            return mix(out + np.uint64(n))
        level, span = _joined(level[:-span], level[span:]), span * 2


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles of every text and the text of each; a text of fewer words, but not none, is one shingle.

    words: word hashes of all texts; first: for each text the number of its first word, and at the end their count.
    """
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words)) - first[:-1][text]
    whole = window_hashes(words, n)
    fits = np.flatnonzero(at + n <= counts[text])
    hashes, of = whole[fits], text[fits]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = np.array([int(window_hashes(words[first[i] : first[i + 1]], int(counts[i]))[0]) for i in short], np.uint64)
        own = mix(own + counts[short].astype(np.uint64))
        hashes, of = np.concatenate([hashes, own]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    return hashes, of
