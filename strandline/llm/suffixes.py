"""Suffix arrays by induced sorting, in numpy.

Suffixes are classified as larger (L) or smaller (S) than their right
neighbour; leftmost-smaller (LMS) substrings are sorted by words of several
symbols and named; the order of those whose names several have is found
recursively, whatever the number of names; and two linear passes induce the
whole array. A pass goes through the symbols' buckets in order. Neighbouring
buckets are taken side by side as far as none of them induces a suffix in
another one of them; a bucket that induces in itself is taken in waves, and
waves of a few suffixes (runs of one symbol) one by one.

Memory is about 60 bytes for each symbol.
"""

from __future__ import annotations

import numpy as np

#: Suffixes of neighbouring buckets that are tried side by side at first; the number follows what went well.
SPAN = 1 << 10
#: Waves of fewer suffixes are walked one by one.
FEW = 16
#: Names that 16 bits can't hold, by which fewer are sorted.
MANY = 1 << 15


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of text (integers from 0 below symbols) in order; the end is smaller than any symbol."""
    text = np.ascontiguousarray(text, np.int32)
    if not len(text):
        return np.empty(0, np.int32)
    smaller = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    count = np.bincount(text, minlength=symbols)
    if not len(lms):
        return _induced(text, smaller, lms, count)
    sorted_lms, same = _substrings(text, lms)
    rank = np.cumsum(~same) - 1
    names, distinct = np.zeros(len(text), np.int32), int(rank[-1]) + 1
    names[sorted_lms] = rank
    if distinct < len(lms):
        # a name of one substring alone settles its place and ends all comparisons: one of these behind others is enough
        times = np.bincount(names[lms], minlength=distinct)
        shared = times[names[lms]] > 1
        string = shared.copy()
        string[1:] |= shared[:-1]
        number = np.cumsum(np.bincount(names[lms[string]], minlength=distinct) > 0) - 1
        order = lms[string][suffix_array(number[names[lms[string]]], int(number[-1]) + 1)]
        sorted_lms[times[names[sorted_lms]] > 1] = order[times[names[order]] > 1]
    return _induced(text, smaller, sorted_lms, count)


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    less = np.append(text[:-1] < text[1:], False)
    at = np.where(differs, np.arange(n, dtype=np.int64), n)
    return less[np.minimum.accumulate(at[::-1])[::-1]]


def _substrings(text: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The LMS substrings in order, and which ones equal the one before; symbols are compared as many at once as 63 bits hold.

    The end of the text is a symbol below all others. Behind its end a substring has one above all others: a longer one
    that begins with it goes on with a larger suffix's symbol where it ends, and such suffixes come first.
    """
    bits = (int(text.max()) + 2).bit_length()
    at_once = 63 // bits
    full = np.uint64((1 << bits * at_once) - 1)
    symbols = np.append(text + np.int32(1), np.zeros(at_once, np.int32))
    length = np.append(lms[1:], len(text)) - lms + 1  # with the first symbol of the next one

    def word(i: np.ndarray, k: int) -> np.ndarray:
        at = np.minimum(lms[i] + k, len(text))
        out = symbols[at].astype(np.uint64)
        for j in range(1, at_once):
            out = (out << np.uint64(bits)) | symbols[at + j].astype(np.uint64)
        return out | (full >> (np.uint64(bits) * np.clip(length[i] - k, 0, at_once).astype(np.uint64)))

    key = word(np.arange(len(lms)), 0)
    order = np.argsort(key)
    key = key[order]
    same = np.append(False, key[1:] == key[:-1])
    place, group, k = np.arange(len(lms)), np.cumsum(~same) - 1, at_once
    while True:  # places of those that seem equal to others, one of them being longer
        longer = np.bincount(group, length[order[place]] > k) > 0
        place = place[(longer & (np.bincount(group) > 1))[group]]
        if not len(place):
            return lms[order], same
        group = np.append(0, np.cumsum(~same[place[1:]]))
        i = order[place]
        key = word(i, k)
        by = np.lexsort((key, group))
        order[place], key = i[by], key[by]
        same[place[1:]] &= key[1:] == key[:-1]
        group, k = np.append(0, np.cumsum(~same[place[1:]])), k + at_once


def packed_words(text: np.ndarray, beyond: int) -> np.ndarray:
    """For each position of a byte string, and ``beyond`` more, the eight bytes from there on as one integer; zeros follow the end."""
    n = len(text) + beyond
    packed = np.zeros(n + 8, np.uint64)
    packed[: len(text)] = text
    for step in (1, 2, 4):  # two, four, eight bytes
        packed[:-step] |= packed[step:] << np.uint64(8 * step)
    return packed[:n]


def _spread(sa: np.ndarray, symbols: np.ndarray, found: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Put the suffixes found, in this order, at the edges of the buckets of their symbols, which move by step."""
    while len(edge) >= MANY and len(sa) < 4 * len(edge) and len(symbols):  # the first of each symbol, as long as most are
        places = edge[symbols]
        backwards = np.arange(len(symbols) - 1, -1, -1, dtype=np.int32)
        sa[places[::-1]] = backwards  # the first one is written last
        first = sa[places] == backwards[::-1]
        if 4 * np.count_nonzero(first) < 3 * len(first):
            sa[places] = -1
            break
        sa[places[first]] = found[first]
        edge[symbols[first]] += step
        rest = ~first
        symbols, found = symbols[rest], found[rest]
    if not len(symbols):
        return
    order = np.argsort(symbols.astype(np.int16) if len(edge) < MANY else symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, len(ordered)))
    place = np.arange(len(ordered)) - np.repeat(first, size)
    sa[edge[ordered] + step * place] = found[order]
    edge[ordered[first]] += step * size


def _induced(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The suffix array that the given order of LMS suffixes induces."""
    sa = np.full(len(text), -1, np.int32)
    end = np.cumsum(count)
    if len(lms):
        _spread(sa, text[lms], lms.astype(np.int32), end - np.bincount(text[lms], minlength=len(count)), 1)
    seeds = np.flatnonzero(sa >= 0)
    last = np.array([len(text) - 1], np.int32)
    head = end - count
    _spread(sa, text[last], last, head, 1)
    _pass(sa, np.where(smaller, np.int32(-1), text), text, count, head, 1)
    sa[seeds] = -1  # the second pass puts them where they belong
    _pass(sa, np.where(smaller, text, np.int32(-1)), text, count, end - 1, -1)
    return sa


def _pass(sa: np.ndarray, wanted: np.ndarray, text: np.ndarray, count: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Induce the suffixes that are wanted: upwards with step 1, downwards with step -1.

    wanted: the symbol of each of these, -1 for others; edge: where the next suffix of each bucket goes.
    """
    end = np.cumsum(count)
    begin = end - count
    c, span, last = (0, SPAN, len(count)) if step > 0 else (len(count) - 1, SPAN, -1)
    while c != last:
        if step > 0:
            d = max(c + 1, int(np.searchsorted(end, begin[c] + span, "right")))
            entries = sa[begin[c] : end[d - 1]]
        else:
            d = min(c - 1, int(np.searchsorted(begin, end[c] - span, "left")) - 1)
            entries = sa[begin[d + 1] : end[c]][::-1]
        if d == c + step:
            _bucket(sa, wanted, c, int(begin[c]), int(end[c]), edge, step)
            c, span = d, max(SPAN, span // 2)
            continue
        found, symbols = _before(entries, wanted)
        if len(found):
            nearest = int(symbols.min() if step > 0 else symbols.max())
            if nearest == c:
                _bucket(sa, wanted, c, int(begin[c]), int(end[c]), edge, step)
                c += step
                continue
            if step * (d - nearest) > 0:  # buckets before this one are complete
                before = step * (nearest - text[found + 1]) > 0
                found, symbols = found[before], symbols[before]
                d, span = nearest, max(64, span // 2)
            else:
                span = min(2 * span, 1 << 20)
            if len(found):
                _spread(sa, symbols, found, edge, step)
        c = d


def _before(entries: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted ones of the suffixes that begin one before entries, and their symbols."""
    found = entries[entries > 0] - 1
    symbols = wanted[found]
    good = symbols >= 0
    return found[good], symbols[good]


def _bucket(sa: np.ndarray, wanted: np.ndarray, c: int, begin: int, end: int, edge: np.ndarray, step: int) -> None:
    """Induce from one bucket, at first from its suffixes of the wanted kind, to which it may add."""
    done = begin if step > 0 else end - 1
    while done != edge[c]:
        stop = int(edge[c])
        if abs(stop - done) < FEW:
            while done != stop:
                i = int(sa[done]) - 1
                done += step
                symbol = int(wanted[i]) if i >= 0 else -1
                if symbol >= 0:
                    sa[edge[symbol]] = i
                    edge[symbol] += step
                    stop = stop + step if symbol == c else stop
            continue
        found, symbols = _before(sa[done:stop] if step > 0 else sa[stop + 1 : done + 1][::-1], wanted)
        done = stop
        if len(found):
            _spread(sa, symbols, found, edge, step)
    found, symbols = _before(sa[done:end] if step > 0 else sa[begin : done + 1][::-1], wanted)
    if len(found):
        _spread(sa, symbols, found, edge, step)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each position what its suffix shares with the one before it in sa, up to most.

    sa may hold some suffixes alone, in their order; the others get 0. text holds bytes or larger integers. A prefix may
    run over separators; the caller knows how far one may go.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    active = np.flatnonzero(before >= 0)
    if text.dtype == np.uint8:  # eight bytes at once
        packed = packed_words(text, most + 8)
        for done in range(0, most, 8):
            differ = packed[active + done] ^ packed[before[active] + done]
            stops = differ != 0
            lowest = differ[stops] & (~differ[stops] + np.uint64(1))
            out[active[stops]] = done + np.bitwise_count(lowest - np.uint64(1)) // 8
            active = active[~stops]
        out[active] = most
    else:
        padded = np.concatenate([text.astype(np.int64), np.full(most, -1)])
        for done in range(most):
            active = active[padded[active + done] == padded[before[active] + done]]
            out[active] = done + 1
    limit = n - np.maximum(np.arange(n), before)
    return np.minimum(np.minimum(out, most), np.where(before >= 0, limit, 0))
