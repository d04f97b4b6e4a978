"""Scoring texts with a weighted backoff automaton.

Words, pairs and triples of all training texts are counted, each of them
whatever its count: documents lie in blobs, each blob sends the distinct
n-grams of its texts to buckets of n-grams, where they are counted over the
corpus, and gets the counts of its own ones back (packs.counted). What is
gathered thus grows with the corpus, and no task or broadcast holds it whole.

A blob's texts are scored by the part of the automaton that they can reach.
N-grams with a count, smoothed by a Dirichlet prior from the next shorter
n-gram, are states with arcs for the words that follow; every state has a
failure arc to its longest proper suffix that carries the backoff weight. One
traversal from left to right carries the state and adds up log10
probabilities. Texts are traversed side by side, long ones in stretches: a
state depends on two words at most, so that a stretch starts two words early
from the root and then is in the state of the whole text's traversal.

Probabilities: of a word alone (c + 1) / (N + V + 1), where all words without a
count share one more; after a context h of one or two tokens
(c(hw) + m p(w | shorter h)) / (c(h) + m), with m of ``PRIOR``. Over all
continuations of any context they sum to one, and so over all texts.

Words are equal when 63 bits of their hashes are. Pairs and triples have as many
bits as tell all but one of some ten thousand apart, more in a larger corpus
(key_bits): what costs disk is their keys. Memory is about 150 bytes
for each byte of a blob, or of the longest text.

Edge cases: a null text is empty and scores its end alone; with no training
text every probability is that of an unseen word, 1; an empty table gives no
rows; each input row gives one result row, also where ids repeat; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import packs
from strandline.llm.tables import remainder
from strandline.llm.tokens import ASCII_LOWER, mix, range_hashes, text_buffer, window_hashes, word_ranges

#: How many observations the shorter context counts for, for contexts of one and of two tokens.
PRIOR = (4.0, 2.0)
#: The end token's hash; words are never empty, so that none has it.
END = np.uint64(0x27D4EB2F165667C5)
#: Words of a stretch that is traversed by itself.
STRETCH = 256
WORD, PAIR, TRIPLE = 1, 2, 3  # tokens of an n-gram


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end before and behind each, and where each text begins (and the last ends)."""
    data, offsets = text_buffer(texts)
    data = ASCII_LOWER[data]
    starts, ends, first = word_ranges(data, offsets)
    own = np.repeat(np.arange(len(texts)), np.diff(first))
    out = np.full(len(starts) + 2 * len(texts), END)
    out[np.arange(len(starts)) + 2 * own + 1] = range_hashes(data, starts, ends)
    return out, first + 2 * np.arange(len(first))


def key_bits(size: int) -> int:
    """Bits of the keys of pairs and triples in a corpus of so many bytes: of those without a count one in 2**15 seems to have one."""
    return min(63, max(44, int(size).bit_length() + 14))


def ngram_keys(tokens: np.ndarray, first: np.ndarray, bits: int = 63) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of the words, pairs and triples that end at each position, and which positions have one within their text.

    Keys of words are even; those of pairs and triples are odd and differ in the highest bits alone.
    """
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    keys, valid = [], []
    for n in (WORD, PAIR, TRIPLE):
        key = np.zeros(len(tokens), np.uint64)
        key[n - 1 :] = mix(tokens) if n == WORD else window_hashes(tokens, n)
        low = np.uint64(1 if n == WORD else 64 - bits)
        keys.append((key >> low << low) | np.uint64(n != WORD))
        valid.append(place >= max(1, n - 1))
    return keys, valid


@dataclass
class Automaton:
    """State 0 is the root, which has an arc for each word: its log10 probability and next state are in root and root_next.

    Arcs of other states: (state << 32 | word), sorted, with their log10 probabilities and next states. failure and
    backoff (log10) are by state.
    """

    root: np.ndarray
    root_next: np.ndarray
    arcs: np.ndarray
    weight: np.ndarray
    next: np.ndarray
    failure: np.ndarray
    backoff: np.ndarray

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probabilities of the words from the states, and the states that follow."""
        total, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        now = state
        while len(todo):
            at_root = now == 0
            done = todo[at_root]
            total[done] += self.root[word[done]]
            after[done] = self.root_next[word[done]]
            todo, now = todo[~at_root], now[~at_root]
            if not len(todo):
                break
            key = now << 32 | word[todo]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1) if len(self.arcs) else np.zeros(len(key), np.int64)
            found = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), bool)
            done = todo[found]
            total[done] += self.weight[at[found]]
            after[done] = self.next[at[found]]
            todo, now = todo[~found], now[~found]
            total[todo] += self.backoff[now]
            now = self.failure[now]
        return total, after

    def score(self, words: np.ndarray, first: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Log10 probability of each text; words: numbers of the tokens as sequences() gives them."""
        length = np.diff(first) - 1  # tokens to be scored, behind the first end
        lanes = -(-length // stretch)
        text = np.repeat(np.arange(len(length)), lanes)
        begin = first[:-1][text] + 1 + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * stretch
        end = np.minimum(begin + stretch, first[1:][text])
        order = np.argsort(begin - end, kind="stable")  # the longest first
        text, begin, end = text[order], begin[order], end[order]
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        for k in range(-2, stretch):
            n = int(np.searchsorted(begin - end, -k, "left")) if k >= 0 else len(text)
            own = np.arange(n) if k != -2 else np.flatnonzero(begin - 2 >= first[:-1][text])
            if not len(own):
                continue
            more, state[own] = self.step(state[own], words[begin[own] + k])
            if k >= 0:
                total[own] += more
        return np.bincount(text, total, len(length))


def automaton(keys: list[np.ndarray], valid: list[np.ndarray], names: np.ndarray, counts: np.ndarray, train_tokens: int, distinct: int) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """The automaton of the n-grams of a blob; the number of the word at each position; the count of each word number."""
    number = np.searchsorted(names, np.concatenate(keys)).reshape(3, -1)
    number[:, ~valid[0]] = np.searchsorted(names, mix(END[None]) & ~np.uint64(1))  # the end in front is the end
    is_word = (names & np.uint64(1)) == 0
    word = (np.cumsum(is_word) - 1)[number[0]]
    word_counts = counts[is_word].astype(np.float64)
    p1 = (word_counts + 1.0) / (train_tokens + distinct + 1.0)
    where = []  # one position of each pair and triple that has a count
    for n in (PAIR, TRIPLE):
        at = np.flatnonzero(valid[n - 1])
        which, seen = np.unique(number[n - 1][at], return_index=True)
        where.append(at[seen[counts[which] > 0]])
    m1, m2 = PRIOR
    at2, at3 = where
    state_of_word = np.where(word_counts > 0, np.cumsum(word_counts > 0), 0)
    known = int((word_counts > 0).sum())
    pair_state = np.zeros(len(names), np.int64)
    pair_state[number[1][at2]] = known + 1 + np.arange(len(at2))

    def after_word(at: np.ndarray) -> np.ndarray:
        before = word_counts[word[at - 1]]
        return (counts[number[1][at]] + m1 * p1[word[at]]) / (before + m1)

    p2 = after_word(at2)
    p3 = (counts[number[2][at3]] + m2 * after_word(at3)) / (counts[number[1][at3 - 1]] + m2)
    arcs = np.concatenate([state_of_word[word[at2 - 1]] << 32 | word[at2], pair_state[number[1][at3 - 1]] << 32 | word[at3]])
    weight, target = np.log10(np.concatenate([p2, p3])), np.concatenate([pair_state[number[1][at2]], pair_state[number[1][at3]]])
    order = np.argsort(arcs)
    failure = np.concatenate([np.zeros(known + 1, np.int64), state_of_word[word[at2]]])
    backoff = np.log10(np.concatenate([[1.0], m1 / (word_counts[word_counts > 0] + m1), m2 / (counts[number[1][at2]] + m2)]))
    return Automaton(np.log10(p1), state_of_word, arcs[order], weight[order], target[order], failure, backoff), word, word_counts


def scored(docs: DataFrame, learns: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs, by a model of the rows where learns holds.

    To score other texts than those learned from, put both in one table.
    """
    blobs, size = packs.packed(docs.withColumn("_learns", F.coalesce(learns, F.lit(False))), ("_learns",))
    bits = key_bits(size)

    def keys_of(i: int, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        tokens, first = sequences(batch.column("texts")[i].values)
        keys, valid = ngram_keys(tokens, first, bits)
        learned = np.repeat(batch.column("_learns")[i].values.to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
        every, counts = np.concatenate([k[v] for k, v in zip(keys, valid, strict=True)]), np.concatenate([learned[v] for v in valid])
        names, number = np.unique(every, return_inverse=True)
        return names, np.bincount(number, counts, len(names)).astype(np.int64)

    answered, sums, read = packs.counted(blobs, size, keys_of, 0.3, bits)
    words = sums.filter("odd = 0").first()
    train_tokens, distinct = (words.total, words.distinct) if words else (0, 0)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, texts, i in packs.opened(batch):
                tokens, first = sequences(texts)
                keys, valid = ngram_keys(tokens, first, bits)
                names = np.unique(np.concatenate([k[v] for k, v in zip(keys, valid, strict=True)]))
                model, word, counts = automaton(keys, valid, names, read(batch, i, names), train_tokens, distinct)
                own = np.repeat(np.arange(len(texts)), np.diff(first))
                scores = [np.bincount(own, w * valid[0], len(texts)) for w in (np.ones(len(word)), counts[word] > 0, model.root[word])]
                columns = {"n_tokens": scores[0].astype(np.int64), "n_known": scores[1].astype(np.int64), "train_tokens": np.full(len(texts), train_tokens), "base_score": scores[2], "score": model.score(word, first)}
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns.values())], ["doc_id", *columns])

    return answered.mapInArrow(traverse, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the columns of scored(), learned from the rows that aren't held out."""
    held_out = remainder("doc_id", 7) == 2
    found = scored(docs.select("doc_id", "text"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
