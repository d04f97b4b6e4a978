"""Language identification, word first with a backoff to character n-grams.

A known word adds its smoothed log frequency in each language. A word no
language knows falls back to its character n-grams, from the longest to ever
shorter ones: the first length of which any n-gram is known scores the word,
by the mean over its known n-grams; a word without any adds nothing. Letters
are those of Unicode's category L, with the marks that follow them.

Counting runs in Spark. The only bounds are on the sample of labelled rows that
is learned from: about ``SAMPLE_ROWS`` rows and ``SAMPLE_CHARS`` characters, an
equal part of both for each language, so that a rare language is learned whole
beside a hot one. All words and n-grams of the sample are kept, at most
``LONGEST + 1`` entries for each of its characters, each with its languages
alone; a language costs no room where it has no count.

Edge cases: null texts and texts without letters are ``und`` with score 0, and
so is everything if no labelled text can be learned from; an empty table gives
no rows; ties go to the language first in code-point order; each input row
gives one result row, also where rows repeat; very long texts are scored whole,
at about 100 bytes for each of their words; columns of docs named lang_pred or
score are replaced, all others stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.tables import remainder, stored

SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 8_000_000
LONGEST = 5
FLUSH = 200_000
#: Words of a batch that are scored at once, and cells of texts times languages.
WORDS_AT_ONCE = 1 << 18
CELLS = 1 << 21
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _gram_counts(words: Counter, level: int) -> Counter:
    """Counts of the n-grams of that length in words, each word as often as it occurs."""
    counts: Counter = Counter()
    padded = [(f"<{w}>", n) for w, n in words.items()]
    counts.update([w[i : i + level] for w, n in padded if n == 1 for i in range(len(w) - level + 1)])
    for w, n in padded:
        if n > 1:
            for i in range(len(w) - level + 1):
                counts[w[i : i + level]] += n
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, level, gram, n): level 0 for words, n for n-grams; summed within a task as far as memory bounds allow."""

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in words.items():
            for level in range(LONGEST + 1):
                counts = _gram_counts(own, level) if level else own
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array([level] * len(counts), pa.int32()), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["lang", "level", "gram", "n"])
        words.clear()

    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, words.values())) > FLUSH:
            yield from flush()
    yield from flush()


def _expanded(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of n steps each, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@dataclass
class Model:
    """words, grams: the number of each entry. Entry i has the languages lang[first[i] : first[i + 1]], and gain there: how much
    more its log frequency is than that of an entry without a count, which base has by level and language."""

    langs: list[str]
    prior: np.ndarray
    base: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    first: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    unseen: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"unseen": {}}

    def unseen_word(self, word: str) -> tuple[int, np.ndarray]:
        found = self.unseen.get(word)
        if found is None:
            if len(self.unseen) > 100_000:
                self.unseen.clear()
            found = self.unseen[word] = self.back_off(word)
        return found

    def back_off(self, word: str) -> tuple[int, np.ndarray]:
        """The level that scores a word, and its known n-grams there; level 0 if there are none."""
        for level in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [number for gram in grams_of(word, level) if (number := self.grams.get(gram)) is not None]
            if found:
                return level, np.array(found)
        return 0, np.empty(0, np.int64)

    def totals(self, words: list[str], text: np.ndarray, texts: int) -> np.ndarray:
        """Log probabilities by text and language; text: that of each word."""
        number = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(number >= 0)
        of, entry, weight = [text[known]], [number[known]], [np.ones(len(known))]
        levels = np.zeros((texts, LONGEST + 1))
        levels[:, 0] = np.bincount(text[known], minlength=texts)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            places: dict[str, int] = {}
            which = np.array([places.setdefault(words[i], len(places)) for i in missing.tolist()])
            found = [self.unseen_word(w) for w in places]
            level, grams = np.array([x[0] for x in found]), np.concatenate([x[1] for x in found])
            n = np.array([len(x[1]) for x in found])
            begin = np.cumsum(n) - n
            np.add.at(levels, (text[missing], level[which]), level[which] > 0)
            of.append(np.repeat(text[missing], n[which]))
            entry.append(grams[_expanded(begin[which], n[which])])
            weight.append(np.repeat(1 / np.maximum(1, n[which]), n[which]))
        of, entry, weight = (np.concatenate(x) for x in (of, entry, weight))
        n = self.first[entry + 1] - self.first[entry]
        place = _expanded(self.first[entry], n)
        cell = np.repeat(of, n) * len(self.langs) + self.lang[place]
        gains = np.bincount(cell, np.repeat(weight, n) * self.gain[place], texts * len(self.langs)).reshape(texts, -1)
        return self.prior + levels @ self.base + gains

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) if t else [] for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, w in enumerate(words) if w] if self.langs else []
        most = max(1, CELLS // max(1, len(self.langs)))
        while some:
            size, n = 0, 0
            while n < len(some) and n < most and (not n or size < WORDS_AT_ONCE):
                size += len(words[some[n]])
                n += 1
            own, some = some[:n], some[n:]
            total = self.totals([w for i in own for w in words[i]], np.repeat(np.arange(n), [len(words[i]) for i in own]), n)
            odds = np.exp(total - total.max(1, keepdims=True))
            best = odds.argmax(1)
            share = odds[np.arange(n), best] / odds.sum(1)
            for i, k, p in zip(own, best.tolist(), share.tolist(), strict=True):
                names[i], scores[i] = self.langs[k], p
        return names, scores


def sample_of(labelled: DataFrame, key: Column, rows: int, chars: int) -> tuple[DataFrame, DataFrame]:
    """About rows of labelled with about so many characters, drawn by a hash of key, an equal part for each language; and rows (lang, n) of all."""
    sizes = stored(labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")))
    langs = max(1, sizes.count())
    share = F.least(F.lit(1.0), F.lit(rows / langs) / F.col("n"), F.lit(chars / langs) / F.greatest("chars", F.lit(1)))
    parts = sizes.select("lang", (share * (1 << 30)).cast("long").alias("_share"))
    drawn = labelled.withColumn("_draw", F.pmod(F.xxhash64(key), F.lit(1 << 30))).join(parts, "lang").filter(F.col("_draw") < F.col("_share"))
    return drawn.select("text", "lang"), sizes.select("lang", "n")


def fit(labelled: DataFrame, key: Column | None = None, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of the columns text and lang of labelled; key tells rows apart that may repeat a text."""
    labelled = labelled.dropna(subset=["text", "lang"])
    sample, sizes = sample_of(labelled, F.col("text") if key is None else key, rows, chars)
    counts = sample.mapInArrow(_counted, "lang string, level int, gram string, n long").groupBy("lang", "level", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # bounded with the sample
    langs = sorted(set(table.column("lang").to_pylist()))
    levels, n = table.column("level").to_numpy(), table.column("n").to_numpy().astype(np.float64)
    number_of = {name: i for i, name in enumerate(langs)}
    lang = np.array([number_of[x] for x in table.column("lang").to_pylist()], np.int64)
    rows_by_lang = {r.lang: r.n for r in sizes.filter(F.col("lang").isin(langs)).collect()} if langs else {}  # at most as many as the sample has rows
    words: dict[str, int] = {}
    grams: dict[str, int] = {}
    entry = np.empty(len(n), np.int64)
    for i, (level, gram) in enumerate(zip(levels.tolist(), table.column("gram").to_pylist(), strict=True)):
        own = grams if level else words
        entry[i] = own.setdefault(gram, len(words) + len(grams))
    level_of = np.zeros(len(words) + len(grams), np.int64)
    level_of[entry] = levels
    sums = np.bincount(levels * max(1, len(langs)) + lang, n, (LONGEST + 1) * max(1, len(langs))).reshape(LONGEST + 1, -1)
    base = np.log(0.5 / (sums + 0.5 * np.maximum(1, np.bincount(level_of, minlength=LONGEST + 1))[:, None]))
    order = np.lexsort((lang, entry))
    first = np.searchsorted(entry[order], np.arange(len(level_of) + 1))
    prior = np.array([rows_by_lang[x] for x in langs], np.float64)
    return Model(langs, np.log(prior / max(1.0, prior.sum())), base, words, grams, first, lang[order], np.log((n[order] + 0.5) / 0.5))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs that aren't named so, with lang_pred and score; only text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(returnType="struct<lang_pred string, score double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    found = predict(F.col("text"))
    return docs.withColumn("_found", found).withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that aren't held out."""
    docs = docs.select("doc_id", "text", "lang", (remainder("doc_id", 5) == 0).alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")), F.concat_ws(" ", F.col("doc_id").cast("string"), "text"))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
