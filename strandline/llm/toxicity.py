"""A convolutional toxicity classifier trained in numpy.

Words, A-Z in lower case, and their first bytes are hashed to ``BUCKETS``
embeddings that add up. Filters of
several widths slide over the whole text, each keeps its largest response, and
a linear layer makes a logit of them. The language of a text, guessed from the
same hashed words, picks the threshold that was calibrated for it; the score is
the logistic function of the distance to it, so that 0.7 lies at the threshold.

Fitting takes every labelled text: three quarters train, a quarter, by a hash,
calibrates. Texts are dealt out by a hash over shards of about ``SHARD``
characters; in each of ``ROUNDS`` rounds every shard goes on from the same
numbers for some passes over its texts, and a number's mean over the shards that
changed it is where the next round starts. Counts of words by label and by
language are sums over all shards, and thresholds are chosen by the counts of
all calibrating texts in steps of a thousandth of a logit. The driver holds the
numbers of the model alone. Of languages the ``LANGUAGES`` most frequent ones of
the labelled texts are told apart, the others share a threshold. Scoring reads
whole texts.

Edge cases: null and empty texts score as a text without words; without
labels of both classes every score is the share of label 1 (0 without labels)
scaled below 0.7; label rows that repeat count once, and so do rows that repeat
id, text and label, while ids with both labels count for both; an empty table
gives no rows; each input row gives one result row; columns other than text are
never inputs, and one named like the result is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tables import remainder, stored
from strandline.llm.tokens import ASCII_LOWER, range_hashes, split, text_buffer, word_ranges

BUCKETS = 1 << 17
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
SHARD = 4_000_000
LANGUAGES = 16
EPOCHS = 10
ROUNDS = 5
BATCH = 32
#: Bytes of a word that its stem has.
STEM = 4
THRESHOLD = 0.7
SLOPE = 2.0
#: Calibrating a language apart needs so many texts of each label.
LEAST = 15

SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = True
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
PAD = max(WIDTHS) - 1


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word of all texts the buckets of the word and of its stem, PAD + 1 zeros after each text, and where each text begins; bucket 0 is no word."""
    data, offsets = text_buffer(texts)
    data = ASCII_LOWER[data]
    starts, ends, first = word_ranges(data, offsets, SEPARATOR)
    hashed = np.stack([range_hashes(data, starts, ends), range_hashes(data, starts, np.minimum(ends, starts + STEM)) ^ np.uint64(STEM)])
    hashed = (hashed % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    n = np.diff(first)
    begin = first[:-1] + np.arange(len(n)) * (PAD + 1)
    out = np.zeros((2, len(starts) + len(n) * (PAD + 1)), np.int32)
    out[:, np.arange(len(starts)) + np.repeat(np.arange(len(n)), n) * (PAD + 1)] = hashed
    return out, begin


@dataclass
class Classifier:
    """responses: for each width and offset in the filter the response of each bucket; thresholds by language."""

    responses: list[list[np.ndarray]]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: np.ndarray
    thresholds: np.ndarray

    def logits(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        pooled = []
        beyond = (np.append(begin[1:], ids.shape[1])[:, None] - np.arange(1, PAD + 1)).ravel()  # filters that begin there reach into the next text
        for responses, bias in zip(self.responses, self.bias, strict=True):
            total = responses[0][ids[0]] + responses[0][ids[1]]
            for j, more in enumerate(responses[1:], 1):
                total[:-j] += more[ids[0, j:]]
                total[:-j] += more[ids[1, j:]]
            total[beyond] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(total, begin, axis=0) + bias, 0))
        return np.concatenate(pooled, 1) @ self.out + self.out_bias

    def language(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.languages[ids[0]], begin, axis=0).argmax(1)

    def outputs(self, ids: np.ndarray, begin: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits and languages of some of the texts."""
        own = ids[:, begin[first] : begin[end] if end < len(begin) else None]
        return self.logits(own, begin[first:end] - begin[first]), self.language(own, begin[first:end] - begin[first])

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        if not len(self.thresholds):
            return np.full(len(texts), self.out_bias)
        ids, begin = word_buckets(texts)
        far = self.logits(ids, begin) - self.thresholds[self.language(ids, begin)]
        return 1 / (1 + np.exp(-np.clip(SLOPE * far + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)))


def _seen_in(ids: np.ndarray, begin: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(label, bucket): in how many of the texts of a label each bucket occurs."""
    end = np.append(begin[1:], ids.shape[1])
    seen = np.zeros((2, BUCKETS))
    for i in rows:
        seen[int(toxic[i]), np.unique(ids[:, begin[i] : end[i]])] += 1
    return seen


def _log_odds(seen: np.ndarray, rate: float, prior: float = 3.0) -> np.ndarray:
    """How much more often each bucket occurs in toxic texts than by the base rate, shrunk to 0 where it is rare: the first embedding dimension starts from it."""
    return np.log((seen[1] + prior * rate) / (seen[0] + prior * (1 - rate))) - np.log(rate / (1 - rate))


def _named(numbers: np.ndarray) -> dict:
    """Views of the embeddings E, the filters and biases by width, and the output layer v, c, in rows of DIMENSIONS numbers."""
    shapes = {"v": (len(WIDTHS) * FILTERS,), "c": (1,)}
    for w in WIDTHS:
        shapes |= {f"W{w}": (w, DIMENSIONS, FILTERS), f"b{w}": (FILTERS,)}
    p, rest, at = {"E": numbers[:BUCKETS]}, numbers[BUCKETS:].reshape(-1), 0
    for name, shape in shapes.items():
        p[name] = rest[at : at + np.prod(shape)].reshape(shape)
        at += int(np.prod(shape))
    return p


def _start(seen: np.ndarray, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that training starts from, and AdaGrad's sums of squares."""
    small = len(WIDTHS) * FILTERS + 1 + sum(w * DIMENSIONS * FILTERS + FILTERS for w in WIDTHS)
    numbers = np.zeros((BUCKETS - (-small // DIMENSIONS), DIMENSIONS), np.float32)
    p = _named(numbers)
    p["E"][:] = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS))
    p["v"][:] = rng.normal(0, 0.3, len(WIDTHS) * FILTERS)
    p["E"][:, 0] = 0.5 * _log_odds(seen, rate)
    p["E"][0] = 0
    for w in WIDTHS:
        p[f"W{w}"][:] = rng.normal(0, 0.5, (w, DIMENSIONS, FILTERS))
        p[f"b{w}"][:] = 0.01
    return numbers, np.full_like(numbers, 0.1)


def _pass(numbers: np.ndarray, squares: np.ndarray, ids: np.ndarray, begin: np.ndarray, toxic: np.ndarray, order: np.ndarray) -> None:
    """A pass of AdaGrad over texts in that order, in place; only the pooled positions get gradients."""
    p, seen = _named(numbers), _named(squares)
    end = np.append(begin[1:], ids.shape[1])

    def step(name: str, gradient: np.ndarray, rate: float = 0.1) -> None:
        seen[name] += gradient**2
        p[name] -= rate * gradient / np.sqrt(seen[name])

    for k in range(0, len(order), BATCH):
        own = order[k : k + BATCH]
        at = np.concatenate([np.arange(begin[i], end[i]) for i in own])
        words, size = ids[:, at], end[own] - begin[own]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        x = p["E"][words[0]] + p["E"][words[1]]
        pooled, places = [], []
        for w in WIDTHS:
            h = x @ p[f"W{w}"][0]
            for j in range(1, w):
                h[:-j] += x[j:] @ p[f"W{w}"][j]
            place = np.stack([a + h[a : a + n - PAD].argmax(0) for a, n in zip(first, size, strict=True)])
            pooled.append(np.maximum(np.take_along_axis(h, place, 0) + p[f"b{w}"], 0))
            places.append(place)
        features = np.concatenate(pooled, 1)
        g = (1 / (1 + np.exp(-(features @ p["v"] + p["c"]))) - toxic[own]).astype(np.float32) / len(own)
        back = np.outer(g, p["v"]) * (features > 0)
        step("v", features.T @ g + 1e-4 * p["v"])
        step("c", np.array([g.sum()]))
        rows_of, moves = [], []
        for w, place, d in zip(WIDTHS, places, np.split(back, len(WIDTHS), 1), strict=True):
            filters = np.empty_like(p[f"W{w}"])
            for j in range(w):
                filters[j] = np.einsum("df,dfk->kf", d, x[place + j])
                rows_of += [part[place + j].ravel() for part in words]
                moves += [(d[:, :, None] * p[f"W{w}"][j].T).reshape(-1, DIMENSIONS)] * 2
            step(f"W{w}", filters + 1e-4 * p[f"W{w}"])
            step(f"b{w}", d.sum(0))
        touched, where = np.unique(np.concatenate(rows_of), return_inverse=True)
        gradient = np.zeros((len(touched), DIMENSIONS), np.float32)
        np.add.at(gradient, where, np.concatenate(moves))
        gradient[touched == 0] = 0
        seen["E"][touched] += gradient**2
        p["E"][touched] -= 0.1 * gradient / np.sqrt(seen["E"][touched])


def _best_threshold(logits: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the widest gap between logits among those cuts that give the best F1; so many texts of each label have a logit."""
    order = np.argsort(logits)
    z, y, other = logits[order], toxic[order], clean[order]
    caught = y.sum() - np.concatenate([[0], np.cumsum(y)])[:-1]
    f1 = 2 * caught / (caught + y.sum() + other.sum() - np.concatenate([[0], np.cumsum(other)])[:-1])
    gap = np.diff(z, prepend=z[0] - 2.0)
    best = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda i: gap[i])
    return float(z[best] - min(gap[best], 8.0) / 2)


def _calibrated(model: Classifier, guess: np.ndarray, logits: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> Classifier:
    """The model with a threshold for each language that has enough texts of both labels, and a common one for the others."""
    common = _best_threshold(logits, toxic, clean) if toxic.any() else 0.0
    for k in range(len(model.thresholds)):
        own = guess == k
        enough = min(toxic[own].sum(), clean[own].sum()) >= LEAST
        model.thresholds[k] = _best_threshold(logits[own], toxic[own], clean[own]) if enough else common
    return model


def _model(numbers: np.ndarray, counts: np.ndarray) -> Classifier:
    """A classifier without thresholds, from trained numbers and the words of each bucket by language."""
    p = _named(numbers)
    counts[0] = 0
    languages = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * BUCKETS)).astype(np.float32)
    languages[0] = 0
    responses = [[np.ascontiguousarray(p["E"] @ p[f"W{w}"][j]) for j in range(w)] for w in WIDTHS]
    return Classifier(responses, [p[f"b{w}"] for w in WIDTHS], p["v"], float(p["c"][0]), languages, np.zeros(counts.shape[1]))


def _constant(toxic: int, rows: int) -> Classifier:
    return Classifier([], [], np.empty(0), toxic / rows * THRESHOLD * 0.99 if rows else 0.0, np.empty(0), np.empty(0))


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As word_buckets, some texts at a time."""
    parts = [word_buckets(texts.slice(k, 500)) for k in range(0, len(texts), 500)]
    sizes = np.cumsum([0, *(ids.shape[1] for ids, _ in parts)])
    return np.concatenate([ids for ids, _ in parts], 1), np.concatenate([b + n for (_, b), n in zip(parts, sizes, strict=False)])


def _told(model: Classifier, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits and languages of texts."""
    logits, guess = (np.concatenate(x) for x in zip(*(model.outputs(ids, begin, k, k + BATCH) for k in range(0, len(begin), BATCH)), strict=True))
    return logits, guess


def _frequent(counts: dict[str, int]) -> list[str]:
    return sorted(x for x, _ in Counter(dict(sorted(counts.items()))).most_common(LANGUAGES))


def train(texts: list[str], toxic: np.ndarray, langs: list[str | None], seed: int = 7) -> Classifier:
    """A classifier of labelled texts at hand, as fit() makes it of one shard; a quarter of them only calibrates. langs are used for thresholds alone."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = len(order) // 4
    if not len(texts) or toxic[order[cut:]].min() == toxic[order[cut:]].max():
        return _constant(int(toxic.sum()), len(texts))
    ids, begin = _hashed(pa.array(texts, pa.string()))
    numbers, squares = _start(_seen_in(ids, begin, toxic, order[cut:]), toxic[order[cut:]].mean(), rng)
    for _ in range(EPOCHS):
        _pass(numbers, squares, ids, begin, toxic.astype(np.float32), rng.permutation(order[cut:]))
    frequent = _frequent(Counter(x for x in langs if x is not None))
    number = np.array([frequent.index(x) if x in frequent else len(frequent) for x in langs])
    counts = np.zeros((BUCKETS, len(frequent) + 1))
    np.add.at(counts, (ids[0], np.repeat(number, np.diff(np.append(begin, ids.shape[1])))), 1)
    model = _model(numbers, counts)
    logits, guess = _told(model, ids, begin)
    held = order[:cut]
    return _calibrated(model, guess[held], logits[held], toxic[held], 1 - toxic[held])


def _counted(table: pa.Table) -> pa.Table:
    """bucket, of, n: in how many training texts of label 0 or 1 a bucket occurs, and its words in the texts of language of - 2."""
    ids, begin = _hashed(table.column("text").combine_chunks())
    toxic, number = (table.column(c).to_numpy() for c in ("toxic", "number"))
    seen = _seen_in(ids, begin, toxic, np.flatnonzero(table.column("trains").to_numpy(zero_copy_only=False)))
    key = np.repeat(number.astype(np.int64) + 2, np.diff(np.append(begin, ids.shape[1]))) * BUCKETS + ids[0]
    words, n = np.unique(key, return_counts=True)
    texts = np.flatnonzero(seen.ravel())
    key = np.concatenate([texts, words])
    return pa.table({"bucket": pa.array(key % BUCKETS, pa.int64()), "of": pa.array(key // BUCKETS, pa.int64()), "n": pa.array(np.concatenate([seen.ravel()[texts], n]).astype(np.int64))})


def _round(texts: DataFrame, numbers: np.ndarray, squares: np.ndarray, seed: int) -> None:
    """Some passes of every shard from the same numbers; then, in place, each row's mean over the shards that changed it."""
    shared = texts.sparkSession.sparkContext.broadcast((numbers, squares))
    names = [f"{kind}{k}" for kind in "ps" for k in range(DIMENSIONS)]

    def run(table: pa.Table) -> pa.Table:
        own, sums = (x.copy() for x in shared.value)
        table = table.sort_by([("text", "ascending"), ("toxic", "ascending")])
        ids, begin = _hashed(table.column("text").combine_chunks())
        toxic = table.column("toxic").to_numpy().astype(np.float32)
        rng = np.random.default_rng([seed, int(table.column("shard")[0].as_py())])
        for _ in range(EPOCHS // ROUNDS):
            _pass(own, sums, ids, begin, toxic, rng.permutation(len(toxic)))
        moved = np.flatnonzero((sums != shared.value[1]).any(1))
        return pa.table([pa.array(moved, pa.int64()), *(pa.array(x, pa.float32()) for x in (*own[moved].T, *sums[moved].T))], names=["row", *names])

    moved = texts.groupBy("shard").applyInArrow(run, "row long, " + ", ".join(f"{n} float" for n in names))
    mean = moved.groupBy("row").agg(*(F.avg(n).alias(n) for n in names)).toArrow()
    rows = mean.column("row").to_numpy()
    for x, kind in ((numbers, "p"), (squares, "s")):
        x[rows] = np.stack([mean.column(f"{kind}{k}").to_numpy() for k in range(DIMENSIONS)], 1)
    shared.destroy()


def fit(docs: DataFrame, labels: DataFrame, shard: int = SHARD, seed: int = 7) -> Classifier:
    """A classifier from all labels (doc_id, toxic) and the texts of docs (doc_id, text, lang); shards hold about so many characters."""
    labels = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    found = texts.join(labels.withColumn("toxic", F.col("toxic").cast("int")), "doc_id").dropDuplicates(["doc_id", "text", "toxic"])
    found = stored(found.withColumn("hash", F.xxhash64("doc_id", "text")).withColumn("trains", F.pmod("hash", F.lit(4)) > 0))
    sizes = {(r.toxic, r.trains): r for r in found.groupBy("toxic", "trains").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).collect()}  # four rows
    n = {key: r.n for key, r in sizes.items()}
    clean, bad = n.get((0, True), 0), n.get((1, True), 0)
    if not clean or not bad:
        return _constant(n.get((1, False), 0) + bad, sum(n.values()))
    by_lang = found.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    frequent = _frequent({r.lang: r.n for r in by_lang})
    number = F.lit(len(frequent))
    for k, lang in enumerate(frequent):
        number = F.when(F.col("lang") == lang, k).otherwise(number)
    shards = -(-sum(r.chars or 0 for r in sizes.values()) // shard) or 1
    dealt = found.select("text", "toxic", "trains", number.cast("int").alias("number"), F.pmod(F.shiftright("hash", 2), F.lit(shards)).alias("shard"))
    counts = np.zeros((len(frequent) + 3, BUCKETS))
    counted = dealt.groupBy("shard").applyInArrow(_counted, "bucket long, of long, n long").groupBy("bucket", "of").agg(F.sum("n").alias("n")).toArrow()
    counts[counted.column("of").to_numpy(), counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    numbers, squares = _start(counts[:2], bad / (clean + bad), np.random.default_rng(seed))
    learned = dealt.filter("trains").select("text", "toxic", "shard")
    for turn in range(ROUNDS):
        _round(learned, numbers, squares, seed + turn)
    model = _model(numbers, counts[2:].T.copy())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split(batch, "text", 1 << 20):
                if part.num_rows:
                    logits, guess = _told(shared.value, *_hashed(part.column("text")))
                    yield pa.RecordBatch.from_arrays([pa.array(guess, pa.int64()), pa.array(logits, pa.float64()), part.column("toxic")], ["guess", "logit", "toxic"])

    logits = dealt.filter("NOT trains").select("text", "toxic").mapInArrow(held, "guess long, logit double, toxic int")
    near = F.floor(F.least(F.greatest("logit", F.lit(-100.0)), F.lit(100.0)) * 1000)
    table = logits.groupBy("guess", near.alias("near")).agg(F.min("logit").alias("logit"), F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).toArrow()
    guess, logit, toxic, clean = (table.column(c).to_numpy() for c in ("guess", "logit", "toxic", "clean"))
    return _calibrated(model, guess, logit, toxic, clean)


def scored(docs: DataFrame, model: Classifier, to: str = "score") -> DataFrame:
    """docs with the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(returnType="double")
    def score(texts: pa.Array) -> pa.Array:
        parts = split(pa.RecordBatch.from_arrays([texts], ["text"]), "text", 1 << 20)
        return pa.array(np.concatenate([np.empty(0), *(shared.value.score(part.column(0)) for part in parts)]), pa.float64())

    return docs.withColumn(to, score(F.col("text")))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels of rows that aren't held out."""
    model = fit(docs, labels.filter(remainder("doc_id", 3) != 1))
    out = scored(docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
