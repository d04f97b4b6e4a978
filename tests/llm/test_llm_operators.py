"""The training-data operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import decontamination, fm_index, jaccard, language, mixing, ngram_lm, packs, pii, queries, repeats, substrings, suffixes, tokens, topk, toxicity
from strandline.llm.components import components
from strandline.llm.tables import remainder

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, spans string, hash long"


def documents(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, None if k % 5 == 0 else "ab"[k % 2], None if k % 7 == 0 else f"s{k % 3}", None, 0.5, 1, "x", 7) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward():
    """Copies, near copies, shared passages, runs of one letter, a long text, nulls and repeated rows."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(6000)]
    passage = " ".join(words[:60])
    texts = [" ".join(words[k * 50 : k * 50 + 50 + k]) for k in range(30)]
    texts += [texts[3], texts[3], passage + " x " + texts[5], texts[7][:-3] + "q", "y " + passage, "é" * 90 + texts[2], "a" * 130, "a" * 200, "", "  \t ", "one", "One", "one two three", None, " ".join(words)]
    docs = [(i, t) for i, t in enumerate(texts)]
    return docs + [docs[4], (None, texts[3]), (None, None), (5, "other text under a used id " + texts[9])]


def test_repeated_bytes(spark):
    docs = awkward()
    found = Counter(tuple(r) for r in substrings.removed(documents(spark, docs)).drop("kept").collect())
    last, seen, expected = 1 << 62, defaultdict(lambda: 1 << 63), Counter()
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for k in range(len(b) - 49):
            seen[b[k : k + 50]] = min(seen[b[k : k + 50]], last if i is None else i)
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < (last if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        expected[i, len(b), sum(gone), spans, sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()] += 1
    assert found == expected


def test_repeated_words(spark):
    docs = awkward()
    found = Counter(tuple(r) for r in fm_index.removed(documents(spark, docs)).drop("kept").collect())
    data = [(i, (t or "").encode().split()) for i, t in docs]
    counts = Counter(tuple(w[k : k + 35]) for _, w in data for k in range(len(w) - 34))
    expected = Counter()
    for i, w in data:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        expected[i, len(w), sum(gone), sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    assert found == expected


@pytest.mark.parametrize("symbols", [1, 2, 5, 250, 9000])
def test_suffix_arrays(symbols):
    rng = np.random.default_rng(symbols)
    for n in (0, 1, 2, 3, 10, 200, 700):
        text = rng.integers(0, symbols, n)
        if n > 50:
            text[20:40] = text[-20:]
        order = suffixes.suffix_array(text, symbols)
        plain = text.tolist()
        assert order.tolist() == sorted(range(n), key=lambda i: plain[i:])


@pytest.mark.parametrize(("span", "few"), [(1, 1), (8, 3), (1 << 10, 16)])
def test_suffix_arrays_of_many_names(monkeypatch, span, few):
    """Alphabets as large as the string, periods, runs and copies, at all sizes of what is taken side by side."""
    monkeypatch.setattr(suffixes, "SPAN", span)
    monkeypatch.setattr(suffixes, "FEW", few)
    rng = np.random.default_rng(span)
    long = rng.integers(0, 20_000, 10_000)
    texts = [rng.integers(0, a, n) for a in (1, 2, 3, 60) for n in (0, 1, 2, 3, 40)]
    texts += [np.resize(rng.integers(0, 5, p), 50) for p in (1, 2, 3, 7)] + [np.arange(40), np.arange(40)[::-1]]
    for text in texts:
        order = suffixes.suffix_array(text, 60)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    for text in (long, np.concatenate([long[:5000], long[:5000]]), np.repeat(long[:100], 100), np.resize(long[:37], 3000)):
        order = suffixes.suffix_array(text, 20_000)
        assert (np.sort(order) == np.arange(len(text))).all()
        rank = np.append(np.argsort(order), -1)
        a, b = order[:-1], order[1:]  # each pair of neighbours: first symbols, then the ranks of what follows
        assert ((text[a] < text[b]) | ((text[a] == text[b]) & (rank[a + 1] < rank[b + 1]))).all()


def test_wavelet_tree_counts():
    text = np.random.default_rng(1).integers(0, 37, 1000)
    tree = fm_index.WaveletTree(text, 37)
    for c in (0, 5, 36):
        at = np.arange(0, 1001, 13)
        assert tree.before(np.full(len(at), c), at).tolist() == [int((text[:k] == c).sum()) for k in at]


BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in BASE[0].finditer(text)]
    out += [(m.start(), 1, m.end()) for m in BASE[1].finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, low, high in ((2, 12, 19), (3, 9, 15)):
        for m in BASE[k].finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(2 * int(c), 10)) if j % 2 else int(c) for j, c in enumerate(reversed(digits)))
            if low <= len(digits) <= high and (k == 3 or doubled % 10 == 0):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_finds_what_the_patterns_find():
    rng, anchors = random.Random(5), pii.automaton()
    for letters in ("0123. ", "a@.-", "0 -1", "+1 ()-.5", "a@b.1+ 2é:/", "4-9 "):
        for _ in range(1500):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert [s for s in pii.find(text, anchors) if s[1] < 4] == base_spans(text), text


def test_personal_data_of_the_method_and_redaction(spark):
    text = 'joe (at) host.de IBAN DE89370400440532013000 http://me:secret@x.de SSN: 123-45-6789 token = "24be64439e3e49cf46b2d7c9"'
    kinds = [pii.KINDS[k] for _, k, _ in pii.find(text, pii.automaton())]
    assert kinds == ["masked", "account", "login", "email", "national", "secret"]
    docs = documents(spark, [(1, f"mail a.b@c.de and {'x' * 100000}"), (2, None), (3, ""), (1, "clean")])
    found = {r.text for r in pii.redacted(docs).collect()}
    assert f"mail <email> and {'x' * 100000}" in found and None in found and pii.redacted(docs).columns == docs.columns
    empty = sha256(b"").hexdigest()
    assert pii.digest(docs).filter(F.col("base_sha256") == empty).count() == 3


def test_personal_data_has_its_whole_length():
    anchors = pii.automaton()
    iban = "DE89 3704 0044 0532 0130 00"
    for text, kind, value in (
        (f"IBAN: {iban} BIC COBADEFFXXX", "account", iban),
        (f"IBAN {iban} 12345 or so", "account", iban),
        (f"IBAN {iban} ASAP.", "account", iban),
        (f"token={'a1' * 3000} end", "secret", "a1" * 3000),
        (f"https://{'u' * 300}:{'p' * 300}@host/x", "login", f"{'u' * 300}:{'p' * 300}"),
    ):
        assert [text[a:b] for a, k, b in pii.find(text, anchors) if pii.KINDS[k] == kind] == [value], text[:60]
    assert not pii.find("IBAN: DE88 3704 0044 0532 0130 00 BIC", anchors)
    began = time.process_time()
    for text in ("token=" * 100_000, "token=1" * 100_000, "://a:" * 100_000, "IBAN DE89" * 50_000):
        pii.find(text, anchors)
    assert time.process_time() - began < 20


def test_mix_takes_targets(spark):
    docs = documents(spark, awkward())
    rows = mixing.taken(docs, seed=3).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert Counter((i, len((t or "").split())) for i, t in awkward()) == Counter((r.doc_id, r["size"]) for r in rows)
    whole, order = 1.5 * sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        level = (whole - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 2 * sizes[s]}
        if not more:
            break
        full |= more
    for s in order:
        assert abs(target[s] - (2 * sizes[s] if s in full else weight[s] * level)) < 1e-6 and abs(taken[s] - target[s]) <= 0.5
    again = mixing.taken(docs.repartition(5), seed=3).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.taken(docs.limit(0)).count() == 0


def test_mix_pieces_are_the_words_taken(spark):
    docs = documents(spark, awkward())
    rows = mixing.placed(docs, seed=1, text=True)
    pieces = mixing.mix(rows, seed=1).collect()
    texts = defaultdict(set)
    for i, t in awkward():
        texts[i].add(" ".join((t or "").split()))
    for p in pieces:
        assert len(p.text.split()) == p.n_words and any(p.text in t for t in texts[p.doc_id])


def test_permutations_and_their_inverse():
    for n in (1, 2, 3, 64, 1000):
        places = mixing.permuted(np.arange(n), n, 9)
        assert sorted(places) == list(range(n)) and (mixing.restored(places, n, 9) == np.arange(n)).all()


def test_language_model_counts_and_sums(spark):
    docs = documents(spark, awkward())
    rows = ngram_lm.held_out_scores(docs).collect()
    data = [(i, (t or "").encode().lower().split() + [b"\n"], zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) for i, t in awkward()]
    counts = Counter(w for _, ws, held in data if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((i, held, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws, held in data)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == expected
    assert ngram_lm.held_out_scores(docs.limit(0)).count() == 0


def plain_model(data):
    """Probability of a token after the two before it, from counts in plain dictionaries."""
    c = [Counter(), Counter(), Counter()]
    for ws, held in data:
        if not held:
            seq = ["", *ws]
            for k in range(1, len(seq)):
                c[0][seq[k]] += 1
                c[1][tuple(seq[k - 1 : k + 1])] += 1
                if k > 1:
                    c[2][tuple(seq[k - 2 : k + 1])] += 1
    n, v = sum(c[0].values()), len(c[0])
    starts = sum(not held for _, held in data)

    def p(w, before):
        p1 = (c[0][w] + 1) / (n + v + 1)
        one = starts if before[-1] == "" else c[0][before[-1]]
        p2 = (c[1][before[-1], w] + 4 * p1) / (one + 4)
        if len(before) == 1:
            return p2
        return (c[2][before[-2], before[-1], w] + 2 * p2) / (c[1][before[-2], before[-1]] + 2)

    return p, c[0]


def test_language_model_scores(spark):
    docs = awkward()
    data = [((t or "").lower().split() + [b"end"], zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) for i, t in docs]
    p, words = plain_model(data)
    expected = sorted((len(ws), sum(math.log10(p(w, ["", *ws][max(0, k - 1) : k + 1])) for k, w in enumerate(ws))) for ws, _ in data)
    found = sorted((r.n_tokens, r.score) for r in ngram_lm.held_out_scores(documents(spark, docs)).collect())
    assert [x[0] for x in found] == [x[0] for x in expected]
    assert np.allclose([x[1] for x in found], [x[1] for x in expected], rtol=1e-9)
    for before in (["", "w5"], ["w5", "w6"], [""], ["never"], ["never", "w7"], ["w5", "never"]):
        assert abs(sum(p(w, before) for w in [*words, "seen by nobody"]) - 1) < 1e-9


def test_language_model_stretches_change_nothing():
    texts = pa.array([b"a b c a b d " * 400, b"", None, b"a b", b"d a b c " * 90])
    tokens, first = ngram_lm.sequences(texts)
    keys, valid = ngram_lm.ngram_keys(tokens, first)
    names, counts = np.unique(np.concatenate([k[v] for k, v in zip(keys, valid)]), return_counts=True)
    counts[::3] = 0
    model, word, _ = ngram_lm.automaton(keys, valid, names, counts, 500, 5)
    whole = model.score(word, first, 1 << 20)
    for stretch in (1, 2, 3, 64):
        assert np.allclose(model.score(word, first, stretch), whole)


def test_language_identification(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language.held_out_languages(docs).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").filter("held_out")
    right = found.agg(F.avg((F.col("lang_pred") == F.col("truth")).cast("double"))).first()[0]
    assert right > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "", None), (None, "the word", "en"), (4, "Zug", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in language.held_out_languages(odd).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {r.lang_pred for r in language.held_out_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_language(rows):
    """lang_pred and score from counts in plain dictionaries, learned from rows that aren't held out."""
    counts, docs = [defaultdict(Counter) for _ in range(6)], Counter()
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(b"" if i is None else str(i).encode()) % 5:
            docs[lang] += 1
            for w in re.findall(r"[a-zé]+", text.lower()):
                counts[0][w][lang] += 1
                for level in range(1, 6):
                    for k in range(len(w) + 3 - level):
                        counts[level][f"<{w}>"[k : k + level]][lang] += 1
    langs = sorted({lang for c in counts for x in c.values() for lang in x})

    def frequency(level, gram, lang):
        return math.log((counts[level][gram][lang] + 0.5) / (sum(x[lang] for x in counts[level].values()) + 0.5 * len(counts[level])))

    def predict(text):
        words = re.findall(r"[a-zé]+", (text or "").lower())
        if not words or not langs:
            return "und", 0.0
        total = {lang: math.log(docs[lang] / sum(docs[x] for x in langs)) for lang in langs}
        for w in words:
            for level in (0, 5, 4, 3, 2, 1):
                grams = [w] if level == 0 else [f"<{w}>"[k : k + level] for k in range(max(0, len(w) + 3 - level))]
                known = [g for g in grams if g in counts[level]]
                if known:
                    for lang in langs:
                        total[lang] += sum(frequency(level, g, lang) for g in known) / len(known)
                    break
        best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
        return best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)

    return predict


def test_language_predictions(spark):
    rng = random.Random(9)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(30)] for x, letters in (("aa", "abcdé"), ("bb", "cdefg"), ("cc", "efgha"))}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randint(1, 6))), x) for i in range(40) for x in words]
    rows += [(7, "² ½ ①", "aa"), (8, None, "bb"), (9, "", None), (None, "abc", None), (10, "zzz qqq", "aa"), (10, "zzz qqq", "aa"), (11, "abcdefgh " * 30_000, None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    predict = plain_language(rows)
    expected = Counter((i, *(x if k == 0 else round(x, 6) for k, x in enumerate(predict(t)))) for i, t, _ in rows)
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.held_out_languages(df).collect()) == expected
    assert language.held_out_languages(df.limit(0)).count() == 0


def test_a_rare_language_is_learned_beside_a_hot_one(spark):
    rows = [(i, f"the cat sat on mat{i % 50}", "hot") for i in range(3000)] + [(5000 + i, "ein hund im garten", "rare") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.col("doc_id"), rows=100)
    assert model.predict(["hund garten", "cat"])[0] == ["rare", "hot"]


def test_toxicity_learns_words_of_each_language():
    rng = random.Random(2)
    plain = [f"{p}{k}" for p in ("en", "fr") for k in range(300)]
    bad = {"en": ["enbad1", "enbad2", "enbad3"], "fr": ["frbad1", "frbad2", "frbad3"]}

    def text(lang, toxic):
        words = [w for w in rng.choices(plain, k=400) if w.startswith(lang)][:120]
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad[lang]))
        return " ".join(words)

    made = [(text(lang, toxic), toxic, lang) for lang in ("en", "fr") for toxic in [1] * 120 + [0] * 240]
    rng.shuffle(made)
    texts, toxic, langs = zip(*made, strict=True)
    model = toxicity.train(list(texts[:500]), np.array(toxic[:500]), list(langs[:500]))
    score = model.score(pa.array([*texts[500:], None, "", "x " * 20000]))
    wrong = sum((s >= 0.7) != bool(t) for s, t in zip(score, toxic[500:]))
    assert wrong <= 6 and (score[-3:] < 0.7).all() and ((score >= 0) & (score <= 1)).all()


def test_toxicity_forward_pass():
    """Scores of a classifier against loops over words, filters and positions."""
    texts = ["a b c d", "", "b", "c a c a b d e " * 20]
    model = toxicity.train([f"{w} x{i} y" for i in range(40) for w in ("a b", "d e")], np.array([1, 0] * 40), ["en"] * 80)
    ids, begin = toxicity.word_buckets(pa.array(texts))
    for t, text in enumerate(texts):
        words = [ids[:, begin[t] + k] for k in range(len(text.split()))]
        pooled = []
        for responses, bias in zip(model.responses, model.bias, strict=True):
            best = [-math.inf] * len(bias)
            for at in range(len(words) + 1):  # a filter may run over the end
                for f in range(len(bias)):
                    best[f] = max(best[f], sum(float(responses[j][words[at + j][s], f]) for j in range(len(responses)) if at + j < len(words) for s in (0, 1)))
            pooled += [max(0.0, x + float(y)) for x, y in zip(best, bias, strict=True)]
        logit = sum(x * float(y) for x, y in zip(pooled, model.out, strict=True)) + model.out_bias
        lang = model.language(ids, begin)[t]
        expected = 1 / (1 + math.exp(-(toxicity.SLOPE * (logit - model.thresholds[lang]) + math.log(0.7 / 0.3))))
        assert abs(model.score(pa.array(texts))[t] - expected) < 1e-4


def test_toxicity_learns_from_long_texts_and_counts_label_rows_once(spark):
    rng = random.Random(1)
    long = [(i, " ".join(rng.choices([f"w{k}" for k in range(500)], k=1500) + ["bad1 bad2"] * (i % 3 == 0)), "en", "x", 1) for i in range(150)]
    docs = spark.createDataFrame(long + [(None, None, None, None, None), (0, long[0][1], "en", "x", 1)], "doc_id long, text string, lang string, score string, predicted int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] * 3, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.responses
    rows = toxicity.scored(docs, model, "s").collect()
    assert len(rows) == 152 and sum((r.s >= 0.7) != (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None) <= 8
    assert toxicity.held_out_scores(docs.limit(0), labels).count() == 0 and toxicity.held_out_scores(docs, labels.limit(0)).count() == 152


def test_toxicity_without_labels(spark):
    docs = documents(spark, awkward())
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.held_out_scores(docs, labels).collect()
    assert len(rows) == docs.count() and {r.predicted for r in rows} == {0}


def test_decontamination(spark):
    bench = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda MU"), (2, "short item"), (3, None), (None, "nobody's own item words here"), (3, "..."), (2, "short item")]
    docs = [(1, "x ALPHA beta gamma delta epsilon zeta eta theta iota kappa y"), (2, "a short-item, and a short item"), (3, None), (4, ""), (5, "alpha beta gamma"), (5, "É nobody s own item words here É"), (1, "x ALPHA beta gamma delta epsilon zeta eta theta iota kappa y")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = documents(spark, docs)
    rows = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(d, b).collect())
    assert rows == Counter([(1, 12, 10, 1, True), (1, 12, 10, 1, True), (2, 7, 4, 1, True), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 3, 0, 0, False), (5, 8, 6, 0, True)])
    kept = decontamination.decontaminate(d, b)
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(3, None), (4, ""), (5, "alpha beta gamma")}
    spans = {r.text for r in decontamination.decontaminate(d, b, remove="spans").collect()}
    assert "x           y" in spans and None in spans
    assert decontamination.contamination(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(d.limit(0), b).count() == 0


def brute_components(docs, n, percent):
    sets = defaultdict(list)
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    up = {i: i for i in sets if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in up:
        for j in up:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return Counter((i, len(s), None if i is None else root(i)) for i in sets for s in sets[i])


@pytest.mark.parametrize(("block", "fragments"), [(256, 4), (2, 16)])
def test_jaccard_components(spark, monkeypatch, block, fragments):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FRAGMENTS", fragments)
    rng = random.Random(8)
    docs = awkward()
    base = [f"v{k}" for k in range(80)]
    for i in range(100, 130):  # a chain of near copies
        base = base[:]
        base[rng.randrange(len(base))] = f"z{i}"
        docs.append((i, " ".join(base)))
    found = Counter(tuple(r) for r in jaccard.join(documents(spark, docs)).collect())
    assert found == brute_components(docs, 4, 85)


def test_jaccard_links_sets_whose_keys_agree_in_a_byte(spark):
    def key(text):
        hashes, first = jaccard.shingle_sets(pa.array([text]))
        return int(jaccard._class_keys(hashes, first)[0].view(np.uint64)[0]) % 255

    base = " ".join(f"w{k}" for k in range(60))
    near = next(text for i in range(100_000) if key(text := f"{base} x{i}") == key(base))
    docs = [(1, base), (2, near), (3, "other words that nobody has")]
    for parts in (1, 3):  # in one blob, and in several
        found = Counter(tuple(r) for r in jaccard.join(documents(spark, docs).repartition(parts)).collect())
        assert found == brute_components(docs, 4, 85)


def test_jaccard_of_nothing(spark):
    assert jaccard.join(documents(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in jaccard.join(documents(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_components_in_few_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(200, 201), (201, 200)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(51), 0), 200: 200, 201: 200}


@pytest.mark.parametrize("sizes", [(16384, 4096, 1024, 0.8), (50, 3, 16, 0.2)])
def test_top_k(spark, monkeypatch, sizes):
    for name, value in zip(("PART_ROWS", "QUERY_ROWS", "BUCKET", "STEEP"), sizes, strict=True):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 3])).astype(float).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 330)] + [(330, None), (331, [1.0, None] + [0.0] * 6), (332, [float("nan")] * 8), (None, [1.0] * 8), (333, [1.0, 2.0]), (400, [0.0] * 8), (500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q, v in good.items():
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in good.items() if i != q and len(w) == len(v))[:10]
            assert found[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_of_nothing_and_of_large_numbers(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    rows = [(0, [2.0**20, 3.0, 2.0**15]), (1, [2.0**20, 1.0, -1.0]), (2, [-(2.0**20), 5.0, 0.0]), (3, [1.5, 2.0**21, 0.25])]
    found = {r.vec_id: r.score for r in topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).collect()}
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    assert found == {i: sum(x * y for x, y in zip(whole[0], v)) for i, v in whole.items() if i}
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 1.0])], schema), F.col("vec_id") == 0).collect()


def test_small_packs_and_shards_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(packs, "BLOB_BYTES", 500)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    docs = documents(spark, awkward())
    test_repeated_bytes(spark)
    assert fm_index.removed(docs.limit(0)).count() == 0 and substrings.removed(docs.limit(0)).count() == 0


def test_remainder_is_crc32(spark):
    df = spark.createDataFrame([(5,), (None,)], "doc_id long").select(remainder("doc_id", 7))
    assert [r[0] for r in df.collect()] == [zlib.crc32(b"5") % 7, 0]


def test_queries_are_complete():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


def thue_morse(n: int) -> tuple[str, str]:
    """Two strings of n letters whose polynomial hashes modulo 2**64 agree, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("length", [512, 1024, 2048, 4096])
def test_words_are_told_apart(spark, length):
    one, other = thue_morse(length)
    line = [f"w{k}" for k in range(40)]
    texts = [(1, " ".join([*line[:20], one, *line[20:]])), (2, " ".join([*line[:20], other, *line[20:]]))]
    assert [r.n_removed for r in fm_index.removed(documents(spark, texts)).collect()] == [0, 0]
    texts = [(1, f"{one} x y z"), (2, f"{other} x y z"), (3, f"{one} x y z"), (4, one), (5, other)]
    assert {r.doc_id: r.component_id for r in jaccard.join(documents(spark, texts)).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_windows_are_told_apart():
    one, other = (np.array([ord(c) for c in x], np.uint64) for x in thue_morse(64))
    for n in (4, 5, 12, 32, 35):
        hashes = np.concatenate([tokens.window_hashes(one, n), tokens.window_hashes(other, n)])
        plain = [tuple(x[i : i + n]) for x in (one, other) for i in range(len(x) - n + 1)]
        assert len(set(hashes.tolist())) == len(set(plain))


def test_large_groups_are_linked(spark):
    """Chains and groups over several blocks, whose ends share nothing."""
    words = [f"v{k}" for k in range(2000)]
    docs = [(k, " ".join(words[2 * k : 2 * k + 100])) for k in range(700)]
    docs += [(5000 + k, " ".join([*words[1900:], f"u{k}", *words[1800:1900]])) for k in range(600)]
    found = {r.doc_id: r.component_id for r in jaccard.join(documents(spark, docs)).collect()}
    assert found == {i: 0 if i < 700 else 5000 for i, _ in docs}
