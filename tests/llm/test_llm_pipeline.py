"""The stages of the corpus pipeline, each against what brute force keeps of its input."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import pii, toxicity
from strandline.llm.tables import stored

WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"en{k}" for k in range(900)]
    bad = [f"enbad{k}" for k in range(5)]
    rows, labels = [], []
    for i in range(500):
        text = rng.choices(words, k=rng.randrange(40, 90))
        if toxic := int(i % 5 == 0):
            for _ in range(6):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), "en", f"s{i % 4}", None))
        labels.append((i, 1, toxic))
    bench = [(1, " ".join(f"bench{k}" for k in range(14)))]
    copy = rows[7][1].split()
    copy[-1] = "changed"
    rows += [(600, " ".join(copy), "en", "s1", None), (601, rows[8][1], "en", None, None), (602, " ".join(rng.choices(words, k=50)) + " " + bench[0][1], "en", "s0", 3), (603, "mail me a.b@c.org or +1 (555) 123-4567 " + rows[11][1][::-1], "en", "s2", 9), (604, None, None, None, None), (605, "", "en", "s0", 0), (604, None, None, None, None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder))
        after.append({r.doc_id: r for r in docs.collect()})
        assert name == "mixing" or docs.columns == columns
    clean, unique, decontaminated, redacted, mixed = after
    wrong = sum((i in clean) == ("enbad" in (texts[i] or "")) for i in texts)
    assert wrong <= 5 and {604, 605} <= set(clean)
    gone = set(clean) - set(unique)
    assert {600, 601} & set(clean) <= gone and gone <= {600, 601}
    assert set(unique) - set(decontaminated) == {602} & set(unique)
    assert set(redacted) == set(decontaminated)
    for i, r in redacted.items():
        expected = None if texts[i] is None else pii.redact(texts[i], pii.find(texts[i], pii.automaton()))
        assert r.text == expected and r.n_chars == (None if expected is None else len(expected))
    assert "<email>" in redacted[603].text and "<phone>" in redacted[603].text
    assert {i: r["size"] for i, r in mixed.items()} == {i: len((r.text or "").split()) for i, r in redacted.items()}
    assert sum(r.taken for r in mixed.values()) == pytest.approx(sum(r.target for r in {r.source: r for r in mixed.values()}.values()), abs=3)


def test_run_is_the_stages_one_after_the_other(spark, folder):
    assert corpus_pipeline.run(spark, folder).agg(F.count("*"), F.sum("taken")).first()[1] > 0


def test_the_classifier_needs_no_label_for_a_document(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id >= 600")
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert toxicity.scored(docs, model).filter("score >= 0.7").count() == 0
