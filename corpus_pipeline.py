"""The corpus pipeline: five stages from raw documents to a mix for training.

Each stage works on all rows that its predecessor kept; all but the last return
the columns of documents. Scores, links, hits and spans are computed from whole
texts. There is no SQL form: the classifier and the block permutations of the
mix can't be written in SQL; the tests hold every stage against a brute-force
version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, jaccard, mixing, pii, toxicity
from strandline.llm.tables import read, remainder, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier doesn't reject; it learns from the labels that op7 learns from."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1))
    return toxicity.scored(docs, model, "_toxicity").filter(F.col("_toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar shingle sets, the one of the smallest id: five words, similarity 0.8 or more."""
    return jaccard.deduplicated(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its size, its source's target, and how many of its words the mix takes."""
    return mixing.taken(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
