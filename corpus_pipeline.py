"""Cleaning a corpus of documents in stages; each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. Rows with null or empty texts pass every filter, and rows that are equal
are treated alike, except that one document of each group of near copies stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import bpe, decontaminate, jaccard, pii, queries, toxicity
from foliospark.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model is fitted to the labelled ones."""
    return toxicity.keep_clean(docs, "text", queries.toxicity_model(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return jaccard.keep_first(docs, "doc_id", "text")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    items = queries.table(spark, sf_dir, "benchmark")
    return decontaminate.keep_clean(docs, "doc_id", "text", items, "item_id", "text")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs, "text", pii.fit(docs, "doc_id", "text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return bpe.tokens(docs, "doc_id", "text", *queries.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", hide_personal_data),
    ("tokens", tokenize),
]

#: SQL cannot express a fitted model or a tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
