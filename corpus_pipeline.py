"""Corpus pipeline: STAGES applied in turn to the documents table.

Language ID drops documents without a language, exact dedup keeps one of equal texts, the n-gram
Jaccard join keeps one document of each group of near duplicates, the secret scan blots out secrets,
and packing lays what is left into windows of tokens. All stages but the last return the columns of
documents.

Rows: a document that is rejected, or is a copy, is gone for the later stages. In a group of near
duplicates the row with the component's smallest doc_id stays (null ids last; of rows that share it,
one by a hash of the text). Rows are told by id and text, so null and repeated ids do no harm. The
packing stage returns one row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwell.llm import content_sort, jaccard_join, language_id, packing, runtime, secret_scan

#: Documents whose language is less certain than this are rejected, as are those without a letter.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.prepare(spark)
    model = language_id.train(docs.filter(language_id.fold(F.col("doc_id")) != 1).select("text", "lang"))
    return language_id.keep_certain(docs, model, LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.prepare(spark)
    return content_sort.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.prepare(spark)
    return jaccard_join.keep_one(docs)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.prepare(spark)
    return secret_scan.redact(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", blot_secrets),
    ("packing", pack_tokens),
]

#: A naive Bayes model, a random forest and packing are no SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents, each stage written and read again as in a real run."""
    docs = runtime.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = runtime.written(docs, f"stage-{k}-{name}")
    return docs
