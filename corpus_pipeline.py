"""A corpus pipeline: reject toxic texts, keep one of each group of near copies, drop
documents that hold benchmark items, redact personal data, pack what is left.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as
Parquet and read again for the next. All but the last return the columns of
``documents``, whatever their names.

Defined results: null and empty texts pass through every stage as documents without
words; an empty table stays empty; rows that repeat an id are one document to the
near-copy stage, which keeps one of them, and rows of their own to the others; a row
without an id is no copy of another, but goes if it is toxic or holds a benchmark item;
of equally near copies the smallest id stays; a score at the threshold rejects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, ngram_join, packing, pii, toxicity
from plumbline.llm.common import fresh
from plumbline.llm.tokens import vocabulary
from plumbline.session import ship
from plumbline.sources.shared import broadcast_if_small, drop_table, work_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; the labels of ``sf_dir`` train the model."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity.reject(docs, toxicity.train(texts, labels))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    ship(spark)
    return ngram_join.keep_one(docs, size=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; each row, one without an id too, is known by a hash of its id and text."""
    ship(spark)
    row, other = F.xxhash64("doc_id", "text"), fresh("leak", docs.columns)
    hits = decontamination.find_leaks(docs.withColumn("doc_id", row), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = work_table(hits.select(F.col("doc_id").alias(other)).distinct(), "leaks")
    return docs.join(broadcast_if_small(leaks, ngram_join.MOST_BROADCAST), row == F.col(other), "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; ``n_chars`` follows the text."""
    ship(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents in length buckets and batches."""
    ship(spark)
    return packing.pack(packing.token_lengths(docs, vocabulary()))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each on what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = work_table(stage(spark, docs, sf_dir), name)
        drop_table(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
