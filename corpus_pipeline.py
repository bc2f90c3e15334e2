"""A corpus from raw documents to tokens: each stage applies one operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, pii, simhash, toxicity
from gridloom.runtime import cut, release, table

#: Rows of a batch of whole texts between Spark and its Python workers, each of which holds one or two.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows instead of Spark's default; another number that the session has set stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Labels are learned from the rows of ``docs`` that aren't held out; null and
    empty texts score as a text without a word."""
    small_batches(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts alike in 0.8 of their five-word shingles stays, that of the least doc_id; rows
    without a doc_id stay."""
    small_batches(spark)
    return simhash.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with at most a tenth of it edited, go; null texts hold none."""
    small_batches(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text become surrogates, and n_chars is that of the new text."""
    return pii.replace(docs, pii.KEY).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, ids) of every document."""
    small_batches(spark)
    return bpe.digests(docs, **bpe.production(), with_ids=True)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: None of the models, fingerprints and merges can be put in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are written to the shared folder and read again by the next.

    Null and empty texts are clean, one kind of text (none at all) to near duplicates, hold no leak and no entity, and
    have no token. Rows with a null doc_id stay unless toxic or leaking; of rows that repeat, one of each class stays.
    Texts are read whole, however long. Extra columns pass every stage but the last, whatever their names. An empty
    table gives no row; without labels no document is rejected, without a benchmark none leaks.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
