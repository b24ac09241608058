"""A cleaning pipeline over ``documents``: each stage works on all its predecessor kept.

Stages read ``doc_id`` and ``text`` and hand on all other columns, whatever their names. Null texts count as
empty; rows of a null id and repeated rows are rows of their own but for near copies, where they are
copies; an empty table gives an empty one."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from clearwell.functions.storage import drop_table, fresh_path, scratch
from clearwell.llm import decontaminate, packing, pii, simhash, toxicity
from clearwell.llm.common import batches_of, hold_at_most

# Whole texts that a task reads, or hands to Python, at a time.
TEXT_ROWS = 500


def _in_small_batches(stage):
    """A stage that leaves its session at ``TEXT_ROWS``: its result is planned by whoever writes it,
    so a setting for the time of the call would not reach it."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hold_at_most(spark, TEXT_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@_in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    model = toxicity.fit_held(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


@_in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id (see ``simhash.keep_one``)."""
    return simhash.keep_one(docs)


@_in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_in_small_batches
def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by their kind."""
    hidden = pii.redact(docs, pii.fit(docs))
    # The length is that of the new text, where the table tells one.
    return hidden.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else hidden


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

# A trained model, message passing and bit counts of hashes: no SQL says the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage needs besides its
    result is removed when that is written, and so is the result before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark), batches_of(spark, TEXT_ROWS):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_table(spark, before)
        before = path
    return docs
