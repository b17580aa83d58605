"""A corpus pipeline: documents in, token digests of a clean, mixed corpus out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepwise.llm.bpe import encoded
from stepwise.llm.exact_dedup import drop_copies
from stepwise.llm.mixing import mixed
from stepwise.llm.shared import new_folder, remove_folder, scratch, table
from stepwise.llm.simhash import drop_near_copies
from stepwise.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the one with the smallest doc_id stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target weights, once or twice each."""
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe),
]

#: The classifier's scores and XXH64 fingerprints have no SQL; tests/llm hold run() against a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each writes Parquet in the shared folder and the next one reads it.

    What a stage has staged goes when its result is written, and that when the
    next one's is; the last result stays in the shared folder.

    All but the last return the columns of ``documents`` unchanged, whatever else
    they are named.  Null and empty texts are texts like others: they are scored
    as texts without known features, equal one another, and count as no words and
    no tokens.  Very long texts are taken whole.  Ties go as each stage's operator
    says; rows that repeat another one are copies, of which one stays.  Rows with
    a null doc_id stay rows of their own where their texts differ.  Empty tables
    give no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
