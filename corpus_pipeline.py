"""The corpus pipeline: five stages, each one of the operators of ``tessera.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
``run`` writes each stage's rows as Parquet into the shared folder and reads them
back, so a lost executor repeats a stage's task and never the chain; a stage's input is
removed once its rows are written. All stages but the last return the columns of
``documents``, extra columns included, whatever their names.

In all stages: an empty table gives no rows; rows that repeat another are rows like any
other, but that exact_dedup keeps one; very long texts are read as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language_id, near_copies, packing, pii
from tessera.llm.common import remove, scratch, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: those without a letter (null and empty
    texts among them), and those whose calibrated score is next to a guess. Without any
    labelled row to learn from all go."""
    return language_id.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (runs of white space are one space, null is empty) the smallest
    doc_id stays, once; a null doc_id stays where its text has no other."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of Jaccard 0.8 in five-word shingles connect the smallest
    doc_id stays; texts without words are one group; rows without doc_id stay."""
    return near_copies.drop_near(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars made anew; no document goes;
    null texts stay null."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; null is an empty text, a
    null doc_id is kept."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Language ID, fingerprints, differencing and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
