"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between stages
the rows are a Parquet table. All but the last return the columns of documents. A stage names rows by their place in its
input, never by doc_id, so rows that repeat a doc_id or have none are rows of their own; exact and near dedup leave one
of rows that are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, exact_dup, language, mixing, near_dup, packing


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without a letter and narrow margins go. Repeated rows stay as often."""
    return language.accepted_documents(docs, language.fit(language.training_rows(docs)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; null, empty and blank texts are one group. Of repeated rows one stays."""
    return exact_dup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more. Rows without words all stay, and of repeated
    rows with words one."""
    return near_dup.without_near_copies(docs, width=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in the order of its schedule: rows as often as it takes them, up to twice; the last that a
    source gives may be cut after the words that were taken. Rows without words are never taken; repeated rows are rows of their own."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 tokens; repeated rows are packed each."""
    return packing.pack_in_order(docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]
#: Language ID and the schedule's floating point cannot be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
