"""A training corpus from ``documents``: five stages, each a table that the next one reads.

Every stage works on all that its predecessor kept and gives back the columns of the
documents; the last adds each row's shard.  Rows without an id, with equal ids, repeated rows and null or
empty texts pass through all stages as rows of their own; columns besides the documents' own stay,
whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauseflow.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from clauseflow.llm.base import saved, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; equal texts share their score, null and empty ones stay."""
    return toxicity.civil(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, of the smallest id; texts without a word all stay."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, also one whose item has no id; null and empty texts stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target weights; a row comes as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard``; equal texts share one, null and empty ones too."""
    items, heavy = sharding.packing(docs)
    return sharding.place(docs, items, heavy)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None  # a trained score and transitive near copies are beyond one SQL statement


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = saved(stage(spark, docs, sf_dir), name)
    return docs
