"""A corpus pipeline: quality, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns the documents it keeps, with their columns; the last returns their places in
packed sequences.  ``run`` writes every stage's result as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import mixing, packing, pii, quality, simhash
from tidewire.llm.common import drop_table, scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return simhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; a document taken twice is there twice."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near-duplicates", without_near_copies),
    ("personal data", without_personal_data),
    ("mixture", mixed),
    ("packing", packed),
]

#: Discriminants, BPE and the rest are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote on its way goes once its result is written
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if former is not None:
            drop_table(former)
        former = docs
    return STAGES[-1][1](spark, docs, sf_dir)
