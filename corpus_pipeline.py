"""From documents to shards of a training mix, in five stages.

Each stage takes all that the one before kept, written as Parquet and read again. All but the last return the columns
of documents; the last adds size, text_crc32, shard and slot. A document that the mix repeats has a row a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanloom.llm import decontamination, jaccard_join, language, mixing, sharding
from scanloom.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one learned language holds three tenths at least; null texts and texts without letters go."""
    return language.accepted(docs, language.learned(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id."""
    return jaccard_join.first_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes of each document, in training order."""
    return mixing.training_order(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    return sharding.sharded(docs)


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", shards),
]

#: Learned languages, alignment and placement on a ring have no SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
