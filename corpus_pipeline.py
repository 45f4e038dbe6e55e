"""A corpus pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and
returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import contamination, language, mixing, near_dedup, sharding
from threadloom.llm.common import shared_folder, table

#: Share of the tokens that reach the mixing stage which it takes.
MIX_SHARE = 0.8


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: those without text or without a letter."""
    return language.keep_identified(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes MIX_SHARE of the tokens, dealt evenly over the tree of domains, languages and sources."""
    return mixing.mix(docs, share=MIX_SHARE).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents into 24 shards cut from their Hilbert order."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("near-duplicates", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learned stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = posixpath.join(shared_folder(spark), f"corpus-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = posixpath.join(folder, str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
