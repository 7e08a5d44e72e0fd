"""A training corpus from `documents`: quality rules, exact and near deduplication, mixing to target weights, packing.

Every stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
stage's documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from voxtide.llm import exact, mixing, packing, rules, similar
from voxtide.llm.common import new_path
from voxtide.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rules.kept_documents(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id."""
    return exact.drop_exact_duplicates(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on shingles of 5 words, the one with the smallest id; found by the SimHash operator on samples of shingles."""
    return similar.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source as often as its target says: a row per pass and run of words taken of a document."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), release=True)


STAGES = [("quality rules", quality), ("exact dedup", dedup_exact), ("near dedup", dedup_near), ("mixing", mix), ("packing", packed)]

#: Mixing and packing draw, permute and tokenize, which SQL doesn't express; tests/llm holds a brute-force version.
ORACLE_SQL = None


def materialized(docs: DataFrame, stage: int) -> DataFrame:
    """What a stage returns, written as Parquet and read again."""
    path = new_path(docs.sparkSession, f"stage-{stage}")
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialized(docs, i)
    return docs
