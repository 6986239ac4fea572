"""The corpus pipeline: documents -> quality rules -> one of each near-duplicate group -> texts without
repeated passages -> texts without secrets -> packed sequences.

Every stage is written as Parquet and read again as the next one's input. Stages keep the columns of
documents but for the last, which returns the packing of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mentiongraph.llm import ngram_join, packing, quality_rules, queries, secret_scan, substring_dedup
from mentiongraph.llm.tables import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity."""
    return ngram_join.keep_one(docs, n=5, percent=75)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that repeat."""
    return substring_dedup.remove_repeats(docs, window=35)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in optimal length buckets and token-budget batches."""
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeats), ("secret scan", secrets), ("packing", packed)]

# A trained tagger and a library's token counts are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(f"stage-{i}", stage(spark, docs, sf_dir))
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
