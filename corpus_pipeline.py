"""The corpus pipeline: stages that each read what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logquarry.llm import decontam, language, mixing, simhash, suffixes
from logquarry.llm.common import small_batches, table, written


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents without a letter and those that no learned language shortens."""
    small_batches(spark)
    return language.known(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group that SimHash fingerprints link."""
    small_batches(spark)
    return simhash.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Cuts every string of 100 bytes that starts earlier in the corpus too; no document goes, ``n_chars`` follows."""
    small_batches(spark)
    return suffixes.cut(docs)


def leaked_benchmarks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    small_batches(spark)
    return decontam.clean(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The training sequence: every copy taken, with its words and its position."""
    return mixing.mix(docs)


STAGES = [
    ("language", known_language),
    ("near copies", one_of_near_copies),
    ("repeated strings", repeated_strings),
    ("benchmarks", leaked_benchmarks),
    ("mix", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1], 1):
        docs = written(stage(spark, docs, folder), f"stage{number}")
    return STAGES[-1][1](spark, docs, folder)
