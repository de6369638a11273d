"""Text corpus pipeline: from documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return
the columns of ``documents``; the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelab.llm import chunks, decontaminate, language, neardups, packing
from tablelab.session import checkpointed


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter or with a narrow margin go."""
    return language.drop_rejected(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id."""
    return neardups.drop_near_duplicates(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in earlier documents; texts that consist of them go."""
    return chunks.drop_repeats(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens, documents of like content beside each other; one row per piece."""
    return packing.report(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("substrings", remove_repeated_passages),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]

#: The stages hash, compress and tokenise texts, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
