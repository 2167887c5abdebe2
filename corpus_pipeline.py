"""A corpus from raw documents to a training mix, stage by stage.

Each stage reads what the one before it wrote, so a lost executor costs a stage's own tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandemtext.llm import decontamination, exact_dedup, jaccard_join, language, mixing
from tandemtext.llm.stored import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, or like none of the languages, go."""
    return language.drop_unknown(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts that share four fifths of their five-word runs, one stays."""
    return jaccard_join.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents a mix by source weights takes, and how many copies of each."""
    return mixing.mixed_documents(docs).select("row.*", "copies")


STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("exact_copies", without_copies),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("mix", mixed),
]

# The first stage is a classifier that is trained on the documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
