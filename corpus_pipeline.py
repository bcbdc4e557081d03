"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents, whatever further ones these have.

Rows in every stage: a null text is an empty one (the quality rules reject both); a null doc_id, lang or source is a value like others;
of rows that are equal the near duplicates keep one; very long texts are worked on whole; an empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codecairn.llm import bpe, jaccard, line_rules, mixing, novelty
from codecairn.sources.scratch import saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or lose most of their words with the common lines, go; those lines go too."""
    return line_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest doc_id."""
    return jaccard.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked."""
    return novelty.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: number of tokens, digests of the ids and of the decoded text."""
    return bpe.token_digests(docs, bpe.vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("source mixing", mixture),
    ("bpe encoding", encoding),
]

#: Entropy balancing iterates, and novelty and BPE are no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
