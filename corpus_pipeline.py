"""The corpus pipeline: documents pass toxicity, language, near-duplicate, benchmark and mixing stages in this order.

Each stage is one operator of findspar.llm; its result is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findspar.llm import decontaminate, jaccard, language, mixing, toxicity
from findspar.llm._frames import made, release, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine predicts toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letter, or fits no learned language."""
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents with two or more items, or nothing else, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: documents by position, once for each time they are taken."""
    return mixing.schedule(docs)


STAGES = [("toxicity", toxic), ("language", languages), ("near duplicates", near_duplicates), ("decontamination", benchmarks), ("mixing", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before wrote is deleted as soon as the next one's documents are complete."""
    docs, since = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        release(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models decide which documents stay, which SQL cannot express; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None
