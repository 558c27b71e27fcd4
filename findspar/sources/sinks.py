"""Sinks: parsed documents as JSON, raw copies, lines appended per batch, exported cache rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def processed_json(parsed: DataFrame, path: str) -> None:
    """One JSON object per parsed document, in a folder per document, so that one can be replaced alone."""
    parsed.where("error is null").withColumn("folder", F.col("doc_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").json(path)


def new_raw(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (source, content) whose bytes aren't stored yet under their name; names that leave the root are refused."""
    escaped = files.where(F.col("source").rlike(r"(^|/)\.\.(/|$)|^/")).limit(1)
    if not escaped.isEmpty():
        raise ValueError("a source path leaves the root")
    keyed = files.withColumn("sha256", F.sha2("content", 256))
    return keyed.join(stored.select("source", "sha256"), ["source", "sha256"], "left_anti")


def append_lines(rows: DataFrame, path: str) -> None:
    """One JSON line per row, added to those that are there."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def exported(cache: DataFrame, texts: DataFrame, key) -> DataFrame:
    """The cache's rows (key, vector) that the texts need."""
    return cache.join(texts.select(key.alias("key")).distinct(), "key", "left_semi")
