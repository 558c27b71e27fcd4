"""Evaluation files as tables: JSON documents, and JSON lines that may open with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON list of objects, or one object, as rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, header: str | None = None) -> DataFrame:
    """JSON lines as rows; lines that hold the field `header` describe the run and are left out.  A line that is no JSON is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if header:
        lines = lines.where(F.get_json_object("value", f"$.{header}").isNull())
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def header_of(spark: SparkSession, path: str, header: str) -> str | None:
    """The first line that holds the field `header`, as it stands."""
    found = spark.read.text(path).where(F.get_json_object("value", f"$.{header}").isNotNull()).first()
    return found["value"] if found else None
