"""Files to documents: listing, decoding, parsing by suffix, with failures as rows.

Files come from Spark's binaryFile source, so any store works.  A file that can't be
parsed doesn't stop the others: its row has an error instead of sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findspar.functions import text as T
from findspar.sources import html, markdown

SUFFIXES = (".md", ".mdx", ".txt", ".html", ".htm", ".pdf")
MAX_BYTES = 50 << 20
PARSER_VERSION = "1"


def listed(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """(source, content, length) of the supported files below root; with a manifest (path), of those it names.  Files over MAX_BYTES have null content.

    `source` is the path below root.  A manifest entry without a file is an error.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.rstrip("/")).withColumn("source", below(root))
    # the length is known from the listing: the bytes of too long files are never read
    files = found.where(F.col("length") <= MAX_BYTES).select("source", "content", "length")
    files = files.union(found.where(F.col("length") > MAX_BYTES).select("source", F.lit(None).cast("binary"), "length"))
    if manifest is None:
        return files.where(F.lower("source").rlike(r"\.(md|mdx|txt|html|htm|pdf)$"))
    missing = manifest.select(F.col("path").alias("source")).join(files.select("source"), "source", "left_anti").limit(5).collect()
    if missing:
        raise FileNotFoundError(f"named in the manifest but absent: {[r['source'] for r in missing]}")
    return files.join(manifest.select(F.col("path").alias("source")), "source", "left_semi")


def below(root: str, path: str = "path") -> Column:
    """A file's path below the root."""
    base = re.escape(re.sub(r"^\w+:/*", "", root.rstrip("/")).lstrip("/"))
    return F.regexp_extract(path, rf"^(?:\w+:/*)?/*{base}/(.*)$", 1)


def decoded(data: bytes) -> str:
    """UTF-8 with or without a mark, else the usual single-byte encoding; one kind of line end."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
    return "\n".join(text.replace("\r\n", "\n").split("\r"))


def parse(source: str, data: bytes | None) -> list[dict]:
    name = source.rsplit("/", 1)[-1]
    stem, _, suffix = name.rpartition(".")
    suffix = f".{suffix.lower()}"
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported type {suffix}")
    if data is None or len(data) > MAX_BYTES:
        raise ValueError("file too large")
    if suffix == ".pdf":
        raise ValueError("no PDF reader is bundled; give lines to sources.pdf")
    text = decoded(data)
    if suffix in (".html", ".htm"):
        found = html.parse(text, stem)
    elif suffix == ".txt":
        body = html.tidy(text.split("\n"))
        found = [{"text": body, "heading": stem, "page": None}] if body else []
    else:
        found = markdown.parse(text, stem)
    if not found:
        raise ValueError("no text")
    return found


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, source, sha256, sections, error) of files (source, content)."""
    rows = files.select("source", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, errors = [], []
            for source, data in zip(batch.column("source").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    made.append(parse(source, data))
                    errors.append(None)
                except Exception as e:
                    made.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(html.SECTION)), pa.array(errors, pa.string())], names=["source", "content", "sections", "error"])

    parsed = rows.mapInArrow(run, f"source string, content binary, sections {html.SECTIONS_DDL}, error string")
    return parsed.select(T.doc_id_of(F.col("source")).alias("doc_id"), "source", F.sha2("content", 256).alias("sha256"), "sections", "error")


def changed(files: DataFrame, parsed: DataFrame, version: str = PARSER_VERSION) -> DataFrame:
    """Files whose bytes or parser aren't those of an earlier result (source, sha256, parser_version)."""
    return files.withColumn("sha256", F.sha2("content", 256)).join(parsed.where(F.col("parser_version") == version).select("source", "sha256"), ["source", "sha256"], "left_anti")


def stored(before: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The store (source, doc_id, sha256, sections, error) after another ingest: parsed documents replace their source's, deleted sources (`gone`: source) go.

    A document that can't be parsed any more keeps its last good sections, with the new
    error beside them; so does its hash, and the file is tried again next time.
    """
    columns = ["source", "doc_id", "sha256", "sections", "error"]
    old = before.select("source", *[F.col(c).alias(f"_{c}") for c in columns[1:]])
    both = fresh.select(*columns).join(old, "source", "full")
    failed = F.col("error").isNotNull() & F.col("_sections").isNotNull()
    seen = F.col("doc_id").isNotNull()
    out = both.select(
        "source", F.coalesce("doc_id", "_doc_id").alias("doc_id"), F.when(seen & ~failed, F.col("sha256")).otherwise(F.col("_sha256")).alias("sha256"),
        F.when(seen & ~failed, F.col("sections")).otherwise(F.col("_sections")).alias("sections"), F.when(seen, F.col("error")).otherwise(F.col("_error")).alias("error"),
    )
    return out if gone is None else out.join(gone.select("source"), "source", "left_anti")


def section_rows(parsed: DataFrame) -> DataFrame:
    """(doc_id, source, section_no, text, heading, page) of parsed documents."""
    return parsed.where("sections is not null").select("doc_id", "source", F.posexplode("sections").alias("section_no", "s")).select("doc_id", "source", "section_no", "s.text", "s.heading", "s.page")


def utf8(content: Column) -> Column:
    """Text of bytes that are UTF-8, without a mark; null for others (see `decoded`)."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
