"""DataFrame helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findspar.session import checkpoint_root, spread_small

_made: list[str] = []  # folders that this process made, oldest first


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a variant that clashes with no column of df (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under new names: narrow(docs, id="doc_id", text="text")."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def add_struct(df: DataFrame, text: str, fields: str, fn: Callable[[pa.Array], list[pa.Array]], name: str) -> DataFrame:
    """df with one more column, a struct of `fields` that fn computes from a batch of texts."""
    kind = T._parse_datatype_string(f"struct<{fields}>")
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind, False)])
    labels = kind.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.StructArray.from_arrays(fn(batch.column(batch.schema.get_field_index(text))), names=labels)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder below `checkpoint_root`.

    Results are lazy, so the tables that they read must outlive the call; what is no
    longer read goes through `discard` or `release`.
    """
    path = f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read it, whichever executors are lost."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables made by `written` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if any(path.endswith(own.rsplit("/", 1)[-1]) for own in _made):
                _delete(df.sparkSession, path)


def made() -> int:
    """How many folders were made so far, for `release`."""
    return len(_made)


def release(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Deletes the folders made since then, but not those that the kept tables read."""
    stay = {f.rsplit("/", 2)[-2] for df in kept for f in df.inputFiles()}
    for path in [p for p in _made[since:] if p.rsplit("/", 1)[-1] not in stay]:
        _delete(spark, path)
        _made.remove(path)


def return_memory() -> None:
    """Freed memory of this process goes back to the system; what the driver once gathered for a fit would else stay with it through all later steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:  # glibc has it
        trim(0)


def crc_residue(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo `modulus`; null ids give null."""
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_small(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
