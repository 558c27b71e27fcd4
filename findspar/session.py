"""Session settings that the engine relies on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/findspar-checkpoints"

#: A single file below so many bytes is often one row group, so one task; dealing it over the cores costs less than that.
SMALL_FILE = 64 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir or the context names.  Only a single local JVM may go without; there one is chosen here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go below `checkpoint_root`."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))


def build(app: str = "findspar", master: str | None = None) -> SparkSession:
    """A session with the settings that plans here are written for; cluster settings given elsewhere win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.parquet.filterPushdown", "true").getOrCreate()


def spread_small(df: DataFrame) -> DataFrame:
    """A table of one small file dealt evenly over the cores; any other as it lies."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SMALL_FILE and len(df.inputFiles()) == 1:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df
