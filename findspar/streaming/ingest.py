"""Streams: incremental ingest of files, and limits that keep state per visitor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from findspar.operators import chunking, index
from findspar.sources import corpus

HOUR_US = 3600 * 1_000_000


def file_stream(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    """New files below root as they arrive (source, content); `source` is the path below root."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(root)
    return files.select(corpus.below(root).alias("source"), "content")


def ingest(spark: SparkSession, files: DataFrame, chunks: index.VersionedTable, checkpoint: str):
    """Each micro-batch parses and chunks its files and replaces those documents in the table; returns the started query."""

    def batch(rows: DataFrame, _: int) -> None:
        fresh = chunking.structure(corpus.section_rows(corpus.documents(rows)))
        if chunks.version:
            old = chunks.read().join(fresh.select("doc_id").distinct(), "doc_id", "left_anti")
            fresh = old.unionByName(fresh)
        chunks.write(fresh)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limited(requests: DataFrame, per_hour: int, delay: str = "10 minutes") -> DataFrame:
    """A stream of requests (visitor, event_id, ts) with the limiter's decision; state is the admitted times of the last hour."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, at in zip(rows["event_id"], rows["ts"].astype("int64") // (1000 if rows["ts"].dtype.str.endswith("[ns]") else 1), strict=True):
            taken = [t for t in taken if t > at - HOUR_US]
            ok = len(taken) < per_hour
            out.append((key[0], event, ok))
            if ok:
                taken.append(int(at))
        state.update((taken,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), max(taken, default=0) // 1000) + HOUR_US // 1000)
        yield pd.DataFrame(out, columns=["visitor", "event_id", "admitted"])

    kinds = dict(requests.dtypes)
    stream = requests.withWatermark("ts", delay).select("visitor", "event_id", "ts")
    return stream.groupBy("visitor").applyInPandasWithState(step, f"visitor {kinds['visitor']}, event_id {kinds['event_id']}, admitted boolean", "taken array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)

