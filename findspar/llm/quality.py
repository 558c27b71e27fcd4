"""Quality by importance resampling: hashed n-gram generative models and Gumbel top-k.

Words and word pairs are hashed into `BUCKETS` buckets.  Two smoothed bag models
are estimated: the raw one from every document, the target one from documents
labelled as good.  A document's log weight is the sum over its n-grams of
log(target / raw).  Adding standard Gumbel noise, drawn from a hash of the id,
and taking the k largest samples k documents without replacement in proportion
to their weights.

Counts are summed per task into two arrays of fixed size before the only wide
shuffle.  The cut between the k largest and the rest is found without a global
sort: histograms narrow the interval that holds the cut until at most EDGE_ROWS
rows, or only equal keys, are left in it, and only those are ranked.  (Noise is
drawn from ids, so equal keys are rows of one id and text.)

The labelled rows are a bounded sample: at most `MAX_TARGET` ids with the label,
the lowest by hash.  All documents count for the raw model, and all are scored.

Defined results: a null or wordless text has no n-grams and log weight 0; rows
repeat; null ids share one draw of noise; without labelled rows all weights are 0
and the sample is uniform; an empty table gives an empty result.  Ties of the
key go to the smaller id, null first; rows equal in both are ordered by their
log weight and share the rank's fate by a stable row number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findspar.llm import _words as w
from findspar.llm._frames import add_struct, fresh, narrow, written

BUCKETS = 1 << 14
MAX_TARGET = 20_000
SMOOTHING = 1.0
BINS = 1 << 16
EDGE_ROWS = 20_000
FRACTION = 0.5


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all words and word pairs of each row, and the index of each row's first."""
    for _, _, hashed, first in w.words(column, w.ALNUM):
        row = w.row_of(first)
        pair = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[1:]
        both = np.flatnonzero(row[:-1] == row[1:]) if len(row) else np.zeros(0, np.int64)
        rows = np.concatenate([row, row[both]])
        bucket = np.concatenate([hashed, w.mix64(pair[both])]) >> np.uint64(50)
        order = np.argsort(rows, kind="stable")
        yield bucket[order].astype(np.int64), np.searchsorted(rows[order], np.arange(len(first)))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", max_target: int = MAX_TARGET) -> np.ndarray:
    """log(target / raw) of each bucket."""
    good = narrow(labels, id=label_id, y=label).where("id is not null and y = 1").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_target)
    marked = narrow(docs, id=doc_id, text=text).join(F.broadcast(good.withColumn("good", F.lit(True))), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            is_good = np.array(batch.column("good").to_pylist(), bool)
            at = 0
            for bucket, first in features(batch.column("text")):
                rows = len(first) - 1
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[np.repeat(is_good[at : at + rows], np.diff(first))], minlength=BUCKETS)
                at += rows
        on = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[0][on]), pa.array(total[1][on])], names=["bucket", "raw", "target"])

    rows = marked.mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    # the target's smoothing follows the raw model, so that unseen buckets say nothing
    p = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    q = (target + SMOOTHING * BUCKETS * p) / (target.sum() + SMOOTHING * BUCKETS)
    return np.log(q / p)


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", name: str = "weight") -> tuple[DataFrame, str]:
    """docs with a struct column (log_weight, n_grams), and its name."""
    name = fresh(docs, name)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(column: pa.Array) -> list[pa.Array]:
        parts = [(w.per_row(sent.value[bucket], first), np.diff(first)) for bucket, first in features(column)]
        return [pa.array(np.concatenate([p for p, _ in parts]) if parts else np.zeros(0)), pa.array(np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64))]

    return add_struct(docs, text, "log_weight double, n_grams bigint", run, name), name


def gumbel(doc_id: str, seed: int = 11) -> F.Column:
    """Standard Gumbel noise from a hash of the id: the same in every run."""
    u = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def sample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, log_weight, n_grams, gumbel_key, selected of every document row; ceil(fraction x rows) are selected."""
    weighed, name = weigh(narrow(docs, doc_id=doc_id, text=text), learn(docs, labels, doc_id, text), "text")
    keys = written(weighed.select("doc_id", f"{name}.log_weight", f"{name}.n_grams").withColumn("gumbel_key", F.col("log_weight") + gumbel("doc_id")), "quality")
    bounds = keys.agg(F.count("*").alias("n"), F.min("gumbel_key").alias("low"), F.max("gumbel_key").alias("high")).first()
    n, low, high = bounds["n"], bounds["low"] or 0.0, bounds["high"] or 0.0
    left = -int(-n * fraction // 1)  # how many of those between low and high are to be selected
    key = F.col("gumbel_key")
    while True:  # narrow the interval that holds the cut until few rows, or only ties, are in it
        width = (high - low) / BINS
        if not left or not width > abs(high) * 1e-13:
            break
        bin_ = F.least(F.floor((key - low) / width), F.lit(BINS - 1))
        counts = sorted(((r["b"], r["count"]) for r in keys.where(key.between(low, high)).groupBy(bin_.alias("b")).count().collect()), reverse=True)  # at most BINS rows
        for b, rows in counts:
            if left <= rows:
                break
            left -= rows
        inside = keys.where(key.between(low, high) & (bin_ == b)).agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
        low, high = inside["low"], inside["high"]
        if rows <= EDGE_ROWS:
            break
    order = Window.partitionBy("cut").orderBy(key.desc(), "doc_id", "log_weight")
    edge = keys.where(key.between(low, high)).withColumn("cut", F.lit(0)).withColumn("selected", F.row_number().over(order) <= left).drop("cut")
    return keys.where(~key.between(low, high)).withColumn("selected", key > high).unionByName(edge)
