"""Sliding-window limits, answer cache and upload registry over event tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR, DAY = 3600, 86_400


def micros(ts: str) -> Column:
    return F.unix_micros(ts)


def trailing(events: DataFrame, seconds: int, by: list[str], ts: str = "ts") -> Column:
    """How many events of the same key lie in the `seconds` before each one (those at the window's far edge have expired)."""
    window = Window.partitionBy(*by).orderBy("_t").rangeBetween(-(seconds * 1_000_000 - 1), -1)
    return F.count("*").over(window)


def visitor_counts(events: DataFrame, per_hour: int, visitor: str = "user_id", ts: str = "ts") -> DataFrame:
    """events with `recent` (the visitor's in the hour before) and `over` (at the limit); an upper bound of what a limiter with refusals does."""
    out = events.withColumn("_t", micros(ts))
    return out.withColumn("recent", trailing(out, HOUR, [visitor])).withColumn("over", F.col("recent") >= per_hour).drop("_t")


def daily_counts(events: DataFrame, per_day: int, ts: str = "ts", slot: int = 300) -> DataFrame:
    """Per time slot of `slot` seconds: events in it and in the day up to it, and whether the limit is reached.

    All visitors share this limit, so events are summed to slots before the only
    window without a key: its input is as long as the time span, not as the events.
    """
    slots = events.groupBy(F.floor(micros(ts) / (slot * 1_000_000)).alias("slot")).agg(F.count("*").alias("n"))
    window = Window.orderBy("slot").rangeBetween(-(DAY // slot) + 1, 0)
    return slots.withColumn("last_day", F.sum("n").over(window)).withColumn("over", F.col("last_day") >= per_day)


def admit(events: DataFrame, per_hour: int, visitor: str = "user_id", event_id: str = "event_id", ts: str = "ts") -> DataFrame:
    """(event_id, admitted, retry_after): only admitted events count against the limit, so a visitor's are walked in order.

    They stream through one task, sorted by the shuffle; what is held are the times of
    the visitor's admitted events of the last hour, `per_hour` at most.
    """
    kind = dict(events.dtypes)[event_id]
    rows = events.select(F.col(event_id).alias("event_id"), F.col(visitor).alias("visitor"), micros(ts).alias("t")).repartition("visitor").sortWithinPartitions("visitor", "t", "event_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, taken = object(), deque()
        for batch in batches:
            admitted, wait = [], []
            for who, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if who != own:
                    own, taken = who, deque()
                while taken and taken[0] <= t - HOUR * 1_000_000:
                    taken.popleft()
                ok = len(taken) < per_hour
                admitted.append(ok)
                wait.append(None if ok else (taken[0] + HOUR * 1_000_000 - t) // 1_000_000 + 1)
                if ok:
                    taken.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(admitted, pa.bool_()), pa.array(wait, pa.int64())], names=["event_id", "admitted", "retry_after"])

    return rows.mapInArrow(walk, f"event_id {kind}, admitted boolean, retry_after bigint")


#: Statuses of answers that are worth keeping.
CACHEABLE = ("answered", "partial", "not_found")


def cache_hits(requests: DataFrame, key: list[str], ttl: int = HOUR, ts: str = "ts", unique: str = "event_id") -> DataFrame:
    """requests with `hit`: whether an answer stored in the last `ttl` seconds is there; a miss stores one, a hit doesn't renew it.

    A stored answer serves until it's older than the ttl, so misses follow each other by
    more than it.  With a column `status` only answers of the `CACHEABLE` ones are
    stored, and the version of the index belongs into the key.  A key's requests stream
    through one task in order of time, sorted by the shuffle: what is held is the time
    of the last stored answer, however many requests there are.
    """
    names = [*key, ts, unique, *(["status"] if "status" in requests.columns else [])]
    rows = requests.select(*dict.fromkeys(names)).withColumn("_t", micros(ts)).repartition(*key).sortWithinPartitions(*key, "_t", unique)
    kind = dict(requests.dtypes)[unique]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stored = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in key], strict=True))
            times = batch.column(batch.schema.get_field_index("_t")).to_pylist()
            keep = [s in CACHEABLE for s in batch.column(batch.schema.get_field_index("status")).to_pylist()] if "status" in names else [True] * len(times)
            hits = []
            for k, t, ok in zip(keys, times, keep, strict=True):
                if k != own:
                    own, stored = k, None
                hit = stored is not None and t is not None and t - stored <= ttl * 1_000_000
                if not hit and ok:
                    stored = t
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(unique)), pa.array(hits, pa.bool_())], names=["_unique", "hit"])

    found = rows.mapInArrow(walk, f"_unique {kind}, hit boolean")
    return requests.join(found, requests[unique] == found["_unique"]).drop("_unique")


def live_uploads(uploads: DataFrame, now: Column, ttl: int = HOUR, per_visitor: int = 3, total: int = 20, ts: str = "ts") -> DataFrame:
    """Uploads that are still held at `now`: not expired, the visitor's newest few, and of those the newest overall."""
    fresh = uploads.where((F.col(ts) <= now) & (F.unix_micros(ts) > F.unix_micros(now) - ttl * 1_000_000))
    own = F.row_number().over(Window.partitionBy("visitor").orderBy(F.col(ts).desc(), F.col("upload_id").desc()))
    return fresh.withColumn("_n", own).where(F.col("_n") <= per_visitor).drop("_n").orderBy(F.col(ts).desc(), F.col("upload_id").desc()).limit(total)


# Limits of an upload.
UPLOAD = {"bytes": 5 << 20, "pages": 50, "chunks": 400}


def upload_status(uploads: DataFrame) -> DataFrame:
    """uploads (name, size, pages, chunks) with the status code each would get."""
    kind = F.lower(F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1))
    code = (
        F.when(~kind.isin(".md", ".mdx", ".txt", ".html", ".htm", ".pdf"), 415).when(F.col("size") > UPLOAD["bytes"], 413)
        .when(F.coalesce(F.col("pages") > UPLOAD["pages"], F.lit(False)), 422).when(F.coalesce("chunks", F.lit(0)) == 0, 422).when(F.col("chunks") > UPLOAD["chunks"], 413).otherwise(201)
    )
    return uploads.withColumn("status", code)
