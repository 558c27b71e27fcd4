"""The index as tables: listing, sync plans, consistency checks, and versioned writes.

There is no update in place: a write makes a new version of a table in its own
folder and then moves a pointer, so readers see one version or the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findspar.operators import dedup
from findspar.session import ensure_checkpoints


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of their key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


class VersionedTable:
    """A Parquet table below `path`: folders by version number, the newest complete one is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append(int(name[1:]))
        return sorted(found)

    @property
    def version(self) -> int:
        return (self._versions() or [0])[-1]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version}")

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        number = self.version + 1
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/v{number}")
        return number


def sync_plan(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, action): add, keep or remove, for documents that `fresh` holds; both (doc_id, chunk_id)."""
    have = existing.join(fresh.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "chunk_id", F.lit(True).alias("have"))
    want = fresh.select("doc_id", "chunk_id", F.lit(True).alias("want")).distinct()
    action = F.when(F.col("have").isNull(), "add").when(F.col("want").isNull(), "remove").otherwise("keep")
    return have.join(want, ["doc_id", "chunk_id"], "full").select("doc_id", "chunk_id", action.alias("action"))


def to_remove(indexed: DataFrame, keep: DataFrame) -> DataFrame:
    """(doc_id): indexed documents that a seed's list doesn't name."""
    return indexed.select("doc_id").distinct().join(keep.select("doc_id"), "doc_id", "left_anti")


def missing_passages(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose passage isn't in the table any more: they are left out of results, and reported."""
    return hits.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def orphans(duplicates: DataFrame, removed: DataFrame) -> DataFrame:
    """Skipped copies of passages that go: they are candidates again."""
    return duplicates.join(removed.select(F.col("chunk_id").alias("duplicate_of")), "duplicate_of", "left_semi")


def sync(chunks: DataFrame, duplicates: DataFrame, fresh: DataFrame, cut: bool = True) -> tuple[DataFrame, DataFrame]:
    """The chunks and duplicates tables after `fresh` has replaced its documents' passages.

    Kept passages stand before all candidates; a document's new passages come
    next, in their order, then orphaned copies in other documents.

    Texts stay where they lie: what happens to them is decided by ids.  With `cut` the
    results are checkpointed, since a sync often follows another one; a caller that stores
    them can do without.
    """
    ensure_checkpoints(chunks.sparkSession)
    plan = sync_plan(chunks, fresh).checkpoint()
    ids = {a: plan.where(F.col("action") == a).select("chunk_id") for a in ("add", "keep", "remove")}
    columns = chunks.columns
    synced = fresh.select("doc_id").distinct().checkpoint()
    stay = dedup.with_ids(dedup.with_ids(chunks, ids["remove"], "chunk_id", "left_anti"), ids["keep"], "chunk_id", "left_anti")
    refreshed = stay.unionByName(dedup.with_ids(fresh, ids["keep"], "chunk_id").select(*columns))
    orphaned = orphans(duplicates.select("chunk_id", "doc_id", "duplicate_of"), ids["remove"]).join(synced, "doc_id", "left_anti").select("chunk_id").checkpoint()
    homeless = dedup.with_ids(duplicates, orphaned, "chunk_id").select(*columns)
    new = dedup.with_ids(fresh, ids["add"], "chunk_id").select(*columns)
    order = [F.lit(0), F.lit(1), F.lit(2)]
    every = refreshed.withColumn("_turn", order[0]).unionByName(new.withColumn("_turn", order[1])).unionByName(homeless.withColumn("_turn", order[2]))
    turn = F.struct(F.col("_turn"), F.when(F.col("_turn") > 0, F.col("doc_id").cast("string")), F.when(F.col("_turn") > 0, F.col("chunk_index")))
    signed = dedup.signatures(every, order=turn)
    small = dedup.compact(signed)
    pairs = dedup.class_pairs(signed, small, lambda ids: dedup.signatures(dedup.with_ids(every, ids, "chunk_id"), order=turn))
    decided = dedup.admit(small, pairs).where("duplicate_of is not null").checkpoint()
    candidates = new.unionByName(homeless)
    few = decided.count() <= dedup.MANY_IDS
    skipped = candidates.join(F.broadcast(decided) if few else decided, "chunk_id")
    added = dedup.with_ids(candidates, decided, "chunk_id", "left_anti")
    old = dedup.with_ids(dedup.with_ids(duplicates, synced, "doc_id", "left_anti"), orphaned, "chunk_id", "left_anti")
    kept = refreshed.unionByName(added.select(*columns))
    copies = old.unionByName(skipped.select(*columns, "duplicate_of", F.round("similarity", 4).alias("similarity")))
    return (kept.checkpoint(), copies.checkpoint()) if cut else (kept, copies)


def check(chunks: DataFrame, vectors: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(problem, chunk_id): passages without a vector, vectors without a passage, copies whose original is gone."""
    lost = duplicates.join(chunks.select(F.col("chunk_id").alias("duplicate_of")), "duplicate_of", "left_anti")
    parts = (
        chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").select(F.lit("missing_vector").alias("problem"), "chunk_id"),
        vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select(F.lit("stray_vector"), "chunk_id"),
        lost.select(F.lit("lost_original"), "chunk_id"),
    )
    return parts[0].union(parts[1]).union(parts[2])


def listing(chunks: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Every document of either table with its numbers of passages and skipped copies."""
    one = chunks.select("doc_id", "source", F.lit(1).alias("chunks"), F.lit(0).alias("duplicates"))
    every = one.union(duplicates.select("doc_id", "source", F.lit(0), F.lit(1)))
    return every.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("chunks").alias("chunks"), F.sum("duplicates").alias("duplicates"))


def page_of(listed: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be from 1 to 1000, offset not negative")
    return listed.orderBy("source", "doc_id").offset(offset).limit(limit)


def collection_sizes(listed: DataFrame, collection: Column) -> DataFrame:
    return listed.groupBy(collection.alias("collection")).agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))


def embed_misses(texts: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Distinct keyed texts that the embedding cache lacks: each is sent to the model once."""
    keyed = texts.withColumn("key", key)
    return keyed.groupBy("key").agg(F.first("text").alias("text")).join(cache.select("key"), "key", "left_anti")


def cached(cache: DataFrame, made: DataFrame) -> DataFrame:
    """The embedding cache with the vectors (key, vector) of what it lacked."""
    return cache.unionByName(made.select(*cache.columns).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"))


def also_appears_in(duplicates: DataFrame, shown: DataFrame) -> DataFrame:
    """Where else the texts of shown passages (chunk_id) occur: the copies that were skipped for them, by duplicate_of."""
    return duplicates.join(shown.select(F.col("chunk_id").alias("duplicate_of")).distinct(), "duplicate_of", "left_semi")


def stored_vectors(chunks: DataFrame, cache: DataFrame, store: DataFrame, key: Column) -> DataFrame:
    """(chunk_id, vector, origin) of passages: from the cache by key, else from the store by id, else null (an audit's business)."""
    keyed = chunks.select("chunk_id", key.alias("key"))
    joined = keyed.join(cache.select("key", F.col("vector").alias("cached")), "key", "left").join(store.select("chunk_id", F.col("vector").alias("kept")), "chunk_id", "left")
    origin = F.when(F.col("cached").isNotNull(), "cache").when(F.col("kept").isNotNull(), "store").otherwise("missing")
    return joined.select("chunk_id", F.coalesce("cached", "kept").alias("vector"), origin.alias("origin"))


def repair(chunks: DataFrame, vectors: DataFrame, duplicates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages to embed, vectors that stay, documents to sync again): what `check` reports, put right."""
    lost = duplicates.join(chunks.select(F.col("chunk_id").alias("duplicate_of")), "duplicate_of", "left_anti").select("doc_id").distinct()
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti"), vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), lost


def same_model(vectors: DataFrame, model: str) -> DataFrame:
    """The vectors, if all are of the model; a mixture is refused."""
    other = vectors.where(F.col("model") != model).select("model").limit(1).collect()
    if other:
        raise ValueError(f"the index was built with {other[0]['model']!r}, not {model!r}")
    return vectors
