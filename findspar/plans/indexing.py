"""Queries over the index: near duplicates, admission, sync, listing, consistency.

The tables of an index are made from documents' fixed chunks: English and German
documents are indexed, German and French ones arrive; documents of one source stand
for skipped copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findspar.functions import text as T
from findspar.operators import dedup, index
from findspar.plans import _sql as S
from findspar.plans.texts import docs, fixed_chunks
from findspar.session import ensure_checkpoints
from findspar.sources import corpus


def _signed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents' compact signatures, and their classes' pairs."""
    d = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")
    signed = dedup.signatures(d)
    small = dedup.compact(signed)
    return small, dedup.class_pairs(signed, small, lambda ids: dedup.signatures(dedup.with_ids(d, ids, "chunk_id")))


def shingle_pairs(spark, sf):
    """Pairs of different classes of near duplicates, by their smallest documents."""
    small, pairs = _signed(spark, sf)
    heads = small.groupBy("class").agg(F.min("chunk_id").alias("head"))
    pairs = pairs.join(heads.toDF("class_a", "a"), "class_a").join(heads.toDF("class_b", "b"), "class_b")
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), F.round("similarity", 6).alias("similarity"))


def duplicate_classes(spark, sf):
    """Every document's class of equal shingles and facts, by its smallest document."""
    ensure_checkpoints(spark)
    named = dedup.signatures(docs(spark, sf), "doc_id", "text").select("chunk_id", "class").checkpoint()  # used twice
    heads = named.groupBy("class").agg(F.min("chunk_id").alias("class_id"), F.count("*").alias("members"))
    return named.join(heads, "class").select(F.col("chunk_id").alias("doc_id"), "class_id", "members")


def dedup_admission(spark, sf):
    """Which documents are admitted in order of id, and what the others repeat."""
    return dedup.admit(*_signed(spark, sf)).select(F.col("chunk_id").alias("doc_id"), "duplicate_of", F.round("similarity", 6).alias("similarity"))


def _chunks(spark, sf) -> DataFrame:
    lang = docs(spark, sf).select("doc_id", "lang")
    return fixed_chunks(spark, sf).join(lang, "doc_id")


def index_sync_plan(spark, sf):
    """German documents arrive again without their last chunk, French ones are new."""
    c = _chunks(spark, sf)
    last = F.max("chunk_index").over(Window.partitionBy("doc_id"))
    fresh = c.withColumn("last", last).where("lang = 'fr' or (lang = 'de' and (chunk_index < last or last = 0))")
    plan = index.sync_plan(c.where("lang in ('en', 'de')").select("doc_id", "chunk_id"), fresh.select("doc_id", "chunk_id"))
    return plan.groupBy("doc_id", "action").agg(F.count("*").alias("n"))


def _tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = fixed_chunks(spark, sf)
    copies = c.where("source = 'src0'").withColumn("duplicate_of", F.concat(F.col("doc_id").cast("string"), F.lit("-original")))
    return c.where("source <> 'src0'"), copies


def document_listing(spark, sf):
    return index.listing(*_tables(spark, sf))


def documents_page(spark, sf):
    listed = index.page_of(index.listing(*_tables(spark, sf)), 100, 50)
    return listed


def collection_sizes(spark, sf):
    listed = index.listing(*_tables(spark, sf))
    return index.collection_sizes(listed, F.when(F.col("source").isin("src0", "src1"), F.col("source")).otherwise("demo"))


def check_sync(spark, sf):
    """Documents as passages, embeddings as their vectors, copies of one source whose originals are gone."""
    d = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "source")
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"))
    copies = d.where("source = 'src0'").select("chunk_id", (-F.col("chunk_id")).alias("duplicate_of"))
    return index.check(d.select("chunk_id"), v, copies)


def embed_misses(spark, sf):
    """Distinct document texts that a cache of the English ones lacks."""
    key = T.cache_key("model-1", F.col("text"))
    d = docs(spark, sf)
    cache = d.where("lang = 'en'").select(key.alias("key")).distinct()
    return index.embed_misses(d.select("text"), cache, key).select("key", F.length("text").alias("n_chars"))


def index_sync(spark, sf):
    """Documents as passages.  English and German ones are indexed and Spanish ones skipped as copies of their successors; odd German ones arrive revised, French ones anew."""
    d = docs(spark, sf).select(F.col("doc_id").alias("n"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "lang", "text")

    def rows(part: DataFrame, version: str) -> DataFrame:
        return part.select(F.concat("doc_id", F.lit(f":{version}")).alias("chunk_id"), "doc_id", "text", F.lit(0).alias("chunk_index"))

    odd = d.where("lang = 'de' and n % 2 = 1").withColumn("text", F.concat("text", F.lit(" revised")))
    fresh = rows(odd, "b").union(rows(d.where("lang = 'fr' or (lang = 'de' and n % 2 = 0)"), "a"))
    skipped = d.where("lang = 'es'")
    copies = skipped.select(F.concat("doc_id", F.lit(":a")).alias("chunk_id"), "doc_id", "text", F.lit(0).alias("chunk_index"), F.concat(F.lit("d"), (F.col("n") + 1).cast("string"), F.lit(":a")).alias("duplicate_of"), F.lit(1.0).alias("similarity"))
    chunks, copies = index.sync(rows(d.where("lang in ('en', 'de')"), "a"), copies, fresh, cut=False)
    kept = chunks.select("chunk_id", F.md5(F.encode("text", "UTF-8")).alias("text"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("double").alias("similarity"))
    return kept.union(copies.select("chunk_id", F.md5(F.encode("text", "UTF-8")), "duplicate_of", "similarity"))


def store_refresh(spark, sf):
    """A store of three languages' documents meets an ingest of two: some files fail by rule, one source's are deleted."""
    d = docs(spark, sf)

    def parsed(rows: DataFrame, text: F.Column, bad: F.Column) -> DataFrame:
        name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
        made = F.struct(text.alias("text"), F.col("source").alias("heading"), F.lit(None).cast("int").alias("page"))
        return rows.select(name.alias("source"), F.col("doc_id").cast("string").alias("doc_id"), F.sha2(text, 256).alias("sha256"), F.when(~bad, F.array(made)).alias("sections"), F.when(bad, "ValueError: no text").alias("error"))

    before = parsed(d.where("lang in ('en', 'de', 'fr')"), F.col("text"), F.col("doc_id") % 11 == 0)
    fresh = parsed(d.where("lang in ('de', 'es')"), F.concat(F.lit("new "), "text"), F.col("doc_id") % 7 == 0)
    gone = before.where("source like 'src0/%'").select("source")
    now = corpus.stored(before, fresh, gone)
    return now.select("source", "doc_id", "sha256", F.md5(F.encode(F.get("sections", F.lit(0))["text"], "UTF-8")).alias("text"), "error")


def kept_documents(spark, sf):
    """Documents that go when a seed names the English ones only."""
    d = docs(spark, sf)
    return index.to_remove(d.select("doc_id"), d.where("lang = 'en'").select("doc_id"))


def missing_passages(spark, sf):
    """Vectors as hits, documents as the table."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.col("vec_id") * 3).alias("chunk_id"), F.col("label").alias("query_id"))
    return index.missing_passages(v, docs(spark, sf).select(F.col("doc_id").alias("chunk_id"))).select("query_id", "chunk_id")


QUERIES = {f.__name__: f for f in (shingle_pairs, duplicate_classes, dedup_admission, index_sync_plan, document_listing, documents_page, collection_sizes, check_sync, embed_misses, index_sync, store_refresh, kept_documents, missing_passages)}

CLASSES = f"""
w AS (SELECT doc_id, {S.words("text")} AS w, {S.facts("text")} AS f FROM documents WHERE length(text) >= 120),
s AS (SELECT doc_id, list_sort({S.shingles("w")}) AS s, f FROM w WHERE len(w) > 0),
c AS (SELECT md5(array_to_string(s, '|') || '#' || array_to_string(f, ' ')) AS class, min(doc_id) AS head, count(*) AS members, any_value(s) AS s, md5(array_to_string(any_value(f), ' ')) AS f FROM s GROUP BY 1)
"""
PAIRS = f"""{CLASSES},
x AS (SELECT head, f, len(s) AS n, unnest(s) AS t FROM c),
p AS (SELECT a.head AS a, b.head AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.f = b.f AND a.head < b.head GROUP BY ALL),
pairs AS (SELECT a AS id_a, b AS id_b, k::DOUBLE / (na + nb - k) AS similarity FROM p WHERE 10 * k >= 9 * (na + nb - k))
"""
TABLES = f"{S.FIXED}, main AS (SELECT * FROM chunks WHERE source <> 'src0'), copies AS (SELECT * FROM chunks WHERE source = 'src0')"
LISTED = f"""{TABLES}, ids AS (SELECT doc_id, source FROM main UNION SELECT doc_id, source FROM copies),
listed AS (SELECT i.doc_id, min(i.source) AS source, coalesce(any_value(m.n), 0) AS chunks, coalesce(any_value(d.n), 0) AS duplicates FROM ids i
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM main GROUP BY doc_id) m ON m.doc_id = i.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM copies GROUP BY doc_id) d ON d.doc_id = i.doc_id GROUP BY i.doc_id)"""
SYNC = f"""
d AS (SELECT doc_id AS n, 'd' || doc_id AS doc, lang, text FROM documents),
removed AS (SELECT doc || ':a' AS cid FROM d WHERE lang = 'de' AND n % 2 = 1),
dup AS (SELECT doc || ':a' AS cid, doc, text, 'd' || (n + 1) || ':a' AS of_ FROM d WHERE lang = 'es'),
rows_ AS (SELECT doc || ':a' AS cid, doc, text, 0 AS turn FROM d WHERE lang = 'en' OR (lang = 'de' AND n % 2 = 0)
    UNION ALL SELECT doc || ':b', doc, text || ' revised', 1 FROM d WHERE lang = 'de' AND n % 2 = 1 UNION ALL SELECT doc || ':a', doc, text, 1 FROM d WHERE lang = 'fr'
    UNION ALL SELECT cid, doc, text, 2 FROM dup WHERE of_ IN (SELECT cid FROM removed)),
every AS (SELECT *, row_number() OVER (ORDER BY turn, CASE WHEN turn > 0 THEN doc END, cid) AS o FROM rows_),
w AS (SELECT o, {S.words("text")} AS w, {S.facts("text")} AS f FROM every WHERE length(text) >= 120),
s AS (SELECT o, list_sort({S.shingles("w")}) AS s, f FROM w WHERE len(w) > 0),
c AS (SELECT md5(array_to_string(s, '|') || '#' || array_to_string(f, ' ')) AS class, min(o) AS head, any_value(s) AS s, md5(array_to_string(any_value(f), ' ')) AS f FROM s GROUP BY 1),
x AS (SELECT head, f, len(s) AS n, unnest(s) AS t FROM c),
p AS (SELECT a.head AS a, b.head AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.f = b.f AND a.head < b.head GROUP BY ALL),
pairs AS (SELECT a AS id_a, b AS id_b, k::DOUBLE / (na + nb - k) AS similarity FROM p WHERE 10 * k >= 9 * (na + nb - k)),
walk AS (SELECT 0 AS i, (SELECT min(head) FROM c) AS head, CAST([] AS BIGINT[]) AS kept
    UNION ALL
    SELECT w.i + 1, (SELECT min(head) FROM c WHERE head > w.head), CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.id_b = w.head AND list_contains(w.kept, p.id_a)) THEN w.kept ELSE list_append(w.kept, w.head) END
    FROM walk w WHERE w.head IS NOT NULL),
kept AS (SELECT unnest(kept) AS id FROM walk WHERE head IS NULL),
choice AS (SELECT id_b AS head, arg_min(e.cid, (-similarity, e.cid)) AS of_, max(similarity) AS similarity FROM pairs JOIN every e ON e.o = id_a WHERE id_a IN (SELECT id FROM kept) AND id_b NOT IN (SELECT id FROM kept) GROUP BY id_b),
m AS (SELECT o, head FROM (SELECT o, md5(array_to_string(s, '|') || '#' || array_to_string(f, ' ')) AS class FROM s) JOIN c USING (class)),
decided AS (SELECT m.o, coalesce(of_, CASE WHEN m.o <> m.head THEN h.cid END) AS of_, CASE WHEN of_ IS NOT NULL THEN similarity ELSE 1.0 END AS similarity FROM m JOIN every h ON h.o = m.head LEFT JOIN choice ON choice.head = m.head)
"""
SQL = {
    "index_sync": f"""WITH RECURSIVE {SYNC} SELECT cid AS chunk_id, md5(text) AS text, CASE WHEN turn > 0 THEN of_ END AS duplicate_of, CASE WHEN turn > 0 AND of_ IS NOT NULL THEN round(similarity, 4) END AS similarity FROM every LEFT JOIN decided USING (o)
        UNION ALL SELECT cid, md5(text), of_, 1.0 FROM dup WHERE of_ NOT IN (SELECT cid FROM removed)""",
    "store_refresh": """WITH b AS (SELECT source || '/' || doc_id AS s, doc_id, text, doc_id % 11 = 0 AS bad FROM documents WHERE lang IN ('en', 'de', 'fr')), f AS (SELECT source || '/' || doc_id AS s, doc_id, 'new ' || text AS text, doc_id % 7 = 0 AS bad FROM documents WHERE lang IN ('de', 'es')),
        j AS (SELECT coalesce(f.s, b.s) AS source, coalesce(f.doc_id, b.doc_id)::VARCHAR AS doc_id, f.s IS NOT NULL AND NOT (f.bad AND b.s IS NOT NULL AND NOT b.bad) AS new, f.text AS ft, b.text AS bt, f.bad AS fb, b.bad AS bb, f.s IS NOT NULL AS seen FROM f FULL JOIN b ON f.s = b.s)
        SELECT source, doc_id, sha256(CASE WHEN new THEN ft ELSE bt END) AS sha256, md5(CASE WHEN new THEN CASE WHEN NOT fb THEN ft END WHEN NOT bb THEN bt END) AS text, CASE WHEN CASE WHEN seen THEN fb ELSE bb END THEN 'ValueError: no text' END AS error FROM j
        WHERE source NOT LIKE 'src0/%' OR source NOT IN (SELECT s FROM b)""",
    "kept_documents": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "missing_passages": "SELECT label AS query_id, vec_id * 3 AS chunk_id FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)",
    "shingle_pairs": f"WITH {PAIRS} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM pairs",
    "duplicate_classes": f"""WITH {CLASSES} SELECT doc_id, head AS class_id, members FROM (SELECT doc_id, md5(array_to_string(s, '|') || '#' || array_to_string(f, ' ')) AS class FROM s) JOIN c USING (class)""",
    "dedup_admission": f"""WITH RECURSIVE {PAIRS},
        walk AS (SELECT 0 AS i, (SELECT min(head) FROM c) AS head, CAST([] AS BIGINT[]) AS kept
            UNION ALL
            SELECT w.i + 1, (SELECT min(head) FROM c WHERE head > w.head), CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.id_b = w.head AND list_contains(w.kept, p.id_a)) THEN w.kept ELSE list_append(w.kept, w.head) END
            FROM walk w WHERE w.head IS NOT NULL),
        kept AS (SELECT unnest(kept) AS id FROM walk WHERE head IS NULL),
        choice AS (SELECT id_b AS head, arg_min(id_a, (-similarity, id_a)) AS of_, max(similarity) AS similarity FROM pairs WHERE id_a IN (SELECT id FROM kept) AND id_b NOT IN (SELECT id FROM kept) GROUP BY id_b),
        m AS (SELECT doc_id, head FROM (SELECT doc_id, md5(array_to_string(s, '|') || '#' || array_to_string(f, ' ')) AS class FROM s) JOIN c USING (class))
        SELECT doc_id, coalesce(of_, CASE WHEN doc_id <> m.head THEN m.head END) AS duplicate_of, CASE WHEN of_ IS NOT NULL THEN round(similarity, 6) WHEN doc_id <> m.head THEN 1.0 END AS similarity FROM m LEFT JOIN choice USING (head)""",
    "index_sync_plan": f"""WITH {S.FIXED}, l AS (SELECT *, max(chunk_index) OVER (PARTITION BY doc_id) AS last FROM chunks),
        fresh AS (SELECT DISTINCT doc_id, chunk_id FROM l WHERE lang = 'fr' OR (lang = 'de' AND (chunk_index < last OR last = 0))),
        have AS (SELECT doc_id, chunk_id FROM chunks WHERE lang IN ('en', 'de') AND doc_id IN (SELECT doc_id FROM fresh))
        SELECT coalesce(f.doc_id, h.doc_id) AS doc_id, CASE WHEN h.chunk_id IS NULL THEN 'add' WHEN f.chunk_id IS NULL THEN 'remove' ELSE 'keep' END AS action, count(*) AS n
        FROM fresh f FULL JOIN have h ON f.doc_id = h.doc_id AND f.chunk_id = h.chunk_id GROUP BY ALL""",
    "document_listing": f"WITH {LISTED} SELECT * FROM listed",
    "documents_page": f"WITH {LISTED} SELECT * FROM listed ORDER BY source, doc_id LIMIT 100 OFFSET 50",
    "collection_sizes": f"WITH {LISTED} SELECT CASE WHEN source IN ('src0', 'src1') THEN source ELSE 'demo' END AS collection, count(*) AS documents, sum(chunks)::BIGINT AS chunks FROM listed GROUP BY 1",
    "check_sync": """SELECT 'missing_vector' AS problem, doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT 'stray_vector', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'lost_original', doc_id FROM documents WHERE source = 'src0' AND -doc_id NOT IN (SELECT doc_id FROM documents)""",
    "embed_misses": "SELECT sha256('model-1' || chr(0) || text) AS key, length(text) AS n_chars FROM (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en'))",
}
