"""Queries over the search operators: benchmark texts ask, documents and embeddings answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspar.functions import text as T
from findspar.operators import evaluation, search
from findspar.plans import _sql as S
from findspar.plans.texts import docs


def questions(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def _posted(spark, sf, collection: str | None = None, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    only = None if asked is None else search.asked_tokens(asked)
    tokens = search.tokenised(docs(spark, sf), "doc_id", "text", None if collection is None else F.col(collection), only)
    return search.postings(tokens), search.corpus_statistics(tokens)


def _sparse(spark, sf, collection: str | None = None) -> DataFrame:
    asked = questions(spark, sf)
    return search.sparse(asked, *_posted(spark, sf, collection, asked), by_collection=collection is not None)


def _dense(spark, sf) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = questions(spark, sf).join(v, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vector"))
    return search.dense(asked, v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")))


def _scored(ranked: DataFrame, *more: str) -> DataFrame:
    return ranked.select("query_id", *more, "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def bm25_stats(spark, sf):
    posted, stats = _posted(spark, sf)
    return search.document_frequency(posted).join(stats, "collection").select("token", "df", F.round(search.idf(F.col("n"), F.col("df")), 6).alias("idf"), F.round("mean_length", 6).alias("mean_length"))


def sparse_topk(spark, sf):
    return _scored(_sparse(spark, sf))


def sparse_topk_collection(spark, sf):
    return _scored(_sparse(spark, sf, "lang"), "collection")


def dense_topk(spark, sf):
    return _scored(_dense(spark, sf))


def dense_topk_collection(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("collection", F.col("label"))
    asked = questions(spark, sf).join(v, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vector"), "collection")
    return _scored(search.dense(asked, v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "collection")))


def _fused(spark, sf, **lists: DataFrame) -> DataFrame:
    names = tuple(lists)
    weights = search.WEIGHTS if len(names) > 1 else {names[0]: 1.0}
    return search.fuse(lists, weights)


def _fused_rows(fused: DataFrame, *names: str) -> DataFrame:
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), *[F.col(f"{n}_rank").cast("bigint").alias(f"{n}_rank") for n in names], F.col("fused_rank").cast("bigint").alias("fused_rank"))


def rrf_hybrid(spark, sf):
    return _fused_rows(_fused(spark, sf, dense=_dense(spark, sf), sparse=_sparse(spark, sf)), "dense", "sparse")


def rrf_dense_only(spark, sf):
    return _fused_rows(_fused(spark, sf, dense=_dense(spark, sf)), "dense")


def rrf_sparse_only(spark, sf):
    return _fused_rows(_fused(spark, sf, sparse=_sparse(spark, sf)), "sparse")


def _hits(spark, sf) -> DataFrame:
    fused = _fused(spark, sf, dense=_dense(spark, sf), sparse=_sparse(spark, sf))
    texts = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("passage"))
    return fused.join(texts, "chunk_id").join(questions(spark, sf).withColumnRenamed("text", "question"), "query_id")


def rerank_topn(spark, sf):
    r = search.rerank(_hits(spark, sf))
    return r.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("bigint").alias("rank"))


def hybrid_degraded(spark, sf):
    """Hybrid search while no vectors are to be had: keywords alone, reranked, and said so."""
    passages = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("passage"))
    found = search.hybrid(questions(spark, sf), None, _sparse(spark, sf), passages)
    return found.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("bigint").alias("rank"), F.array_join("degraded", ",").alias("degraded"))


def _halves(q: DataFrame) -> DataFrame:
    """Each question's two halves as its rewritten queries."""
    words = F.split("text", " ")
    half = F.floor(F.size(words) / 2).cast("int")
    parts = F.array(F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "))
    return q.select("query_id", F.posexplode(parts).alias("part", "query")).select("query_id", F.col("part"), "query")


WEAK = 6.0


def search_rewritten(spark, sf):
    """Keyword search and reranking; questions whose best hit is below WEAK are searched again by their halves, but every fifth has no rewrite."""
    tokens = search.tokenised(docs(spark, sf), "doc_id", "text", None, search.asked_tokens(questions(spark, sf)))
    posted, stats = search.postings(tokens), search.corpus_statistics(tokens)
    passages = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("passage"))

    def retrieve(asked: DataFrame) -> DataFrame:
        return search.hybrid(asked, None, search.sparse(asked, posted, stats), passages)

    found = search.searched(questions(spark, sf), retrieve, lambda q: _halves(q.where("query_id % 5 <> 0")), WEAK)
    return found.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("bigint").alias("rank"), F.array_join("degraded", ",").alias("degraded"), F.size("queries").cast("bigint").alias("queries"))


def question_problems(spark, sf):
    """Conversation turns as questions, some blank by rule."""
    t = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("text", F.when(F.col("turn") % 9 == 8, F.lit("  ")).when(F.col("turn") % 7 == 6, F.lit(None)).when(F.col("turn") % 5 == 4, F.repeat("text", 20)).otherwise(F.col("text")))
    return t.select("conv_id", "turn", search.problem(F.col("text")).alias("problem")).where("problem is not null")


def merge_rewritten(spark, sf):
    """Each question's two halves as rewritten queries; their hits scored against the whole question."""
    q = questions(spark, sf)
    words = F.split("text", " ")
    half = F.floor(F.size(words) / 2).cast("int")
    parts = q.select("query_id", F.lit(0).alias("part"), F.array_join(F.slice(words, F.lit(1), half), " ").alias("text")).union(q.select("query_id", F.lit(1), F.array_join(F.slice(words, half + 1, F.size(words)), " "))).union(q.select("query_id", F.lit(2), "text"))
    asked = parts.select((F.col("query_id") * 3 + F.col("part")).alias("query_id"), "text")
    ranked = search.sparse(asked, *_posted(spark, sf, None, asked)).select(F.floor(F.col("query_id") / 3).alias("query_id"), (F.col("query_id") % 3).alias("part"), "chunk_id", "rank", F.col("score").alias("rerank_score"))
    merged = search.merge_rewritten(ranked.withColumn("is_original", F.col("part") == 2))
    return merged.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("score"), "leads", F.col("rank").cast("bigint").alias("rank"))


def passages_confidence(spark, sf):
    hits = search.rerank(_hits(spark, sf)).withColumn("dense_score", F.col("dense_score"))
    c = search.passages_confidence(hits.select("query_id", "rank", "rerank_score", "dense_score"))
    return c.select("query_id", F.round("relevance", 6).alias("relevance"), "signal")


def _evidence(spark, sf) -> DataFrame:
    """Each question's own text is the quote that its hits are searched for."""
    ranked = _sparse(spark, sf)
    texts = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "source", "text")
    evidence = questions(spark, sf).select("query_id", F.lit(0).alias("evidence_no"), F.lit(None).cast("string").alias("source"), F.col("text").alias("quote"))
    return evaluation.evidence_rank(evidence, ranked.join(texts, "chunk_id").select("query_id", "rank", "source", "text"))


def evidence_rank(spark, sf):
    return _evidence(spark, sf).select("query_id", F.col("evidence_rank").cast("bigint").alias("evidence_rank"))


def retrieval_metrics(spark, sf):
    return evaluation.retrieval_metrics(_evidence(spark, sf))


def leakage_pairs(spark, sf):
    return evaluation.leaks(questions(spark, sf), 0.11)


def absence_check(spark, sf):
    """Three-word openings of the benchmark's texts, pieces from within their second words, and signs, that no document holds."""
    words = F.split("text", " ")
    terms = questions(spark, sf).select(F.explode(F.array(F.array_join(F.slice(words, 1, 3), " "), F.substring(F.get(words, F.lit(1)), 2, 4), F.lit("++"), F.lit("%%"))).alias("term"))
    return evaluation.absent_terms(terms, docs(spark, sf))


QUERIES = {f.__name__: f for f in (bm25_stats, sparse_topk, sparse_topk_collection, dense_topk, dense_topk_collection, rrf_hybrid, rrf_dense_only, rrf_sparse_only, rerank_topn, hybrid_degraded, search_rewritten, question_problems, merge_rewritten, passages_confidence, evidence_rank, retrieval_metrics, leakage_pairs, absence_check)}

BOTH = S.SPARSE + "," + S.DENSE + "," + S.fused(("dense", 0.7), ("sparse", 0.3))
OVERLAP = f"""
bag AS (SELECT doc_id, list_distinct({S.words("text")}) AS w, text FROM documents),
ask AS (SELECT item_id AS query_id, list_distinct({S.words("text")}) AS w FROM benchmark),
marked AS (SELECT f.query_id, f.chunk_id, f.fused_rank, 12.0::DOUBLE * len(list_intersect(a.w, b.w)) / greatest(len(a.w), 1) - 6.0 AS rerank_score FROM fused f JOIN bag b ON b.doc_id = f.chunk_id JOIN ask a USING (query_id)),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, fused_rank) AS rank FROM marked) WHERE rank <= 5)
"""
SPACED = "' ' || array_to_string({0}, ' ') || ' '"
EVIDENCE = f"""
quotes AS (SELECT item_id AS query_id, list_filter(list_transform(string_split_regex(regexp_replace({S.folded("text")}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\.\\.\\.|…'), lambda p: array_to_string(regexp_extract_all(p, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+'), ' ')), lambda p: p <> '') AS parts FROM benchmark),
held AS (SELECT s.query_id, s.rank, {SPACED.format(S.words("d.text"))} AS w FROM sparse s JOIN documents d ON d.doc_id = s.chunk_id),
found AS (SELECT h.query_id, min(h.rank) AS rank FROM held h JOIN quotes q USING (query_id) WHERE len(q.parts) > 0 AND len(list_filter(q.parts, lambda p: NOT contains(h.w, ' ' || p || ' '))) = 0 GROUP BY h.query_id),
ranked AS (SELECT b.item_id AS query_id, f.rank AS evidence_rank FROM benchmark b LEFT JOIN found f ON f.query_id = b.item_id)
"""
SQL = {
    "bm25_stats": f"WITH {S.SPARSE} SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(mean, 6) AS mean_length FROM freq, stats",
    "sparse_topk": f"WITH {S.SPARSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse",
    "sparse_topk_collection": f"""WITH {S.POSTINGS},
        stats AS (SELECT lang, count(*) AS n, avg(len(w)) AS mean FROM toks GROUP BY lang), freq AS (SELECT lang, token, count(*) AS df FROM post GROUP BY ALL),
        scored AS (SELECT query_id, post.lang AS collection, post.doc_id AS chunk_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
                   FROM asked JOIN post USING (token) JOIN freq ON freq.token = post.token AND freq.lang = post.lang JOIN stats ON stats.lang = post.lang GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored)
        SELECT query_id, collection, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "dense_topk": f"WITH {S.DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense",
    "dense_topk_collection": """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        n AS (SELECT q.vec_id AS query_id, u.vec_id AS chunk_id, list_cosine_similarity(q.v, u.v) AS score FROM benchmark b JOIN u q ON q.vec_id = b.item_id JOIN u ON u.label = q.label),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM n) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "rrf_hybrid": f"WITH {BOTH} SELECT query_id, chunk_id, round(score, 9) AS score, dense_rank, sparse_rank, fused_rank FROM fused",
    "rrf_dense_only": f"WITH {S.DENSE},{S.fused(('dense', 1.0))} SELECT query_id, chunk_id, round(score, 9) AS score, dense_rank, fused_rank FROM fused",
    "rrf_sparse_only": f"WITH {S.SPARSE},{S.fused(('sparse', 1.0))} SELECT query_id, chunk_id, round(score, 9) AS score, sparse_rank, fused_rank FROM fused",
    "rerank_topn": f"WITH {BOTH},{OVERLAP} SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, rank FROM reranked",
    "hybrid_degraded": f"WITH {S.SPARSE},{S.fused(('sparse', 0.3))},{OVERLAP} SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, rank, 'dense_search_unavailable' AS degraded FROM reranked",
    "question_problems": """SELECT conv_id, turn, CASE WHEN turn % 9 = 8 OR turn % 7 = 6 THEN 'empty query' ELSE 'query too long' END AS problem FROM conversations
        WHERE turn % 9 = 8 OR turn % 7 = 6 OR length(CASE WHEN turn % 5 = 4 THEN repeat(text, 20) ELSE text END) > 2000""",
    "search_rewritten": "WITH " + S.SPARSE.split("asked AS")[0] + f"""
        halves AS (SELECT item_id, string_split(text, ' ') AS w, text FROM benchmark),
        queries AS (SELECT item_id, 0 AS part, array_to_string(w[1 : len(w) // 2], ' ') AS t FROM halves UNION ALL SELECT item_id, 1, array_to_string(w[len(w) // 2 + 1 :], ' ') FROM halves UNION ALL SELECT item_id, 2, text FROM halves),
        asked AS (SELECT item_id, part, token, count(*) AS times FROM (SELECT item_id, part, unnest({S.tokens("t")}) AS token FROM queries) GROUP BY ALL),
        stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks), freq AS (SELECT token, count(*) AS df FROM post GROUP BY token),
        scored AS (SELECT item_id, part, post.doc_id AS chunk_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM asked JOIN post USING (token) JOIN freq USING (token), stats GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id, part ORDER BY round(score, 9) DESC, chunk_id) AS fused_rank FROM scored),
        bag AS (SELECT doc_id, list_distinct({S.words("text")}) AS w FROM documents), ask AS (SELECT item_id, part, list_distinct({S.words("t")}) AS w FROM queries),
        marked AS (SELECT r.item_id, r.part, r.chunk_id, r.fused_rank, 12.0::DOUBLE * len(list_intersect(ask.w, bag.w)) / greatest(len(ask.w), 1) - 6.0 AS x FROM r JOIN bag ON bag.doc_id = r.chunk_id JOIN ask ON ask.item_id = r.item_id AND ask.part = r.part WHERE fused_rank <= 10),
        reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, part ORDER BY round(x, 9) DESC, fused_rank) AS rank FROM marked) WHERE rank <= 5),
        weak AS (SELECT item_id FROM reranked WHERE part = 2 AND rank = 1 AND x < {WEAK}),
        m AS (SELECT item_id, chunk_id, max(x) AS x, bool_or(rank = 1 AND part < 2) AS leads FROM reranked WHERE item_id IN (SELECT item_id FROM weak) AND item_id % 5 <> 0 GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY leads DESC, round(x, 9) DESC, chunk_id) AS rank FROM m)
        SELECT item_id AS query_id, chunk_id, round(x, 6) AS rerank_score, rank, 'dense_search_unavailable' AS degraded, 2 AS queries FROM o WHERE rank <= 5
        UNION ALL SELECT item_id, chunk_id, round(x, 6), rank, 'dense_search_unavailable' || CASE WHEN item_id IN (SELECT item_id FROM weak) THEN ',query_rewrite_failed' ELSE '' END, 0 FROM reranked
        WHERE part = 2 AND (item_id NOT IN (SELECT item_id FROM weak) OR item_id % 5 = 0)""",
    "merge_rewritten": "WITH " + S.SPARSE.split("asked AS")[0] + f"""
        halves AS (SELECT item_id, string_split(text, ' ') AS w, text FROM benchmark),
        queries AS (SELECT item_id, 0 AS part, array_to_string(w[1 : len(w) // 2], ' ') AS t FROM halves UNION ALL SELECT item_id, 1, array_to_string(w[len(w) // 2 + 1 :], ' ') FROM halves UNION ALL SELECT item_id, 2, text FROM halves),
        asked AS (SELECT item_id, part, token, count(*) AS times FROM (SELECT item_id, part, unnest({S.tokens("t")}) AS token FROM queries) GROUP BY ALL),
        stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks), freq AS (SELECT token, count(*) AS df FROM post GROUP BY token),
        scored AS (SELECT item_id, part, post.doc_id AS chunk_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM asked JOIN post USING (token) JOIN freq USING (token), stats GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id, part ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored),
        m AS (SELECT item_id AS query_id, chunk_id, max(score) AS score, bool_or(rank = 1 AND part < 2) AS leads FROM r WHERE rank <= 10 GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY leads DESC, round(score, 9) DESC, chunk_id) AS rank FROM m)
        SELECT query_id, chunk_id, round(score, 6) AS score, leads, rank FROM o WHERE rank <= 5""",
    "passages_confidence": f"WITH {BOTH},{OVERLAP} SELECT query_id, round(1 / (1 + exp(-(rerank_score + 3.0) / 1.4)), 6) AS relevance, 'rerank' AS signal FROM reranked WHERE rank = 1",
    "evidence_rank": f"WITH {S.SPARSE},{EVIDENCE} SELECT query_id, evidence_rank FROM ranked",
    "retrieval_metrics": f"""WITH {S.SPARSE},{EVIDENCE} SELECT count(*) AS questions, round(avg((coalesce(evidence_rank, 99) <= 5)::INT), 4) AS recall_at_5, round(avg((coalesce(evidence_rank, 99) <= 5)::INT), 4) AS hit_at_5,
        round(avg((coalesce(evidence_rank, 99) <= 5)::INT), 4) AS all_at_5, round(avg((coalesce(evidence_rank, 99) <= 20)::INT), 4) AS recall_at_20, round(avg(coalesce(1.0::DOUBLE / evidence_rank, 0)), 4) AS mrr FROM ranked""",
    "leakage_pairs": f"""WITH w AS (SELECT item_id, list_distinct({S.words("text")}) AS w FROM benchmark), p AS (SELECT a.item_id AS id_a, b.item_id AS id_b, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS na, len(b.w) AS nb FROM w a JOIN w b ON a.item_id < b.item_id)
        SELECT id_a, id_b, round(k::DOUBLE / (na + nb - k), 4) AS similarity FROM p WHERE k::DOUBLE / (na + nb - k) >= 0.11""",
    "absence_check": "WITH t AS (SELECT DISTINCT unnest([array_to_string(string_split(text, ' ')[1 : 3], ' '), substr(string_split(text, ' ')[2], 2, 4), '++', '%%']) AS term FROM benchmark) SELECT term FROM t WHERE term IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(t.term)))",
}
