"""Queries over model replies and stored vectors; replies follow from ids by rule, since the data hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspar.functions import text as T
from findspar.operators import index, replies, search
from findspar.plans import _sql as S
from findspar.plans.texts import docs


def _labels(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def judge_replies(spark, sf):
    """One call per conversation: it is asked about each turn, and its reply quotes the turn, or leaves it out, by rule."""
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    pairs = t.select(F.col("conv_id").alias("answer_id"), F.lit(0).alias("call"), F.col("turn").cast("int").alias("id"), F.col("text").alias("passage"))
    item = F.struct(
        F.col("turn").cast("int").alias("id"), F.when(F.col("turn") % 3 == 1, F.lit("made up entirely")).otherwise(F.element_at(F.split("text", " "), 1)).alias("quote"),
        F.when(F.col("turn") % 5 == 4, F.lit("maybe")).when(F.col("turn") % 2 == 0, F.lit("supported")).otherwise(F.lit("unsupported")).alias("verdict"), F.lit("r").alias("reason"),
    )
    calls = t.where("turn % 7 <> 6").groupBy(F.col("conv_id").alias("answer_id")).agg(F.to_json(F.struct(F.collect_list(item).alias("checks"))).alias("reply"))
    calls = calls.select("answer_id", F.lit(0).alias("call"), F.when(F.col("answer_id") % 13 == 12, F.substring("reply", 1, 20)).otherwise(F.col("reply")).alias("reply"))
    return replies.judgements(calls, pairs).groupBy("answer_id", "verdict").agg(F.count("*").alias("n"), F.count_if("quote_found").alias("quotes_found"))


def completeness(spark, sf):
    status = F.element_at(F.array(F.lit("answered"), F.lit("not_covered"), F.lit("missing")), (F.col("doc_id") % 3 + 1).cast("int"))
    reply = F.format_string('{"parts": [{"part": "a", "status": "answered"}, {"part": "b", "status": "%s"}]}', status)
    rows = _labels(spark, sf).select(F.col("doc_id").alias("answer_id"), F.when(F.col("doc_id") % 10 == 9, F.lit("no json")).otherwise(reply).alias("reply"))
    return replies.completeness(rows)


def faithfulness(spark, sf):
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    claims = t.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim_no"), F.when(F.col("turn") % 6 == 5, "gap").otherwise("cited").alias("kind"), (F.col("turn") % 4 == 0).alias("verified"))
    verdict = F.when(F.col("conv_id") % 5 == 0, "error").when((F.col("conv_id") + F.col("turn")) % 3 == 0, "unsupported").otherwise("supported")
    verdicts = t.where("turn % 4 <> 0 and turn % 6 <> 5").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim_no"), verdict.alias("verdict"))
    return replies.faithfulness(claims, verdicts).withColumn("faithfulness", F.round("faithfulness", 6))


def behaviour(spark, sf):
    d = F.col("doc_id")
    rows = _labels(spark, sf).select(
        d.alias("query_id"), F.when(d % 2 == 0, "not_found").otherwise("clarify_or_cover").alias("expected"), F.when(d % 3 == 0, "not_found").otherwise("answered").alias("status"),
        F.when(d % 7 == 0, "?").otherwise(F.when(F.col("quality") == 1, F.lit('{"acceptable": true}')).otherwise(F.lit('{"acceptable": false}'))).alias("reply"),
    )
    return replies.behaviour(rows)


def grader_review(spark, sf):
    return replies.review(_labels(spark, sf).select(F.when(F.col("quality") == 1, "agree").when(F.col("toxic") == 1, "disagree").otherwise("unsure").alias("verdict")))


def usage_totals(spark, sf):
    """Conversation turns as model calls."""
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    return replies.usage(t.select(F.col("role").alias("model"), F.length("text").alias("prompt_tokens"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("completion_tokens")))


def retry_waits(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    status = F.when(F.col("event_id") % 3 == 0, 429).otherwise(503)
    wait = replies.retry_wait(status, F.col("event_id") % 5, F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 100).cast("double")))
    said = F.concat(F.lit("limit for org_abc12345 reached"), F.when(F.col("event_id") % 2 == 0, F.lit(" (tokens per day)")).otherwise(F.lit("")))
    return e.select("event_id", wait.alias("wait"), replies.redacted(said).alias("said"), replies.daily_limit(said).alias("daily"))


def stored_vectors(spark, sf):
    """English documents' vectors are cached by text, the others are stored by id."""
    key = T.cache_key("model-1", F.col("text"))
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    d = docs(spark, sf)
    cache = d.where("lang = 'en'").join(v, F.col("doc_id") == F.col("vec_id")).groupBy(key.alias("key")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    found = index.stored_vectors(d.select(F.col("doc_id").alias("chunk_id"), "text"), cache, v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), key)
    return found.select("chunk_id", "origin", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


def also_appears_in(spark, sf):
    """Documents that repeat the text of an earlier one that is shown (all but one source's), by that document."""
    d = docs(spark, sf).select("doc_id", "source", F.md5(F.encode("text", "UTF-8")).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("duplicate_of"))
    copies = d.join(first, "h").where("doc_id <> duplicate_of").select("duplicate_of", "doc_id", "source")
    return index.also_appears_in(copies, d.where("source <> 'src0'").select(F.col("doc_id").alias("chunk_id")))


def rewrite_trigger(spark, sf):
    """Benchmark questions whose best hit by words is weak."""
    from findspar.plans import retrieval as R

    return search.to_rewrite(search.rerank(R._hits(spark, sf)), 0.0)


QUERIES = {f.__name__: f for f in (judge_replies, completeness, faithfulness, behaviour, grader_review, usage_totals, retry_waits, stored_vectors, also_appears_in, rewrite_trigger)}


def _rewrite_sql() -> str:
    from findspar.plans import retrieval as R

    return f"WITH {R.BOTH},{R.OVERLAP} SELECT query_id FROM reranked WHERE rank = 1 AND rerank_score < 0"


SQL = {
    "judge_replies": rf"""WITH p AS (SELECT conv_id, turn, {S.words("text")} AS w, {S.words("string_split(text, ' ')[1]")} AS q, turn % 7 <> 6 AND conv_id % 13 <> 12 AS replied FROM conversations),
        f AS (SELECT *, replied AND turn % 3 <> 1 AND len(q) > 0 AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') AS found FROM p),
        v AS (SELECT conv_id, found, CASE WHEN NOT replied OR turn % 5 = 4 THEN 'error' WHEN turn % 2 = 0 THEN CASE WHEN found THEN 'supported' ELSE 'unverified' END ELSE 'unsupported' END AS verdict FROM f)
        SELECT conv_id AS answer_id, verdict, count(*) AS n, count(*) FILTER (found) AS quotes_found FROM v GROUP BY ALL""",
    "completeness": """SELECT doc_id AS answer_id, CASE WHEN doc_id % 10 = 9 THEN 0.0::DOUBLE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.5 END AS completeness, doc_id % 10 = 9 OR doc_id % 3 = 2 AS missing_part, doc_id % 10 <> 9 AND doc_id % 3 = 1 AS incomplete FROM labels""",
    "faithfulness": """WITH c AS (SELECT conv_id, turn % 4 = 0 AS verified, CASE WHEN conv_id % 5 = 0 THEN 'error' WHEN (conv_id + turn) % 3 = 0 THEN 'unsupported' ELSE 'supported' END AS v FROM conversations WHERE turn % 6 <> 5)
        SELECT conv_id AS answer_id, CASE WHEN count(*) FILTER (NOT verified) = 0 OR count(*) FILTER (NOT verified AND v = 'error') < count(*) FILTER (NOT verified) THEN round(avg((verified OR v = 'supported')::INT), 6) END AS faithfulness FROM c GROUP BY conv_id""",
    "behaviour": "SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN true WHEN doc_id % 7 = 0 THEN NULL ELSE quality = 1 END AS acceptable FROM labels",
    "grader_review": "SELECT CASE WHEN quality = 1 THEN 'agree' WHEN toxic = 1 THEN 'disagree' ELSE 'unsure' END AS verdict, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM labels), 4) AS share FROM labels GROUP BY 1",
    "usage_totals": "SELECT role AS model, count(*) AS requests, sum(length(text) + CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END)::BIGINT AS tokens FROM conversations GROUP BY role",
    "retry_waits": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(event_id % 100, 60)::DOUBLE ELSE CASE WHEN event_id % 3 = 0 THEN 5.0::DOUBLE ELSE 1.0 END * pow(2, event_id % 5) END AS wait,
        'limit for [id] reached' || CASE WHEN event_id % 2 = 0 THEN ' (tokens per day)' ELSE '' END AS said, event_id % 2 = 0 AS daily FROM events""",
    "stored_vectors": """WITH c AS (SELECT text, arg_min(embedding, vec_id) AS v FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang = 'en' GROUP BY text)
        SELECT doc_id AS chunk_id, CASE WHEN c.v IS NOT NULL THEN 'cache' WHEN e.embedding IS NOT NULL THEN 'store' ELSE 'missing' END AS origin, round(coalesce(c.v, e.embedding)[1]::DOUBLE, 6) AS first
        FROM documents d LEFT JOIN c ON c.text = d.text LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "also_appears_in": "SELECT duplicate_of, doc_id, source FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS duplicate_of FROM documents) WHERE doc_id <> duplicate_of AND duplicate_of IN (SELECT doc_id FROM documents WHERE source <> 'src0')",
    "rewrite_trigger": _rewrite_sql(),
}
