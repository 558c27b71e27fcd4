"""Queries over events: limits, answer cache, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspar.operators import limits
from findspar.plans.texts import docs

PER_HOUR, PER_DAY = 2, 300
NOW = "2024-01-15 12:00:00"


def events(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def visitor_rate_limit(spark, sf):
    return limits.visitor_counts(events(spark, sf), PER_HOUR).select("event_id", F.col("recent").cast("bigint").alias("recent"), "over")


def daily_limit(spark, sf):
    return limits.daily_counts(events(spark, sf), PER_DAY)


def limiter_admission(spark, sf):
    return limits.admit(events(spark, sf), PER_HOUR)


def answer_cache_hits(spark, sf):
    """Events as questions: the same type by the same user is the same question."""
    day = 86_400
    return limits.cache_hits(events(spark, sf), ["user_id", "event_type"], day).select("event_id", "hit")


def live_uploads(spark, sf):
    e = events(spark, sf).select(F.col("event_id").alias("upload_id"), F.col("user_id").alias("visitor"), "ts")
    return limits.live_uploads(e, F.lit(NOW).cast("timestamp"), ttl=6 * 3600, per_visitor=1)


def upload_status(spark, sf):
    suffix = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".PDF").when(F.col("lang") == "fr", ".docx").otherwise(".txt")
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("upload-"), F.col("doc_id").cast("string"), suffix).alias("name"), F.octet_length("text").alias("size"), F.when(F.col("lang") == "de", F.ceil(F.length("text") / 200)).cast("int").alias("pages"), F.floor(F.length("text") / 10).cast("int").alias("chunks"))
    return limits.upload_status(d).select("doc_id", "status")


QUERIES = {f.__name__: f for f in (visitor_rate_limit, daily_limit, limiter_admission, answer_cache_hits, live_uploads, upload_status)}

SQL = {
    "visitor_rate_limit": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), c AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS recent FROM e)
        SELECT event_id, recent, recent >= 2 AS over FROM c""",
    "daily_limit": """WITH s AS (SELECT epoch_us(ts) // 300000000 AS slot, count(*) AS n FROM events GROUP BY 1), w AS (SELECT slot, n, sum(n) OVER (ORDER BY slot RANGE BETWEEN 287 PRECEDING AND CURRENT ROW)::BIGINT AS last_day FROM s)
        SELECT *, last_day >= 300 AS over FROM w""",
    "limiter_admission": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        w AS (SELECT user_id, n, event_id, true AS admitted, CAST(NULL AS BIGINT) AS retry_after, [t] AS taken FROM e WHERE n = 1
            UNION ALL
            SELECT user_id, n, event_id, len(live) < 2, CASE WHEN len(live) >= 2 THEN (live[1] + 3600000000 - t) // 1000000 + 1 END, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END
            FROM (SELECT e.user_id, e.n, e.event_id, e.t, list_filter(w.taken, lambda x: x > e.t - 3600000000) AS live FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
        SELECT event_id, admitted, retry_after FROM w""",
    "answer_cache_hits": """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events),
        m AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY ALL UNION ALL SELECT e.user_id, e.event_type, min(e.t) FROM m JOIN e ON e.user_id = m.user_id AND e.event_type = m.event_type AND e.t > m.t + 86400000000 GROUP BY e.user_id, e.event_type),
        f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, t ORDER BY event_id) AS n FROM e)
        SELECT event_id, NOT (n = 1 AND m.t IS NOT NULL) AS hit FROM f LEFT JOIN m ON m.user_id = f.user_id AND m.event_type = f.event_type AND m.t = f.t""",
    "live_uploads": f"""WITH f AS (SELECT event_id AS upload_id, user_id AS visitor, ts FROM events WHERE ts <= TIMESTAMP '{NOW}' AND ts > TIMESTAMP '{NOW}' - INTERVAL 6 HOUR),
        u AS (SELECT *, row_number() OVER (PARTITION BY visitor ORDER BY ts DESC, upload_id DESC) AS n FROM f) SELECT upload_id, visitor, ts FROM u WHERE n <= 1 ORDER BY ts DESC, upload_id DESC LIMIT 20""",
    "upload_status": """SELECT doc_id, CASE WHEN lang = 'fr' THEN 415 WHEN octet_length(encode(text)) > 5242880 THEN 413 WHEN lang = 'de' AND ceil(length(text) / 200) > 50 THEN 422 WHEN length(text) // 10 = 0 THEN 422 WHEN length(text) // 10 > 400 THEN 413 ELSE 201 END AS status FROM documents""",
}
