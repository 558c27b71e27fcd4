"""Replies of models as data: parsing, grading, usage, retries.

A reply is a string column.  What doesn't parse, or lacks an entry, becomes an
error row and never counts as support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findspar.functions import text as T

VERDICTS = ("supported", "partial", "unsupported")
CHECKS = "checks array<struct<id:int,quote:string,verdict:string,reason:string>>"
PARTS = "parts array<struct<part:string,status:string>>"
QUERIES = "queries array<string>"


def judgements(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """(answer_id, call, id, verdict, quote_found) for every pair that was asked about.

    calls (answer_id, call, reply); pairs (answer_id, call, id, passage).  The first
    entry of an id counts.  A verdict whose quote isn't in the passage is `unverified`.
    """
    items = calls.select("answer_id", "call", F.posexplode(F.from_json("reply", CHECKS)["checks"]).alias("pos", "c")).select("answer_id", "call", "pos", "c.id", "c.verdict", "c.quote")
    first = items.where("id is not null").groupBy("answer_id", "call", "id").agg(F.min_by(F.struct("verdict", "quote"), "pos").alias("c"))
    joined = pairs.join(first, ["answer_id", "call", "id"], "left")
    found = T.quote_in_passage(F.coalesce("c.quote", F.lit("")), T.spaced_words(F.col("passage")))
    verdict = F.when(F.coalesce(~F.col("c.verdict").isin(*VERDICTS), F.lit(True)), "error").when(F.col("c.verdict").isin("supported", "partial") & ~found, "unverified").otherwise(F.col("c.verdict"))
    return joined.select("answer_id", "call", "id", verdict.alias("verdict"), (found & F.col("c").isNotNull()).alias("quote_found"))


def completeness(replies: DataFrame) -> DataFrame:
    """(answer_id, completeness, missing_part, incomplete): the share of parts answered; an unreadable reply counts as missing."""
    parts = F.coalesce(F.from_json("reply", PARTS)["parts"], F.array().cast("array<struct<part:string,status:string>>"))
    rows = replies.select("answer_id", parts.alias("p"))
    n = F.size("p")

    def having(status: str) -> Column:
        return F.size(F.filter("p", lambda x: x["status"] == status))

    missing = (n == 0) | (having("missing") > 0)
    return rows.select("answer_id", F.when(n > 0, having("answered") / n).otherwise(F.lit(0.0)).alias("completeness"), missing.alias("missing_part"), (~missing & (having("not_covered") > 0)).alias("incomplete"))


def rewrites(replies: DataFrame) -> DataFrame:
    """(query_id, part, query) of rewriting replies; unreadable ones give nothing."""
    return replies.select("query_id", F.posexplode(F.from_json("reply", QUERIES)["queries"]).alias("part", "query"))


def faithfulness(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(answer_id, faithfulness): supported claims' share of all but gaps.

    claims (answer_id, claim_no, kind, verified); verdicts (answer_id, claim_no,
    verdict).  Verified claims count without being judged again; null if every
    judged claim is an error, or nothing is claimed.
    """
    rows = claims.where("kind <> 'gap'").join(verdicts, ["answer_id", "claim_no"], "left")
    ok = F.col("verified") | F.coalesce(F.col("verdict") == "supported", F.lit(False))
    judged = F.count_if(~F.col("verified"))
    failed = F.count_if(~F.col("verified") & (F.coalesce("verdict", F.lit("error")) == "error"))
    return rows.groupBy("answer_id").agg(F.when((judged == 0) | (failed < judged), F.avg(ok.cast("double"))).alias("faithfulness"))


def behaviour(answers: DataFrame) -> DataFrame:
    """(query_id, acceptable) for questions that should be refused or clarified: a refusal passes unasked, else the grader's reply decides; null if it failed."""
    graded = F.from_json("reply", "acceptable boolean, reason string")["acceptable"]
    refused = (F.col("expected") == "not_found") & (F.col("status") == "not_found")
    return answers.select("query_id", F.when(refused, True).otherwise(graded).alias("acceptable"))


def review(reviews: DataFrame) -> DataFrame:
    """How often people agreed with the grader: (verdict, n, share)."""
    counts = reviews.groupBy("verdict").agg(F.count("*").alias("n"))
    return counts.crossJoin(reviews.agg(F.count("*").alias("total"))).select("verdict", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def usage(calls: DataFrame) -> DataFrame:
    """Requests and tokens per model: (model, requests, tokens)."""
    return calls.groupBy("model").agg(F.count("*").alias("requests"), F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"))


def redacted(text: Column) -> Column:
    """A provider's error text without account ids, and of bounded length."""
    return F.substring(F.regexp_replace(text, r"\b(?:org|user|key|req|proj)[_-][A-Za-z0-9]{6,}\b", "[id]"), 1, 300)


def daily_limit(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)per day|daily|\b[TR]PD\b"), F.lit(False))


def retry_wait(status: Column, attempt: Column, header: Column) -> Column:
    """Seconds to wait before the next attempt: what the server says, at most 60, else doubling, from 5 if it limits the rate and from 1 otherwise."""
    return F.when(header.isNotNull(), F.least(header, F.lit(60.0))).otherwise(F.when(status == 429, F.lit(5.0)).otherwise(F.lit(1.0)) * F.pow(F.lit(2.0), attempt))


def described(rank: Column, score: Column, source: Column, heading: Column, text: Column) -> Column:
    """One line that shows a hit."""
    return F.format_string("%d. %.3f  %s  [%s]  %s", rank, score, source, heading, F.substring(F.regexp_replace(text, r"\s+", " "), 1, 80))
