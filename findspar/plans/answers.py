"""Queries over answers: claims, verdicts, confidence, status, evaluation.

Conversations' assistant turns stand for answers, the other turns of a conversation
for their passages; citations and model outcomes follow from ids by rule, since the
data hold none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspar.functions import text as T
from findspar.operators import answers as A
from findspar.operators import evaluation
from findspar.plans import _sql as S
from findspar.plans.texts import docs


def turns(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def _answers(spark, sf) -> DataFrame:
    """Assistant turns; each sentence's end cites the turn before, every third one a passage that isn't there too."""
    t = turns(spark, sf).where("role = 'assistant'")
    cited = F.regexp_replace("text", r"\.(\s|$)", F.concat(F.lit(". ["), F.col("turn").cast("string"), F.when(F.col("turn") % 3 == 0, F.lit(", 99")).otherwise(F.lit("")), F.lit("]$1")))
    return t.select(F.format_string("%d-%d", "conv_id", "turn").alias("answer_id"), "conv_id", "turn", cited.alias("text"))


def parse_citations(spark, sf):
    c = _answers(spark, sf).withColumn("c", T.citations(F.col("text"), 20))
    return c.select("answer_id", F.array_join(F.transform("c.valid", lambda x: x.cast("string")), ",").alias("valid"), F.array_join(F.transform("c.invalid", lambda x: x.cast("string")), ",").alias("invalid"))


def claims_split(spark, sf):
    c = A.claims(_answers(spark, sf))
    return c.select("answer_id", "claim_no", "claim", F.array_join(F.transform("citations", lambda x: x.cast("string")), ",").alias("citations"), "kind")


def judge_batches(spark, sf):
    """Which judge call takes which claim and cited passage: eight pairs to a call."""
    pairs = _line_claims(spark, sf).select("answer_id", "claim_no", F.explode("citations").alias("n"))
    return A.batches(pairs).select("answer_id", "claim_no", "n", "call")


def _line_claims(spark, sf) -> DataFrame:
    """Each line of an answer as a claim that cites its own turn and the one before."""
    t = turns(spark, sf).where("role = 'assistant'")
    lines = t.select(F.format_string("%d-%d", "conv_id", "turn").alias("answer_id"), "turn", F.posexplode(F.split("text", "\n")).alias("claim_no", "claim")).where("trim(claim) <> ''")
    cites = F.when(F.col("claim_no") % 4 == 3, F.array().cast("array<int>")).otherwise(F.array(F.col("turn").cast("int"), F.when(F.col("claim_no") % 2 == 0, F.col("turn").cast("int") + 1).otherwise(99)))
    return lines.select("answer_id", "claim_no", "claim", cites.alias("citations"), F.when(F.col("claim_no") % 4 == 3, "uncited").otherwise("cited").alias("kind"))


def _passages(spark, sf) -> DataFrame:
    """A conversation's turns, numbered from 1, for each of its answers."""
    t = turns(spark, sf)
    a = t.where("role = 'assistant'").select("conv_id", F.format_string("%d-%d", "conv_id", "turn").alias("answer_id"))
    return a.join(t.select("conv_id", (F.col("turn") + 1).cast("int").alias("n"), "text"), "conv_id").select("answer_id", "n", "text")


def _verified(spark, sf) -> DataFrame:
    return A.verify(_line_claims(spark, sf), _passages(spark, sf))


def claim_status(spark, sf):
    return _verified(spark, sf).select("answer_id", "claim_no", "kind", "status")


def flagged_claims(spark, sf):
    return A.flagged(_verified(spark, sf)).select("answer_id", "claim_no", "status")


def claim_counts(spark, sf):
    return A.claim_counts(_verified(spark, sf)).withColumn("coverage", F.round("coverage", 6))


def quote_in_passage(spark, sf):
    """Whether a conversation's opening turn stands, word by word, in each of its turns."""
    t = turns(spark, sf)
    first = t.where("turn = 0").select("conv_id", F.col("text").alias("quote"))
    return t.join(first, "conv_id").select("conv_id", "turn", T.quote_in_passage(F.col("quote"), T.spaced_words(F.col("text"))).alias("found"))


def _outcomes(spark, sf) -> DataFrame:
    """Outcomes of checked answers, by rule from labels."""
    d, q = F.col("doc_id"), F.col("quality")
    rows = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    logit = (d % 13).cast("double") / 2 - 4 + q
    return rows.select(
        "doc_id", F.when(d % 5 > 0, logit).alias("logit"), F.when(d % 7 > 0, 0.7 + (d % 20) / 100.0).alias("dense"), ((d % 11) / 10.0).alias("coverage"), ((d % 3) / 2.0).alias("completeness"),
        (d % 8 == 0).cast("int").alias("unsupported"), (d % 6 == 0).cast("int").alias("partial"), (d % 9 == 0).cast("int").alias("unchecked"),
        (F.col("toxic") == 1).alias("ungrounded"), (d % 10 == 0).alias("truncated"), (d % 12 == 0).alias("missing_part"), (d % 4 == 0).alias("incomplete"),
        (d % 14 == 0).alias("insufficient"), F.when(d % 23 == 0, "timeout").alias("failed"), (d % 4 == 0).alias("not_covered"),
    ).withColumn("relevance", F.coalesce(A.search.relevance(F.col("logit"), F.col("dense")), F.lit(0.0))).withColumn("signal", F.when(F.col("logit").isNotNull(), "rerank").when(F.col("dense").isNotNull(), "dense").otherwise("none"))


def confidence_score(spark, sf):
    return A.confidence(_outcomes(spark, sf)).select("doc_id", "score", "level", F.array_join("flags", ",").alias("flags"))


def status_ladder(spark, sf):
    return A.status(_outcomes(spark, sf)).select("doc_id", "status", "code")


def _records(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    rows = spark.read.parquet(f"{sf}/labels.parquet").join(docs(spark, sf).select("doc_id", "source", "n_chars"), "doc_id")
    return rows.select(
        "source", F.when(F.col("toxic") == 1, "not_found").when(d % 13 == 0, "clarify_or_cover").otherwise("answer").alias("expected"), (d % 4 > 0).alias("shown"), (F.col("quality") == 1).alias("correct"), F.when(d % 3 > 0, (d % 10) / 10.0).alias("faithfulness"),
        (F.col("n_chars") / 1000.0).alias("seconds"), (d % 17 == 0).alias("error"), F.when(d % 2 == 0, F.col("n_chars").cast("double")).alias("tokens"), F.when(d % 5 > 0, d % 5 > 1).alias("acceptable"),
        F.when(d % 4 > 1, (d % 7) / 7.0).alias("fact_score"), F.when(d % 4 > 1, d % 7 == 3).alias("wrong_fact"), F.when(d % 6 > 0, (d % 6) / 6.0).alias("citation_accuracy"),
        (d % 3 + 1).alias("evidence"), (d % 3).alias("in5"), F.greatest(d % 3, F.lit(1)).alias("in20"),
    )


METRICS = ["evidence_recall_top5", "hit_top5", "fact_coverage", "wrong_fact_rate", "citation_accuracy", "ambiguous_handled", "answer_rate", "fully_correct", "faithfulness", "withheld_rate", "no_answer_handled", "seconds_p50", "seconds_p95"]


def eval_summary(spark, sf):
    return evaluation.summary(_records(spark, sf), ["source"])


def spread(spark, sf):
    """The sources as runs of one evaluation."""
    return evaluation.spread(evaluation.summary(_records(spark, sf), ["source"]), METRICS)


def _judged(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    label = F.when(F.col("quality") == 1, "supported").otherwise("unsupported")
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label.alias("label"), F.when(d % 9 == 0, "partial").when(d % 7 == 0, "supported").otherwise(label).alias("verdict"))


def judge_confusion(spark, sf):
    return evaluation.confusion(_judged(spark, sf))


def judge_errors(spark, sf):
    return evaluation.judge_errors(_judged(spark, sf))


def grade_facts(spark, sf):
    """Conversations as questions, their turns as key facts; two replies for some facts, none for others."""
    t = turns(spark, sf)
    facts = t.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("fact_id"))
    x = F.col("conv_id") * 7 + F.col("turn")
    status = F.when(x % 11 == 0, "contradicted").when(x % 4 == 0, "missing").otherwise("present")
    replies = t.where("turn % 5 <> 4").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("fact_id"), F.lit(0).alias("reply_no"), status.alias("status"))
    again = replies.where("fact_id % 2 = 0").withColumn("reply_no", F.lit(1)).withColumn("status", F.lit("contradicted"))
    wrong = t.select(F.col("conv_id").alias("query_id"), (F.col("conv_id") % 6 == 0).alias("extra_wrong")).distinct()
    return evaluation.grade_facts(facts, replies.union(again), wrong).withColumn("score", F.round("score", 6))


def grader_self_check(spark, sf):
    """Conversations' opening turns as reference answers, their first words as key facts; the grader looks for the words themselves."""
    t = turns(spark, sf).where("turn = 0")
    items = t.select(F.col("conv_id").alias("query_id"), F.col("text").alias("answer"), F.slice(F.split("text", " "), 1, 3).alias("facts"))
    return evaluation.grader_check(items, lambda answer, fact: F.when(F.contains(answer, fact), "present").otherwise("missing"))


def stratified_split(spark, sf):
    return evaluation.split(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "quality").select("doc_id", "quality", "split")


def seeded_sample(spark, sf):
    """Forty sections long enough to ask about."""
    long = docs(spark, sf).where(F.size(F.split(F.trim("text"), r"\s+")) >= 40)
    return evaluation.sampled(long.select("doc_id", "source"), "doc_id", 40)


def snapshot_diff(spark, sf):
    """Documents of two languages as the snapshot before, cleaned texts of two as the one after."""
    d = docs(spark, sf)
    before = d.where("lang in ('en', 'de')").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    after = d.where("lang in ('de', 'fr')").select("doc_id", F.md5(F.encode(T.clean(F.col("text")), "UTF-8")).alias("digest"))
    return evaluation.snapshot_diff(before, after, "doc_id", "digest")


QUERIES = {f.__name__: f for f in (parse_citations, claims_split, judge_batches, claim_status, flagged_claims, claim_counts, quote_in_passage, confidence_score, status_ladder, eval_summary, spread, judge_confusion, judge_errors, grade_facts, grader_self_check, stratified_split, seeded_sample, snapshot_diff)}

VERIFIED = f"""
a AS (SELECT conv_id || '-' || turn AS answer_id, conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE role = 'assistant'),
claims AS (SELECT * FROM (SELECT answer_id, conv_id, turn, unnest(l) AS claim, generate_subscripts(l, 1) - 1 AS claim_no FROM a) WHERE trim(claim) <> ''),
cited AS (SELECT *, unnest([turn, CASE WHEN claim_no % 2 = 0 THEN turn + 1 ELSE 99 END]) AS n FROM claims WHERE claim_no % 4 <> 3),
judged AS (SELECT c.*, t.text, len(list_intersect(list_distinct({S.words("claim")}), {S.words("t.text")})) / greatest(len(list_distinct({S.words("claim")})), 1) AS share FROM cited c LEFT JOIN conversations t ON t.conv_id = c.conv_id AND t.turn + 1 = c.n),
summed AS (SELECT answer_id, claim_no, any_value(claim) AS claim, bool_or(coalesce(share >= 1, false)) AS s, bool_or(coalesce(share >= 0.5 AND share < 1, false)) AS p, string_agg(text, chr(10) ORDER BY n) AS together FROM judged GROUP BY ALL),
again AS (SELECT *, len(list_intersect(list_distinct({S.words("claim")}), {S.words("together")})) / greatest(len(list_distinct({S.words("claim")})), 1) AS share FROM summed),
verified AS (SELECT c.answer_id, c.claim_no, CASE WHEN c.claim_no % 4 = 3 THEN 'uncited' ELSE 'cited' END AS kind,
    CASE WHEN c.claim_no % 4 = 3 THEN 'uncited' WHEN g.s THEN 'supported' WHEN g.p THEN CASE WHEN g.share >= 1 THEN 'supported' ELSE 'partial' END ELSE 'unsupported' END AS status
    FROM claims c LEFT JOIN again g USING (answer_id, claim_no))
"""
OUTCOMES = """
l AS (SELECT doc_id AS d, quality, toxic, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 13) / 2.0::DOUBLE - 4 + quality END AS logit, CASE WHEN doc_id % 7 > 0 THEN 0.7::DOUBLE + (doc_id % 20) / 100.0::DOUBLE END AS dense FROM labels),
o AS (SELECT *, coalesce(1 / (1 + exp(-(logit + 3.0) / 1.4)), 1 / (1 + exp(-(dense - 0.77) / 0.015)), 0) AS relevance, CASE WHEN logit IS NOT NULL THEN 'rerank' WHEN dense IS NOT NULL THEN 'dense' ELSE 'none' END AS signal FROM l)
"""
RECORDS = """
r AS (SELECT d.source, CASE WHEN toxic = 1 THEN 'not_found' WHEN doc_id % 13 = 0 THEN 'clarify_or_cover' ELSE 'answer' END AS expected, doc_id % 4 > 0 AS shown, quality = 1 AS correct, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS faithfulness,
    n_chars / 1000.0::DOUBLE AS seconds, doc_id % 17 = 0 AS error, CASE WHEN doc_id % 2 = 0 THEN n_chars::DOUBLE END AS tokens, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 > 1 END AS acceptable,
    CASE WHEN doc_id % 4 > 1 THEN (doc_id % 7) / 7.0::DOUBLE END AS fact_score, CASE WHEN doc_id % 4 > 1 THEN doc_id % 7 = 3 END AS wrong_fact, CASE WHEN doc_id % 6 > 0 THEN (doc_id % 6) / 6.0::DOUBLE END AS citation_accuracy,
    doc_id % 3 + 1 AS evidence, doc_id % 3 AS in5, greatest(doc_id % 3, 1) AS in20 FROM labels JOIN documents d USING (doc_id)),
summary AS (SELECT source, count(*) AS questions, count(*) FILTER (error) AS errors, round(sum(in5) FILTER (expected = 'answer') / sum(evidence) FILTER (expected = 'answer'), 3) AS evidence_recall_top5, round(sum(in20) FILTER (expected = 'answer') / sum(evidence) FILTER (expected = 'answer'), 3) AS evidence_recall_top20,
    round(avg((in5 > 0)::INT) FILTER (expected = 'answer'), 3) AS hit_top5, round(avg(fact_score) FILTER (expected = 'answer' AND shown), 3) AS fact_coverage, round(avg(wrong_fact::INT) FILTER (expected = 'answer' AND shown), 3) AS wrong_fact_rate,
    round(avg(citation_accuracy) FILTER (expected = 'answer' AND shown), 3) AS citation_accuracy, round(avg(acceptable::INT) FILTER (expected = 'clarify_or_cover'), 3) AS ambiguous_handled, round(avg(shown::INT) FILTER (expected = 'answer'), 3) AS answer_rate, round(avg((shown AND correct)::INT) FILTER (expected = 'answer'), 3) AS fully_correct,
    round(avg(faithfulness) FILTER (expected = 'answer' AND shown), 3) AS faithfulness, round(avg((NOT shown AND NOT error)::INT) FILTER (expected = 'answer'), 3) AS withheld_rate,
    count(*) FILTER (expected = 'answer' AND NOT shown AND NOT error AND correct) AS withheld_but_correct, round(avg(acceptable::INT) FILTER (expected = 'not_found'), 3) AS no_answer_handled, round(avg(tokens), 3) AS tokens_per_question,
    list_sort(list(seconds) FILTER (NOT error)) AS s FROM r GROUP BY source),
done AS (SELECT * EXCLUDE (s), s[len(s) // 2 + 1] AS seconds_p50, s[least(len(s), floor(len(s) * 0.95)::INT + 1)] AS seconds_p95 FROM summary)
"""
CLAIMS = r"""
a AS (SELECT conv_id || '-' || turn AS answer_id, regexp_replace(text, '\.(\s|$)', '. [' || turn || CASE WHEN turn % 3 = 0 THEN ', 99' ELSE '' END || ']\1', 'g') AS text FROM conversations WHERE role = 'assistant'),
drawn AS (SELECT answer_id, string_split_regex(regexp_replace(text, '([.!?])((?:[ \t]*\[\d+(?:\s*,\s*\d+)*\])+)', '\2\1', 'g'), '\r\n|[\n\r]') AS l FROM a),
lines AS (SELECT answer_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM drawn),
cut AS (SELECT answer_id, line_no, string_split(regexp_replace(regexp_replace(regexp_replace(line, '^\s*(?:[-*•]|\d+[.)])\s+', ''), '^\s+|\s+$', '', 'g'), '([.!?])\s+([A-Z0-9`*\[("''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM lines),
said AS (SELECT answer_id, line_no, at_, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM (SELECT answer_id, line_no, unnest(s) AS s, generate_subscripts(s, 1) AS at_ FROM cut)),
bared AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY line_no, at_) AS no, regexp_replace(regexp_replace(regexp_replace(s, '\[(\d+(?:\s*,\s*\d+)*)\]', '', 'g'), '^[ \t*]+|[ \t*]+$', '', 'g'), '\s+([.,;:!?])', '\1', 'g') AS bare,
    flatten(list_transform(regexp_extract_all(s, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: list_transform(string_split_regex(g, '\s*,\s*'), lambda x: x::INT))) AS numbers FROM said WHERE s <> ''),
numbered AS (SELECT *, regexp_matches(bare, '[\p{L}\p{M}\p{N}\p{Pc}]') AS worded, sum(regexp_matches(bare, '[\p{L}\p{M}\p{N}\p{Pc}]')::INT) OVER (PARTITION BY answer_id ORDER BY no) AS g FROM bared),
stated AS (SELECT answer_id, g, max(bare) FILTER (worded) AS bare, list_sort(list_distinct(flatten(list(numbers)))) AS numbers FROM numbered WHERE g > 0 GROUP BY ALL),
kinds AS (SELECT *, CASE WHEN len(numbers) > 0 THEN 'cited' WHEN regexp_matches(bare, '(?i)\b(documents?|passages?|sources?)\b[^.]*\b(do not|don''t|does not|doesn''t|did not|no)\b[^.]*\b(cover|mention|provide|contain|include|specify|say|state|information|details?)\b') THEN 'gap' ELSE 'uncited' END AS kind FROM stated),
ended AS (SELECT *, first_value(CASE WHEN kind <> 'uncited' THEN g END IGNORE NULLS) OVER later AS end_, first_value(CASE WHEN kind <> 'uncited' THEN kind END IGNORE NULLS) OVER later AS end_kind FROM kinds
    WINDOW later AS (PARTITION BY answer_id ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
merged AS (SELECT answer_id, CASE WHEN end_kind = 'cited' THEN end_ ELSE g END AS island, string_agg(bare, ' ' ORDER BY g) AS claim, arg_max(numbers, g) AS numbers, arg_max(kind, g) AS kind FROM ended GROUP BY ALL)
"""
SQL = {
    "claims_split": f"WITH {CLAIMS} SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY island) - 1)::INTEGER AS claim_no, claim, array_to_string(numbers, ',') AS citations, kind FROM merged",
    "judge_batches": f"WITH {VERIFIED} SELECT answer_id, claim_no::INTEGER AS claim_no, n::INTEGER AS n, ((row_number() OVER (PARTITION BY answer_id ORDER BY claim_no, n) - 1) // 8)::INTEGER AS call FROM cited",
    "parse_citations": r"""WITH a AS (SELECT conv_id || '-' || turn AS answer_id, regexp_replace(text, '\.(\s|$)', '. [' || turn || CASE WHEN turn % 3 = 0 THEN ', 99' ELSE '' END || ']\1', 'g') AS text FROM conversations WHERE role = 'assistant'),
        n AS (SELECT answer_id, list_distinct(flatten(list_transform(regexp_extract_all(text, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: list_transform(string_split_regex(g, '\s*,\s*'), lambda x: x::INT)))) AS n FROM a)
        SELECT answer_id, array_to_string(list_filter(n, lambda x: x BETWEEN 1 AND 20), ',') AS valid, array_to_string(list_filter(n, lambda x: x < 1 OR x > 20), ',') AS invalid
        FROM (SELECT answer_id, list_sort(n) AS n FROM n)""",
    "claim_status": f"WITH {VERIFIED} SELECT * FROM verified",
    "flagged_claims": f"WITH {VERIFIED} SELECT answer_id, claim_no, status FROM verified WHERE status IN ('partial', 'unsupported', 'uncited', 'unchecked')",
    "grader_self_check": """WITH i AS (SELECT conv_id, text, string_split(text, ' ')[1 : 3] AS f FROM conversations WHERE turn = 0),
        c AS (SELECT conv_id, f, unnest(['reference', 'unrelated', 'unsure', 'first_fact']) AS "case", unnest([text, 'The weather is nice today.', 'I don''t know.', f[1]]) AS answer, unnest([1.0::DOUBLE, 0.0, 0.0, 1.0::DOUBLE / len(f)]) AS expected FROM i),
        g AS (SELECT *, len(list_filter(f, lambda x: contains(answer, x))) / len(f)::DOUBLE AS score FROM c)
        SELECT "case", count(*) AS cases, count(*) FILTER (abs(score - expected) < 1e-9) AS agreed FROM g GROUP BY 1""",
    "claim_counts": f"""WITH {VERIFIED} SELECT answer_id, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("supported", "partial", "unsupported", "uncited", "gap", "unchecked"))},
        round((count(*) FILTER (status = 'supported') + 0.5::DOUBLE * count(*) FILTER (status = 'partial')) / count(*), 6) AS coverage FROM verified GROUP BY answer_id""",
    "quote_in_passage": rf"""WITH q AS (SELECT conv_id, list_filter(list_transform(string_split_regex(regexp_replace({S.folded("text")}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\.\.\.|…'), lambda p: array_to_string(regexp_extract_all(p, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+'), ' ')), lambda p: p <> '') AS parts FROM conversations WHERE turn = 0)
        SELECT t.conv_id, t.turn, len(q.parts) > 0 AND len(list_filter(q.parts, lambda p: NOT contains(' ' || array_to_string({S.words("t.text")}, ' ') || ' ', ' ' || p || ' '))) = 0 AS found FROM conversations t JOIN q USING (conv_id)""",
    "confidence_score": f"""WITH {OUTCOMES}, f AS (SELECT d, signal, 0.3::DOUBLE * relevance + 0.4::DOUBLE * (d % 11) / 10.0::DOUBLE + 0.3::DOUBLE * (d % 3) / 2.0::DOUBLE AS w,
        list_filter([CASE WHEN toxic = 1 THEN 'ungrounded' END, CASE WHEN d % 8 = 0 THEN 'unsupported_claim' END, CASE WHEN d % 6 = 0 THEN 'partial_claim' END, CASE WHEN d % 9 = 0 THEN 'unchecked_claim' END, CASE WHEN d % 10 = 0 THEN 'truncated' END,
            CASE WHEN d % 12 = 0 THEN 'missing_part' END, CASE WHEN d % 4 = 0 AND d % 12 <> 0 THEN 'incomplete' END, CASE WHEN signal <> 'rerank' THEN 'retrieval_from_' || signal END], lambda x: x IS NOT NULL) AS flags FROM o),
        c AS (SELECT d, flags, least(w, list_min(list_concat([1.0::DOUBLE], list_transform(flags, lambda x: CASE x WHEN 'ungrounded' THEN 0.2 WHEN 'unsupported_claim' THEN 0.4 WHEN 'partial_claim' THEN 0.7 WHEN 'unchecked_claim' THEN 0.4 WHEN 'truncated' THEN 0.5 WHEN 'missing_part' THEN 0.6 WHEN 'incomplete' THEN 0.75 ELSE 1.0 END::DOUBLE)))) AS s FROM f)
        SELECT d AS doc_id, round(s, 3) AS score, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS level, array_to_string(flags, ',') AS flags FROM c""",
    "status_ladder": f"""WITH {OUTCOMES}, c AS (SELECT d, CASE WHEN d % 23 = 0 THEN 'error.timeout' WHEN relevance < 0.5 THEN 'not_found.no_relevant_documents' WHEN d % 14 = 0 THEN 'not_found.model_found_nothing' WHEN toxic = 1 THEN 'unverified.ungrounded'
        WHEN d % 8 = 0 THEN 'unverified.unsupported_claim' WHEN d % 9 = 0 THEN 'unchecked.checker_unavailable' WHEN d % 4 = 0 THEN 'partial' ELSE 'answered' END AS code FROM o) SELECT d AS doc_id, string_split(code, '.')[1] AS status, code FROM c""",
    "eval_summary": f"WITH {RECORDS} SELECT * FROM done",
    "spread": f"""WITH {RECORDS}, u AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS value FROM done" for m in METRICS)})
        SELECT metric, round(avg(value), 3) AS mean, min(value) AS min, max(value) AS max FROM u WHERE value IS NOT NULL GROUP BY metric""",
    "judge_confusion": "SELECT label, CASE WHEN doc_id % 9 = 0 THEN 'partial' WHEN doc_id % 7 = 0 THEN 'supported' ELSE label END AS verdict, count(*) AS n FROM (SELECT *, CASE WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS label FROM labels) GROUP BY ALL",
    "judge_errors": """WITH j AS (SELECT label, CASE WHEN doc_id % 9 = 0 THEN 'partial' WHEN doc_id % 7 = 0 THEN 'supported' ELSE label END AS verdict FROM (SELECT *, CASE WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS label FROM labels))
        SELECT count(*) AS pairs, round(avg((label = verdict)::INT), 4) AS exact, count(*) FILTER (label = 'unsupported' AND verdict = 'supported') AS false_support, count(*) FILTER (label = 'supported' AND verdict <> 'supported') AS missed_support FROM j""",
    "grade_facts": """WITH f AS (SELECT conv_id, CASE WHEN turn % 5 = 4 THEN 'missing' WHEN (conv_id * 7 + turn) % 11 = 0 THEN 'contradicted' WHEN (conv_id * 7 + turn) % 4 = 0 THEN 'missing' ELSE 'present' END AS status FROM conversations),
        g AS (SELECT conv_id, avg((status = 'present')::INT) AS share, bool_or(status = 'contradicted') OR conv_id % 6 = 0 AS bad FROM f GROUP BY conv_id)
        SELECT conv_id AS query_id, round(CASE WHEN bad THEN 0.0::DOUBLE ELSE share END, 6) AS score, NOT bad AND share = 1 AS correct FROM g""",
    "stratified_split": """SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('20260928:' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.6 + 0.5) THEN 'test' ELSE 'dev' END AS split FROM labels""",
    "seeded_sample": r"SELECT doc_id, source FROM documents WHERE len(string_split_regex(trim(text), '\s+')) >= 40 ORDER BY md5('20260928:' || doc_id), doc_id LIMIT 40",
    "snapshot_diff": f"""WITH b AS (SELECT doc_id, md5(text) AS h FROM documents WHERE lang IN ('en', 'de')), a AS (SELECT doc_id, md5({S.clean("text")}) AS h FROM documents WHERE lang IN ('de', 'fr'))
        SELECT * FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id) WHERE change IS NOT NULL""",
}
