"""Evaluation: where evidence ranks, what graders say, and summaries over questions and runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findspar.functions import text as T


def evidence_rank(evidence: DataFrame, hits: DataFrame, deepest: int = 20) -> DataFrame:
    """(query_id, evidence_no, evidence_rank): the best rank of a hit that holds the quote, or null.

    evidence (query_id, evidence_no, source, quote), a row per alternative, source
    null if any will do; hits (query_id, rank, source, text).
    """
    words = hits.where(F.col("rank") <= deepest).withColumn("words", T.spaced_words(F.col("text"))).select("query_id", "rank", F.col("source").alias("hit_source"), "words")
    found = evidence.join(words, "query_id").where((F.col("source").isNull() | (F.col("source") == F.col("hit_source"))) & T.quote_in_passage(F.col("quote"), F.col("words")))
    ranks = found.groupBy("query_id", "evidence_no").agg(F.min("rank").alias("evidence_rank"))
    return evidence.select("query_id", "evidence_no").distinct().join(ranks, ["query_id", "evidence_no"], "left")


def retrieval_metrics(ranked: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """recall@5, hit@5, all@5, recall@20 and mean reciprocal rank from (query_id, evidence_rank)."""
    by = by or []
    names = [c for c in ranked.columns if c not in ("query_id", "evidence_no", "evidence_rank")] if by else []
    rank = F.col("evidence_rank")
    top5 = F.coalesce(rank <= 5, F.lit(False))
    per = ranked.groupBy(*names, "query_id").agg(F.count("*").alias("n"), F.count_if(top5).alias("in5"), F.count_if(rank <= 20).alias("in20"), F.min("evidence_rank").alias("first"))
    out = per.groupBy(*names) if names else per.groupBy()
    return out.agg(
        F.count("*").alias("questions"), F.round(F.sum("in5") / F.sum("n"), 4).alias("recall_at_5"), F.round(F.avg((F.col("in5") > 0).cast("double")), 4).alias("hit_at_5"),
        F.round(F.avg((F.col("in5") == F.col("n")).cast("double")), 4).alias("all_at_5"), F.round(F.sum("in20") / F.sum("n"), 4).alias("recall_at_20"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
    )


TERMS = 2_000


def absent_terms(terms: DataFrame, texts: DataFrame, block: int = TERMS) -> DataFrame:
    """Terms that no text holds, parts of words included and whatever the case.

    With a `collection` in both tables only texts of a term's own collection count.
    Terms go to the texts in blocks of `block`, one scan of the texts for each; a task
    looks for a term until it has found it.  Null terms are absent from nothing and don't
    occur.
    """
    own = ["collection"] if "collection" in terms.columns and "collection" in texts.columns else []
    asked = terms.select("term", *own).where("term is not null").distinct()
    sought = asked.withColumn("_lower", F.lower("term"))
    lowered = texts.select(F.lower("text").alias("_text"), *own).where("_text is not null")
    blocks = max(1, -(-sought.count() // block))
    held = None
    for b in range(blocks):
        few = sought.where(F.pmod(F.xxhash64("term", *own), F.lit(blocks)) == b).select("term", "_lower", *own).toArrow()
        found = lowered.mapInArrow(_holder(few, bool(own)), asked.schema).distinct()
        held = found if held is None else held.union(found)
    return asked.join(held, ["term", *own], "left_anti")


def _joined(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """Texts, none of them null, as bytes one behind the other, and where each ends."""
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    return b"".join(texts.cast(pa.binary()).to_pylist()), np.cumsum(sizes)


def _within(whole: bytes, ends: np.ndarray, term: bytes) -> bool:
    """Whether one of the joined texts holds the term, which is not empty."""
    at = whole.find(term)
    while at >= 0:
        if at + len(term) <= ends[np.searchsorted(ends, at, "right")]:
            return True
        at = whole.find(term, at + 1)  # it runs from one text into the next
    return False


def _holder(terms: pa.Table, owned: bool) -> Callable:
    rows = terms.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = rows
        for batch in batches:
            texts, found, missing = batch.column("_text"), [], []
            groups = [None] if not owned else pc.unique(batch.column("collection")).drop_null().to_pylist()
            parts = {}
            for group in groups if left else []:
                own = texts if not owned else texts.filter(pc.fill_null(pc.equal(batch.column("collection"), group), False))
                parts[group] = _joined(own)
            for row in left:
                group = row["collection"] if owned else None
                held = group in parts and (len(parts[group][1]) > 0 if not row["_lower"] else _within(*parts[group], row["_lower"].encode()))
                (found if held else missing).append(row)
            left = missing
            yield pa.RecordBatch.from_pylist([{k: v for k, v in row.items() if k != "_lower"} for row in found], schema=terms.drop_columns(["_lower"]).schema)

    return run


def leaks(questions: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of questions (query_id, text) whose word sets have a Jaccard similarity of `least` or more.

    Words in order of their frequency, rarest first: sets that similar share one of
    the first n - ceil(least n) + 1, so common words bring no pairs together.
    """
    words = questions.select("query_id", F.array_distinct(T.words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    each = words.select("query_id", F.explode("w").alias("word"))
    ordered = each.join(each.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("o"))
    n = F.size("o")
    first = ordered.select("query_id", F.explode(F.slice("o", F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)["word"]).alias("word"))
    pairs = first.toDF("id_a", "word").join(first.toDF("id_b", "word"), "word").where("id_a < id_b").select("id_a", "id_b").distinct()
    both = pairs.join(words.toDF("id_a", "a"), "id_a").join(words.toDF("id_b", "b"), "id_b")
    shared = F.size(F.array_intersect("a", "b"))
    j = shared / (F.size("a") + F.size("b") - shared)
    return both.where(j >= least).select("id_a", "id_b", F.round(j, 4).alias("similarity"))


def grade_facts(facts: DataFrame, replies: DataFrame, extra_wrong: DataFrame) -> DataFrame:
    """(query_id, score, correct): share of key facts present, 0 if any is contradicted or something wrong is added; skipped facts are missing.

    facts (query_id, fact_id); replies (query_id, fact_id, status), the first per
    fact counts; extra_wrong (query_id, extra_wrong).
    """
    first = replies.groupBy("query_id", "fact_id").agg(F.min_by("status", "reply_no").alias("status"))
    joined = facts.join(first, ["query_id", "fact_id"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    per = joined.groupBy("query_id").agg(F.avg((F.col("status") == "present").cast("double")).alias("share"), F.bool_or(F.col("status") == "contradicted").alias("bad"))
    graded = per.join(extra_wrong, "query_id", "left")
    score = F.when(F.col("bad") | F.coalesce("extra_wrong", F.lit(False)), F.lit(0.0)).otherwise(F.col("share"))
    return graded.select("query_id", score.alias("score"), (score == 1.0).alias("correct"))


UNRELATED, UNSURE = "The weather is nice today.", "I don't know."


def check_cases(items: DataFrame) -> DataFrame:
    """Answers whose grade is known, to check a grader with: (query_id, case, answer, expected) from items (query_id, answer, facts).

    The reference answer has all facts, an unrelated one and "I don't know" have none,
    and the first fact alone has its share.
    """
    n = F.size("facts")
    cases = F.array(
        F.struct(F.lit("reference").alias("case"), F.col("answer").alias("answer"), F.lit(1.0).alias("expected")),
        F.struct(F.lit("unrelated").alias("case"), F.lit(UNRELATED).alias("answer"), F.lit(0.0).alias("expected")),
        F.struct(F.lit("unsure").alias("case"), F.lit(UNSURE).alias("answer"), F.lit(0.0).alias("expected")),
        F.struct(F.lit("first_fact").alias("case"), F.get("facts", F.lit(0)).alias("answer"), (1.0 / n).alias("expected")),
    )
    return items.where(n > 0).select("query_id", "facts", F.explode(cases).alias("c")).select("query_id", "facts", "c.*")


def grader_check(items: DataFrame, grade: Callable[[Column, Column], Column]) -> DataFrame:
    """(case, cases, agreed): how often a grader gives the answers of `check_cases` the share of facts that they have.

    `grade` maps an answer and a fact to `present`, `missing` or `contradicted`.
    """
    each = check_cases(items).select("query_id", "case", "answer", "expected", F.explode("facts").alias("fact")).withColumn("status", grade(F.col("answer"), F.col("fact")))
    graded = each.groupBy("query_id", "case", "expected").agg(F.when(F.bool_or(F.col("status") == "contradicted"), 0.0).otherwise(F.avg((F.col("status") == "present").cast("double"))).alias("score"))
    return graded.groupBy("case").agg(F.count("*").alias("cases"), F.count_if(F.abs(F.col("score") - F.col("expected")) < 1e-9).alias("agreed"))


def confusion(judged: DataFrame) -> DataFrame:
    """Counts of (label, verdict)."""
    return judged.groupBy("label", "verdict").agg(F.count("*").alias("n"))


def judge_errors(judged: DataFrame) -> DataFrame:
    """How often support is claimed that isn't there, and missed where it is."""
    label, verdict = F.col("label"), F.col("verdict")
    return judged.agg(
        F.count("*").alias("pairs"), F.round(F.avg((label == verdict).cast("double")), 4).alias("exact"),
        F.count_if((label == "unsupported") & (verdict == "supported")).alias("false_support"), F.count_if((label == "supported") & (verdict != "supported")).alias("missed_support"),
    )


def places(value: Column, digits: int = 3) -> Column:
    """A mean or share to so many places, halves away from zero.

    The order in which doubles are added changes the last bits of a mean, so a half can
    come out just below itself; nine places bring it back first.
    """
    scale = F.lit(10.0**digits)
    return F.round(F.round(value, 9) * scale) / scale


def summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The metrics of a run over its questions; nulls don't count.

    records: expected (answer, not_found or clarify_or_cover), shown, error, correct,
    fact_score, wrong_fact, faithfulness, citation_accuracy, acceptable, tokens, seconds,
    and how many pieces of evidence there are (evidence), in the first five hits (in5)
    and in the first twenty (in20).
    """

    def mean(value: Column, on: Column) -> Column:
        return places(F.avg(F.when(on, value.cast("double"))))

    answerable, shown = F.col("expected") == "answer", F.col("shown")

    def share(found: str) -> Column:
        return F.try_divide(F.sum(F.when(answerable, F.col(found))), F.sum(F.when(answerable, F.col("evidence"))))

    seconds = F.sort_array(F.collect_list(F.when(~F.col("error"), F.col("seconds"))))
    return records.groupBy(*(by or [])).agg(
        F.count("*").alias("questions"), F.count_if(F.col("error")).alias("errors"),
        places(share("in5")).alias("evidence_recall_top5"), places(share("in20")).alias("evidence_recall_top20"), mean(F.col("in5") > 0, answerable).alias("hit_top5"),
        mean(shown, answerable).alias("answer_rate"), mean(shown & F.coalesce("correct", F.lit(False)), answerable).alias("fully_correct"),
        mean(F.col("fact_score"), answerable & shown).alias("fact_coverage"), mean(F.col("wrong_fact"), answerable & shown).alias("wrong_fact_rate"),
        mean(F.col("faithfulness"), answerable & shown).alias("faithfulness"), mean(F.col("citation_accuracy"), answerable & shown).alias("citation_accuracy"),
        mean(~shown & ~F.col("error"), answerable).alias("withheld_rate"), F.count_if(answerable & ~shown & ~F.col("error") & F.coalesce("correct", F.lit(False))).alias("withheld_but_correct"),
        mean(F.col("acceptable"), F.col("expected") == "not_found").alias("no_answer_handled"), mean(F.col("acceptable"), F.col("expected") == "clarify_or_cover").alias("ambiguous_handled"), places(F.avg("tokens")).alias("tokens_per_question"),
        F.element_at(seconds, (F.floor(F.size(seconds) / 2) + 1).cast("int")).alias("seconds_p50"),
        F.element_at(seconds, F.least(F.size(seconds), F.floor(F.size(seconds) * 0.95) + 1).cast("int")).alias("seconds_p95"),
    )


def spread(summaries: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, smallest and largest value of each metric over runs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return summaries.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("metric").agg(places(F.avg("value")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def split(items: DataFrame, item_id: str, stratum: str, test_share: float = 0.6, seed: str = "20260928") -> DataFrame:
    """Each stratum's items in a seeded hash order: the first share is `test`, the rest `dev`."""
    from pyspark.sql.window import Window

    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(item_id).cast("string")))
    order, whole = Window.partitionBy(stratum).orderBy(key, item_id), Window.partitionBy(stratum)
    n = F.floor(F.count("*").over(whole) * test_share + 0.5)
    return items.withColumn("split", F.when(F.row_number().over(order) <= n, "test").otherwise("dev"))


def sampled(rows: DataFrame, key: str, n: int, seed: str = "20260928") -> DataFrame:
    """n rows in a seeded hash order: a top-k, not a sort of everything."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string"))), key).limit(n)


def fingerprint(rows: DataFrame) -> DataFrame:
    """One hash over all rows, whatever their order."""
    return rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("fingerprint"), F.count("*").alias("rows"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or changed between two snapshots."""
    a, b = before.select(key, F.col(digest).alias("_a")), after.select(key, F.col(digest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")
