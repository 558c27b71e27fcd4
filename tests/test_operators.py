import re
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findspar.functions import text as T
from findspar.operators import answers, chunking, dedup, evaluation, index, limits, search


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens_keep_identifiers_whole_and_in_parts(spark):
    assert value(spark, T.tokens(F.lit("Fix ERR_TUNNEL_4012 now"))) == ["fix", "err_tunnel_4012", "err", "tunnel", "4012", "now"]
    assert value(spark, T.tokens(F.lit("to-do the thing"))) == ["to-do", "do", "thing"]


def test_shingles_and_facts(spark):
    assert value(spark, T.shingles(F.lit("one two"))) == ["one two"]
    assert value(spark, T.shingles(F.lit("")))== []
    assert value(spark, T.shingles(F.lit("a b c a b c"))) == ["a b c", "b c a", "c a b"]
    assert value(spark, T.facts(F.lit("wait 30 days for err_1 or x.y"))) == ["30", "err_1", "x.y"]


def test_quotes(spark):
    words = T.spaced_words(F.lit("Reconnect the client. Then restart it twice."))
    for quote, found in (("reconnect the CLIENT", True), ("client ... restart", True), ("restart twice", False), ("", False), ("lient", False)):
        assert value(spark, T.quote_in_passage(F.lit(quote), words)) is found


def test_citations(spark):
    c = value(spark, T.citations(F.lit("a [2] b [1, 3] c [2][9]"), 3))
    assert (c["valid"], c["invalid"]) == ([2, 1, 3], [9])
    assert value(spark, T.plain_citations(F.lit("error【1†L5-L6】 and x‑y"))) == "error [1] and x-y"


def test_clean(spark):
    assert value(spark, T.clean(F.lit("\n\na  b \n\n\n\n  c\td\n"))) == "a b\n\n  c d"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_pieces_lose_nothing_and_keep_the_size(text, size, overlap):
    parts = chunking.pieces(text, size, overlap)
    assert all(len(p) <= size and p in text for p in parts)
    assert "".join(chunking.pieces(text, size, 0)) == text
    assert sum(map(len, parts)) >= len(text)


def test_fixed_chunks_take_the_heading_of_their_first_character(spark):
    rows = [(1, "s", 0, "x" * 790, "one", None), (1, "s", 1, "y" * 500, "two", None), (2, "s", 0, None, "none", None)]
    s = spark.createDataFrame(rows, "doc_id int, source string, section_no int, text string, heading string, page int")
    got = chunking.fixed(s).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["heading"], r["char_count"]) for r in got] == [(1, "one", 800), (1, "one", 612)]


def test_repeats_get_a_suffix(spark):
    rows = [(1, "s", i, "same text", "h", None) for i in range(3)]
    s = spark.createDataFrame(rows, "doc_id int, source string, section_no int, text string, heading string, page int")
    ids = [r["chunk_id"] for r in chunking.structure(s).orderBy("chunk_index").collect()]
    assert len(set(ids)) == 3 and ids[1] == ids[0] + "-2" and ids[2] == ids[0] + "-3"


def test_semantic_cuts_where_the_topic_changes(spark):
    cats, ships = "cats purr softly beside warm stoves every evening ", "vessels carry freight across stormy northern oceans "
    text = "\n\n".join([cats * 4, cats * 4, cats * 4, ships * 4, ships * 4, ships * 4])
    s = spark.createDataFrame([(1, "s", 0, text, "h", None)], "doc_id int, source string, section_no int, text string, heading string, page int")
    got = [r["text"] for r in chunking.semantic(s, chunking.hashed_words).orderBy("chunk_index").collect()]
    assert all(("cats" in t) != ("vessels" in t) for t in got)


def test_fusion_is_a_sum_of_reciprocal_ranks(spark):
    kind = "query_id int, chunk_id string, score double, rank int"
    dense = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "c", 0.7, 3), (1, "a", 0.1, 4)], kind)
    sparse = spark.createDataFrame([(1, "c", 5.0, 1)], kind)
    got = {r["chunk_id"]: r for r in search.fuse({"dense": dense, "sparse": sparse}, {"dense": 1.0, "sparse": 1.0}).collect()}
    assert got["c"]["score"] == pytest.approx(1 / 63 + 1 / 61) and got["c"]["fused_rank"] == 1
    assert got["a"]["dense_rank"] == 1 and got["c"]["contributions"]["sparse"] == pytest.approx(1 / 61)
    with pytest.raises(ValueError):
        search.fuse({"other": dense})


def test_dense_is_exact_and_masked(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(60)] + [(60, None, 0)]
    vectors = spark.createDataFrame(rows, "chunk_id int, vector array<double>, collection int")
    asked = spark.createDataFrame([(0, [float(x) for x in v[0]], 1), (1, [0.0] * 8, 1)], "query_id int, vector array<double>, collection int")
    got = search.dense(asked, vectors, k=4).orderBy("rank").collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    own = sorted((i for i in range(60) if i % 3 == 1), key=lambda i: (-round(float(unit[0] @ unit[i]), 9), i))[:4]
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [(0, i) for i in own]


def test_merge_gives_each_query_its_best_first(spark):
    kind = "query_id int, part int, is_original boolean, chunk_id string, rank int, rerank_score double"
    rows = [(1, 0, False, "a", 1, 2.0), (1, 0, False, "b", 2, 1.9), (1, 1, False, "c", 1, 0.5), (1, 2, True, "d", 1, 3.0)]
    got = [r["chunk_id"] for r in search.merge_rewritten(spark.createDataFrame(rows, kind), 3).orderBy("rank").collect()]
    assert got == ["a", "c", "d"]


def test_rewrites_are_distinct_without_case(spark):
    rows = [(1, 0, " How  to "), (1, 1, "how to"), (1, 2, "b"), (1, 3, ""), (1, 4, "c"), (1, 5, "d")]
    got = search.cleaned_rewrites(spark.createDataFrame(rows, "query_id int, part int, query string")).orderBy("part").collect()
    assert [r["query"] for r in got] == ["How to", "b", "c"]


BASE = "The background writer flushes pages every {} milliseconds and waits for the checkpoint to finish before it starts over again with the next set of dirty buffers in shared memory, which the operating system then writes out to stable storage in its own time"


def test_admission_is_sequential(spark):
    """a ~ b and b ~ c but not a ~ c: c stays, because b isn't kept."""
    signed = spark.createDataFrame([(i, i, f"c{i}") for i in range(1, 5)], "chunk_id int, ord int, class string")
    pairs = spark.createDataFrame([("c1", "c2", 0.95), ("c2", "c3", 0.96), ("c3", "c4", 0.92), ("c1", "c4", 0.91)], "class_a string, class_b string, similarity double")
    got = {r["chunk_id"]: r["duplicate_of"] for r in dedup.admit(signed, pairs).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 3}


def test_different_facts_are_no_duplicates(spark):
    rows = [(1, BASE.format(200)), (2, BASE.format(200) + "."), (3, BASE.format(400)), (4, "short"), (5, None)]
    signed = dedup.signatures(spark.createDataFrame(rows, "chunk_id int, text string"))
    got = {r["chunk_id"]: r["duplicate_of"] for r in dedup.admit(signed, dedup.class_pairs(signed)).collect()}
    assert got == {1: None, 2: 1, 3: None}


def test_sync_promotes_orphans_and_is_idempotent(spark):
    kind = "chunk_id string, doc_id string, text string, chunk_index int"
    text = BASE.format(10)
    chunks = spark.createDataFrame([("d1:a", "d1", text, 0)], kind)
    none = spark.createDataFrame([], kind + ", duplicate_of string, similarity double")
    second = spark.createDataFrame([("d2:a", "d2", text, 0)], kind)
    chunks, copies = index.sync(chunks, none, second)
    assert [r["chunk_id"] for r in chunks.collect()] == ["d1:a"] and [(r["chunk_id"], r["duplicate_of"]) for r in copies.collect()] == [("d2:a", "d1:a")]
    again = index.sync(chunks, copies, second)
    assert again[1].count() == 1 and again[0].count() == 1
    changed = spark.createDataFrame([("d1:b", "d1", "other " * 40, 0)], kind)
    chunks, copies = index.sync(chunks, copies, changed)
    assert sorted(r["chunk_id"] for r in chunks.collect()) == ["d1:b", "d2:a"] and copies.count() == 0


def test_versioned_table(spark, tmp_path):
    t = index.VersionedTable(spark, str(tmp_path / "t"))
    assert t.version == 0
    assert t.write(spark.range(3)) == 1 and t.write(index.upsert(t.read(), spark.range(2, 5), "id")) == 2
    assert sorted(r["id"] for r in t.read().collect()) == [0, 1, 2, 3, 4]


def test_claims(spark):
    text = "Restart it. Then wait [1]. The documents do not mention the cost.\n- Call us.\n[2]\nDone. [3] Bye."
    more = "[7]\nOne, two. Three [2, 1] . The sources say no details. Four! Five?\n1. Six [2][2]\n**Seven** [4]\nEight"
    got = {}
    for r in answers.claims(spark.createDataFrame([(1, text), (2, more), (2, more), (2, "Nine."), (3, None), (4, "[1] * [2]")], "answer_id int, text string")).orderBy("answer_id", "claim_no").collect():
        got.setdefault(r["answer_id"], []).append((r["claim"], r["citations"], r["kind"]))
    assert got[1] == [
        ("Restart it. Then wait.", [1], "cited"), ("The documents do not mention the cost.", [], "gap"), ("Call us.", [2], "cited"), ("Done.", [3], "cited"), ("Bye.", [], "uncited"),
    ]
    assert sorted(got[2], key=str) == sorted([("One, two. Three.", [2, 1], "cited"), ("The sources say no details.", [], "gap"), ("Four! Five? Six", [2], "cited"), ("Seven", [4], "cited"), ("Eight", [], "uncited"), ("Nine.", [], "uncited")], key=str)
    assert set(got) == {1, 2}


def test_only_partial_claims_are_judged_again(spark):
    asked = []

    def judge(claim, passage):
        asked.append(passage._jc.toString())
        return answers.overlap_judge(claim, passage)

    claimed = spark.createDataFrame([("a", 0, "red fox jumps", [1, 2], "cited"), ("a", 1, "red fox", [1, 2], "cited")], "answer_id string, claim_no int, claim string, citations array<int>, kind string")
    passages = spark.createDataFrame([("a", 1, "the red fox"), ("a", 2, "jumps")], "answer_id string, n int, text string")
    checked = answers.verify(claimed, passages, judge)
    assert {r["claim_no"]: r["status"] for r in checked.collect()} == {0: "supported", 1: "supported"} and len(asked) == 2
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("any_partial") < len(plan)  # the second call reads filtered rows only
    assert plan.count("Filter") > 1


def test_partial_support_is_checked_against_all_passages(spark):
    claimed = spark.createDataFrame([("a", 0, "red fox jumps high", [1, 2], "cited"), ("a", 1, "blue whale", [1, 9], "cited"), ("a", 2, "x", [], "uncited")], "answer_id string, claim_no int, claim string, citations array<int>, kind string")
    passages = spark.createDataFrame([("a", 1, "the red fox"), ("a", 2, "jumps very high")], "answer_id string, n int, text string")
    got = {r["claim_no"]: r["status"] for r in answers.verify(claimed, passages).collect()}
    assert got == {0: "supported", 1: "unsupported", 2: "uncited"}


def test_ask(spark):
    q = spark.createDataFrame([(1, "how to renew?"), (2, "what?"), (3, "nothing")], "query_id int, question string")
    kind = "query_id int, rank int, source string, page int, heading string, text string, rerank_score double, dense_score double"
    hits = spark.createDataFrame([(1, 1, "vpn.md", None, "Renew", "run the renew command", 3.0, 0.8), (2, 1, "x.md", 2, "X", "unrelated", -9.0, 0.1)], kind)
    got = {r["query_id"]: r for r in answers.ask(q, hits, lambda prompt: F.lit("Run the renew command [1].")).collect()}
    assert got[1]["status"] == "answered" and got[1]["citations"] == [1] and got[1]["level"] == "high"
    assert got[2]["code"] == "not_found.no_relevant_documents" and got[3]["status"] == "not_found" and got[3]["answer"] is None
    bad = {r["query_id"]: r["code"] for r in answers.ask(q, hits, lambda p: F.lit("Pigs fly over Paris [1].")).collect()}
    assert bad[1] == "unverified.unsupported_claim"


def test_evidence_and_metrics(spark):
    e = spark.createDataFrame([(1, 0, None, "the answer"), (1, 1, "b", "missing"), (2, 0, "b", "here")], "query_id int, evidence_no int, source string, quote string")
    h = spark.createDataFrame([(1, 1, "a", "nope"), (1, 2, "b", "This is the answer."), (2, 7, "b", "it is here"), (2, 1, "a", "here")], "query_id int, rank int, source string, text string")
    ranks = evaluation.evidence_rank(e, h)
    assert {(r["query_id"], r["evidence_no"]): r["evidence_rank"] for r in ranks.collect()} == {(1, 0): 2, (1, 1): None, (2, 0): 7}
    m = evaluation.retrieval_metrics(ranks).first()
    assert (m["recall_at_5"], m["hit_at_5"], m["all_at_5"], m["recall_at_20"], m["mrr"]) == (0.3333, 0.5, 0.0, 0.6667, round((1 / 2 + 1 / 7) / 2, 4))


def test_summary_rounds_halves_up_in_any_order_of_the_rows(spark):
    """Sevenths whose mean is 0.4375: added in this order they give 0.43749999999999994."""
    sevenths = [0, 3, 3, 1, 1, 4, 6, 3, 4, 2, 6, 5, 0, 4, 2, 5]
    kind = "expected string, shown boolean, error boolean, correct boolean, fact_score double, wrong_fact boolean, faithfulness double, citation_accuracy double, acceptable boolean, tokens double, seconds double, evidence int, in5 int, in20 int"
    for order in (sevenths, sorted(sevenths)):
        rows = [("answer", True, False, True, k / 7.0, False, 1.0, 1.0, True, 5.0, 1.0, 2, 1, 1) for k in order]
        assert evaluation.summary(spark.createDataFrame(rows, kind).coalesce(1)).first()["fact_coverage"] == 0.438


def test_spread_rounds_halves_up_in_any_order_of_the_runs(spark):
    """Values whose mean is 0.4465: added in this order they give 0.44649999999999995."""
    runs = [0.577, 0.304, 0.495, 0.41]
    for order in (runs, sorted(runs)):
        got = evaluation.spread(spark.createDataFrame([(x,) for x in order], "hit_top5 double").coalesce(1), ["hit_top5"]).first()
        assert (got["mean"], got["min"], got["max"]) == (0.447, 0.304, 0.577)


def test_limiter_counts_only_admitted_events(spark):
    rows = [(i, 1, i * 600) for i in range(9)]
    e = spark.createDataFrame(rows, "event_id int, user_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: (r["admitted"], r["retry_after"]) for r in limits.admit(e, 2).collect()}
    assert [got[i][0] for i in range(9)] == [True, True, False, False, False, False, True, True, False]
    assert got[2][1] == 2401


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    s = chunking.whole_text_sections(docs)
    assert chunking.fixed(s).count() == chunking.structure(s).count() == 0
    q = spark.createDataFrame([], "query_id bigint, text string")
    assert search.sparse(q, search.postings(search.tokenised(docs, "doc_id", "text")), search.corpus_statistics(search.tokenised(docs, "doc_id", "text"))).count() == 0
    signed = dedup.signatures(docs, "doc_id", "text")
    assert dedup.admit(signed, dedup.class_pairs(signed)).count() == 0


def test_hybrid_degrades(spark):
    q = spark.createDataFrame([(1, "red fox")], "query_id int, text string")
    found = spark.createDataFrame([(1, "a", 2.0, 1), (1, "b", 1.0, 2)], "query_id int, chunk_id string, score double, rank int")
    p = spark.createDataFrame([("a", "blue whale"), ("b", "a red fox")], "chunk_id string, passage string")
    got = search.hybrid(q, None, found, p).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a"] and got[0]["degraded"] == ["dense_search_unavailable"]
    plain = search.hybrid(q, None, found, p, scorer=None).orderBy("rank").collect()
    assert [r["chunk_id"] for r in plain] == ["a", "b"] and "rerank_unavailable" in plain[0]["degraded"]
    assert [r["query_id"] for r in search.to_rewrite(search.hybrid(q, found, found, p), 7.0).collect()] == [1]
    with pytest.raises(ValueError):
        search.hybrid(q, None, None, p)


def test_repair_and_model_guard(spark):
    chunks = spark.createDataFrame([("a", "d1"), ("b", "d1")], "chunk_id string, doc_id string")
    vectors = spark.createDataFrame([("b", "m"), ("x", "m")], "chunk_id string, model string")
    copies = spark.createDataFrame([("c", "d2", "gone"), ("d", "d3", "a")], "chunk_id string, doc_id string, duplicate_of string")
    assert {(r["problem"], r["chunk_id"]) for r in index.check(chunks, vectors, copies).collect()} == {("missing_vector", "a"), ("stray_vector", "x"), ("lost_original", "c")}
    embed, stay, again = index.repair(chunks, vectors, copies)
    assert [r["chunk_id"] for r in embed.collect()] == ["a"] and [r["chunk_id"] for r in stay.collect()] == ["b"] and [r["doc_id"] for r in again.collect()] == ["d2"]
    assert index.same_model(vectors, "m").count() == 2
    with pytest.raises(ValueError):
        index.same_model(vectors, "other")


def test_terms_are_sought_within_words_too(spark):
    texts = spark.createDataFrame([("Support is C++ only", "a"), (None, "a"), ("Backup", "b")], "text string, collection string")
    terms = spark.createDataFrame([("port", "a"), ("++", "a"), ("backup", "a"), ("BACK", "b"), ("", "b"), (None, "b")], "term string, collection string")
    assert {(r["term"], r["collection"]) for r in evaluation.absent_terms(terms, texts).collect()} == {("backup", "a")}
    assert [r["term"] for r in evaluation.absent_terms(terms.select("term"), texts.select("text"), block=1).collect()] == []
    assert evaluation.absent_terms(terms.select("term"), texts.limit(0).select("text")).count() == 5


def test_leaks_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["the", "of", *[f"w{x}" for x in rng.integers(12, size=rng.integers(1, 9))]])) for i in range(80)] + [(90, None), (91, ""), (92, "!")]
    sets = {i: set(t.split()) for i, t in rows if t and t != "!"}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = evaluation.leaks(spark.createDataFrame(rows, "query_id int, text string"), 0.6)
    assert {(r["id_a"], r["id_b"]) for r in got.collect()} == want and want


def test_vectors_of_any_kind(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [None, 1.0]), ("d", []), ("e", None), ("f", [float("nan"), 1.0]), ("g", [0.0, 0.0]), ("h", [1.0, 1.0]), ("i", [float("inf"), 1.0])]
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0])], "query_id int, vector array<double>")
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    for size in (search.QUERY_BYTES, 16):
        got = search.dense(asked, vectors, query_bytes=size).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["chunk_id"], round(r["score"], 6)) for r in got] == [(1, "a", 1.0), (1, "h", 0.707107), (2, "b", 0.0)]
    assert search.dense(asked.limit(0), vectors).count() == search.dense(asked, vectors.limit(0)).count() == 0


def test_shown_markdown_loads_nothing(spark):
    text = "![](https://x/?q) ![cat](y.png) ![z][ref] [out](https://x) [in](#a) [1][2]\n[ref]: https://x y\n<b>raw</b>"
    want = "[image removed: no description] [image removed: cat] z out [in](#a) [\\[1\\]](#k-source-1)[\\[2\\]](#k-source-2)\n\n<b>raw</b>"
    assert value(spark, T.safe_markdown(F.lit(text), "k-")) == want


def test_boilerplate_brings_no_pairs_together(spark):
    """A long passage in every document, and pairs as by brute force."""
    rng = np.random.default_rng(2)
    common = " ".join(f"legal{x}" for x in "abcdefghijklmnopqrstuvwxyz" * 2)
    texts = [f"{common} " + " ".join(f"own{x}q" for x in rng.choice(list("abcdefgh"), 30)) for _ in range(40)]
    texts += [texts[0] + " more", texts[1][:-1], common, common + " tail"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    signed = dedup.signatures(d, "doc_id", "text")
    heads = {r["class"]: r["id"] for r in signed.groupBy("class").agg(F.min("chunk_id").alias("id")).collect()}
    got = {tuple(sorted((heads[r["class_a"]], heads[r["class_b"]]))) for r in dedup.class_pairs(signed).collect()}
    runs = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in enumerate(texts)}
    assert got == {(a, b) for a in runs for b in runs if a < b and runs[a] != runs[b] and 10 * len(runs[a] & runs[b]) >= 9 * len(runs[a] | runs[b])} and got
    assert len(dedup.frequent_buckets(signed)) >= 26


def test_ask_with_outcomes(spark):
    q = spark.createDataFrame([(i, "how to renew?") for i in range(1, 6)], "query_id int, question string")
    kind = "query_id int, rank int, source string, page int, heading string, text string, rerank_score double, dense_score double"
    hits = spark.createDataFrame([(i, 1, "vpn.md", None, "Renew", "run the renew command", 3.0, 0.8) for i in range(1, 6)], kind)
    parts = spark.createDataFrame([(1, 1.0, False, False), (2, 0.5, True, False), (3, 0.5, False, True), (4, 1.0, False, False)], "query_id int, completeness double, incomplete boolean, missing_part boolean")
    failures = spark.createDataFrame([(4, "timeout", False), (1, None, True)], "query_id int, failed string, truncated boolean")
    got = {r["query_id"]: r for r in answers.ask(q, hits, lambda p: F.lit("Run the renew command [1]."), parts=parts, failures=failures).collect()}
    assert {i: r["code"] for i, r in got.items()} == {1: "answered", 2: "partial", 3: "answered", 4: "error.timeout", 5: "answered"}
    assert "truncated" in got[1]["flags"] and got[1]["score"] <= 0.5 and "incomplete" in got[2]["flags"] and "missing_part" in got[3]["flags"] and "missing_part" in got[5]["flags"] and got[4]["answer"] is None


def test_sources_get_their_texts(spark):
    hits = spark.createDataFrame([(1, 2, "a", "H", "later"), (1, 1, "a", "H", "text")], "query_id int, rank int, source string, heading string, text string")
    got = answers.with_texts(spark.createDataFrame([(1, "a", "H"), (1, "b", "H")], "query_id int, source string, heading string"), hits)
    assert {r["source"]: r["text"] for r in got.collect()} == {"a": "text", "b": None}


def test_only_good_answers_are_kept(spark):
    rows = [(1, "q", 0, "error"), (2, "q", 60, "answered"), (3, "q", 120, "answered"), (4, "q", 3700, "unverified"), (5, "q", 3720, "answered"), (6, None, 0, "partial"), (7, None, 5, "error")]
    e = spark.createDataFrame(rows, "event_id int, k string, s int, status string").withColumn("ts", F.timestamp_seconds("s"))
    assert {r["event_id"]: r["hit"] for r in limits.cache_hits(e, ["k"]).collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}
    assert limits.cache_hits(e.limit(0), ["k"]).count() == 0


def test_search_without_an_index(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert [r["degraded"] for r in search.empty_index(q, q.limit(0)).collect()] == [["empty_index"]] * 2 and search.empty_index(q, q).count() == 0


def test_cache_takes_each_key_once(spark):
    kind = "key string, vector array<double>"
    cache = spark.createDataFrame([("a", [1.0])], kind)
    got = index.cached(cache, spark.createDataFrame([("a", [2.0]), ("b", [3.0]), ("b", [3.0])], kind))
    assert sorted((r["key"], r["vector"]) for r in got.collect()) == [("a", [1.0]), ("b", [3.0])]


def test_strategies(spark):
    s = spark.createDataFrame([(1, "s", 0, "some text", "h", None)], "doc_id int, source string, section_no int, text string, heading string, page int")
    assert chunking.chunked(s, "fixed").count() == 1
    with pytest.raises(ValueError, match="unknown"):
        chunking.chunked(s, "other")


def test_metrics_by_strategy(spark):
    rows = [("fixed", 1, 0, 3), ("fixed", 2, 0, None), ("whole", 1, 0, 1), ("whole", 2, 0, 7)]
    got = {r["strategy"]: r for r in evaluation.retrieval_metrics(spark.createDataFrame(rows, "strategy string, query_id int, evidence_no int, evidence_rank int"), by=[F.col("strategy")]).collect()}
    assert (got["fixed"]["recall_at_5"], got["whole"]["recall_at_20"], got["whole"]["mrr"]) == (0.5, 1.0, round((1 + 1 / 7) / 2, 4))


def test_compatibility_forms_are_folded(spark):
    import unicodedata

    assert value(spark, T.tokens(F.lit("ＥＲＲ＿４０１２ ﬁx x²"))) == ["err_4012", "err", "4012", "fix", "x2"]
    assert value(spark, T.says_not_found(F.lit("I couldn’t ﬁnd this in the documents at all"), "I couldn't find this in the documents.")) is True
    odd = [c for c in T.FORMS if c not in T.TYPOGRAPHIC]
    rows = spark.createDataFrame([(c,) for c in [*odd, "é", "ß", "日", "plain", "naïve “x”"]], "t string")
    got = {r["t"]: r["f"] for r in rows.select("t", T.folded(F.col("t")).alias("f")).collect()}
    assert all(got[c] == unicodedata.normalize("NFKC", c).lower() for c in odd if len(c.lower()) == 1 and c not in "ſ") and got["é"] == "é" and got["naïve “x”"] == 'naïve "x"'


def test_near_duplicates_need_little_disk(spark, tmp_path):
    """Recurring shingles bring no texts together, and sets of shingles aren't stored; pairs as by brute force over many sizes."""
    rng = np.random.default_rng(5)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "abc"]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(30, 400, 300)]
    for t in texts[:60]:
        own = t.split()
        for at in rng.integers(0, len(own), rng.integers(1, 3)):
            own[at] = "other"
        texts.append(" ".join(own))
    d = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string").where("length(text) >= 120")
    signed = dedup.signatures(d)
    heads = {r["class"]: r["id"] for r in signed.groupBy("class").agg(F.min("chunk_id").alias("id")).collect()}
    runs = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in enumerate(texts) if len(t) >= 120}
    want = {(a, b) for a in runs for b in runs if a < b and runs[a] != runs[b] and 10 * len(runs[a] & runs[b]) >= 9 * len(runs[a] | runs[b])}
    root = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    stored = lambda: sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    before = stored()
    got = {tuple(sorted((heads[r["class_a"]], heads[r["class_b"]]))) for r in dedup.class_pairs(signed).collect()}
    assert got == want and len(want) > 20
    assert stored() - before < 0.7 * 8 * sum(map(len, runs.values()))


def test_keyword_scores_in_bounded_memory(spark):
    """No task holds (question, passage) rows in an aggregate; blocks of questions change nothing; ranks as by the formula."""
    rng = np.random.default_rng(3)
    words = [f"w{x}q" for x in "abcdefghijklmnopqrst"]
    passages = [(i, "ab"[i % 2] if i % 7 else None, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(2500)]
    asks = [(i, " ".join(rng.choice(words, 4))) for i in range(6)]
    d = spark.createDataFrame(passages, "doc_id int, lang string, text string").repartition(3)
    q = spark.createDataFrame(asks, "query_id int, text string")
    for by in (False, True):
        tokens = search.tokenised(d, "doc_id", "text", F.col("lang") if by else None, search.asked_tokens(q))
        got = search.sparse(q, search.postings(tokens), search.corpus_statistics(tokens), by_collection=by)
        assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
        again = search.sparse(q, search.postings(tokens), search.corpus_statistics(tokens), by_collection=by, small=10)
        want = set()
        for group in ([c for c in "ab"] if by else [None]):
            own = [(i, t.split()) for i, c, t in passages if not by or c == group]
            mean = sum(len(t) for _, t in own) / len(own)
            df = {w: sum(w in t for _, t in own) for w in words}
            for n, text in asks:
                scores = []
                for i, t in own:
                    score = sum(np.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in text.split())
                    scores += [(-round(score, 9), i)] if score > 0 else []
                want |= {(n, i, rank, group) for rank, (_, i) in enumerate(sorted(scores)[:10], 1)}
        for found in (got, again):
            assert {(r["query_id"], r["chunk_id"], r["rank"], r["collection"] if by else None) for r in found.collect()} == want


def test_folded_characters_are_found_in_few_steps(spark):
    """The class holds exactly its characters, and no list of ranges that is tried one by one is long."""
    listed = set(T.FOLDED_FROM + "".join(T.LIGATURES))
    pattern = T._char_class("".join(listed))
    rows = [(chr(c),) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + [("\U0001d400",)]
    assert {r["c"] for r in spark.createDataFrame(rows, "c string").where(F.col("c").rlike(pattern)).collect()} == listed
    assert max(flat.count("-") for flat in re.findall(r"\[([^\[\]&]*)\]", pattern)) <= 4


def test_chunks_are_made_some_at_a_time(spark):
    """Whatever a batch holds, its chunks are made of some rows at a time."""
    text = "one two three. " * 200
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": [text] * 5000})
    made = list(chunking._cutter(lambda t: chunking.pieces(t, 800, 120))(iter([batch])))
    each = len([x for x in chunking.pieces(text, 800, 120) if x.strip()])
    assert sum(b.num_rows for b in made) == 5000 * each and max(b.num_rows for b in made) <= chunking.CUT_ROWS * each


def test_semantic_chunks_of_many_documents_at_once(spark):
    """Only units with neighbours are embedded, for many documents in one call, and no document has a Python call of its own."""
    calls = []

    def embed(texts):
        calls.append(len(texts))
        return chunking.hashed_words(texts)

    long = "\n\n".join(f"{w} " * 40 for w in ("alpha", "bravo", "delta", "gamma", "omega"))
    sections = [[{"section_no": n, "source": "s", "heading": "h", "page": None, "text": t} for n, t in enumerate(["a line", long, "a line"])]] * 100
    kind = pa.list_(pa.struct([("section_no", pa.int32()), ("source", pa.string()), ("heading", pa.string()), ("page", pa.int32()), ("text", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(sections, kind)], names=["doc_id", "sections"])
    made = pa.Table.from_batches(chunking._semantic(embed, ".md", 800, 25, 250)(iter([batch])))
    assert calls == [500]
    first = [r for r in made.to_pylist() if r["doc_id"] == 0]
    assert [r["chunk_index"] for r in first] == list(range(len(first))) and [r["_repeat"] for r in first if r["text"] == "a line"] == [1, 2]
    s = chunking.line_sections(spark.createDataFrame([(1, "a\nb", "s")], "doc_id int, text string, source string"))
    assert "InPandas" not in chunking.semantic(s, chunking.hashed_words)._jdf.queryExecution().executedPlan().toString()


def test_terms_within_one_text_only(spark):
    """What begins in one text and ends in the next is not held; a term that was found is not sought again."""
    texts, ends = evaluation._joined(pa.array(["ab", "", "céd", "xab"]))
    assert [evaluation._within(texts, ends, x.encode()) for x in ("ab", "bc", "bcé", "éd", "dx", "b", "abx", "xab")] == [True, False, False, True, False, True, False, True]
    d = spark.createDataFrame([("Ab",), ("cd",), (None,), ("xBc",)], "text string").coalesce(1)
    terms = spark.createDataFrame([("bc",), ("bcd",), ("",), ("CD",), ("zz",), (None,)], "term string")
    got = evaluation.absent_terms(terms, d)
    assert sorted(r["term"] for r in got.collect()) == ["bcd", "zz"]
    assert "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_listing_reads_its_tables_once(spark, tmp_path):
    kind = "doc_id int, source string, chunk_id int"
    spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "c", 3)], kind).write.parquet(f"{tmp_path}/chunks")
    spark.createDataFrame([(1, "z", 4), (3, "d", 5)], kind).write.parquet(f"{tmp_path}/copies")
    listed = index.listing(spark.read.parquet(f"{tmp_path}/chunks"), spark.read.parquet(f"{tmp_path}/copies"))
    assert sorted(tuple(r) for r in listed.collect()) == [(1, "a", 2, 1), (2, "c", 1, 0), (3, "d", 0, 1)]
    assert listed._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
