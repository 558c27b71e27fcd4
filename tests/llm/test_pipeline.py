import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from findspar.llm import decontaminate, jaccard, language, mixing, queries, toxicity
from tests.llm.test_text_operators import brute_components


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before each stage, and the result."""
    sf = "/root/testdata/sf0.001"
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], sf).cache())
    return sf, docs


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_of_documents(stages):
    _, docs = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near duplicates", "decontamination", "mixing"]
    assert all(d.columns == docs[0].columns for d in docs[:-1])


def test_toxic_documents_go(spark, stages):
    sf, docs = stages
    scored = toxicity.digest(docs[0], spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(docs[1]) == ids(scored.where("predicted = 0"))


def test_rejected_languages_go(stages):
    _, docs = stages
    assert ids(docs[2]) == ids(language.digest(docs[1]).where("not rejected"))


def test_one_document_of_each_component_stays(stages):
    _, docs = stages
    rows = [(r["doc_id"], r["text"]) for r in docs[2].collect()]
    assert ids(docs[3]) == sorted(doc for doc, _, component in brute_components(rows) if doc == component)


def test_no_passage_is_left(spark, stages):
    sf, docs = stages
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    before, after = decontaminate.digest(docs[3], bench), decontaminate.digest(docs[4], bench)
    assert before.where("n_hit > 0").count() > 0 and after.where("n_hit > 0").count() == 0
    clean = before.where("n_hit = 0").select("doc_id")
    assert docs[3].join(clean, "doc_id").select("doc_id", "text").exceptAll(docs[4].join(clean, "doc_id").select("doc_id", "text")).count() == 0


def test_the_mix_takes_what_was_assigned(stages):
    _, docs = stages
    taken = {r["doc_id"]: r["taken"] for r in mixing.digest(docs[4]).collect() if r["taken"]}
    got = {r["doc_id"]: r["n"] for r in docs[5].groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    assert got == taken


def test_run_gives_the_last_stage(spark, stages):
    sf, docs = stages
    columns = ["position", "doc_id", "pass", "words"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(columns).collect())) == sorted(map(tuple, docs[5].select(columns).collect()))


def test_stages_take_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_take_nulls(spark):
    sf = "/root/testdata/sf0.001"
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (2, "", None, None, 0), (3, "some words here " * 50, None, None, None)], kind)
    kept = [sorted(((r["doc_id"], r["text"] or "") for r in stage(spark, docs, sf).select("doc_id", "text").collect()), key=repr) for _, stage in corpus_pipeline.STAGES]
    every = sorted([(None, ""), (1, ""), (2, ""), (2, ""), (3, "some words here " * 50)], key=repr)
    # nothing toxic; no text of a known language, so no language at all; no two texts with words; no passage; one text with words to mix
    assert kept == [every, [], every, every, [(3, "some words here " * 50)]]


def test_queries_are_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    assert jaccard.SQL in queries.oracle_sql().values()
