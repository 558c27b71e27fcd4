import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findspar.llm import _words as w
from findspar.llm import decontaminate, jaccard, language, licenses, quality, toxicity
from tests.oracle import assert_same, connect

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHOWN = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"N_WORDS": F.lit("x"), "score": F.lit(None).cast("string"), "id": F.lit(1), "found": F.lit(2)}) if extra else df


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA1 é-\n\x00ß😀", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for kind, pattern in ((w.ALNUM, WORD), (w.VISIBLE, SHOWN)):
        got, names = [], {}
        for _, _, hashed, first in w.words(pa.array(texts, pa.string()), kind):
            got += [hashed[first[i] : first[i + 1]].tolist() for i in range(len(first) - 1)]
        want = [pattern.findall(low(t)) for t in texts]
        assert [len(x) for x in got] == [len(x) for x in want]
        for a, b in zip(got, want, strict=True):
            for h, word in zip(a, b, strict=True):
                assert names.setdefault(word, h) == h
        assert len(set(names.values())) == len(names)


def windows(items):
    found = defaultdict(set)
    for i, t in items:
        x = WORD.findall(low(t))
        k = min(8, len(x))
        for j in range(len(x) - k + 1 if k and i is not None and t is not None else 0):
            found[tuple(x[j : j + k])].add(str(i))
    return found


def hits(text, found):
    x = WORD.findall(low(text))
    hit, items = [0] * len(x), set()
    for k in {len(p) for p in found}:
        for j in range(len(x) - k + 1):
            if tuple(x[j : j + k]) in found:
                items |= found[tuple(x[j : j + k])]
                hit[j : j + k] = [1] * k
    return len(x), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2


ITEMS = [(1, "one two three four five six seven eight nine"), (2, "two three four five six seven eight nine ten"), (3, "rare pair"), (4, None), (None, "never seen"), (5, ""), (3, "another text of item three with enough words here"), (10, "a a a a a a a a a a")]
TEXTS = [
    (1, "x One, two THREE four five six seven eight nine ten y"), (2, None), (3, ""), (4, "a rare pair. Rare   pair!"), (4, "a rare pair. Rare   pair!"), (None, "rare pair"), (5, "clean words only"),
    (6, " ".join(["a"] * 300)), (7, LONG + " rare pair " + LONG), (8, "one two three four five six seven"), (9, "rare"), (10, "pair rare"),
]


def test_decontamination_is_that_of_brute_force(spark):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("n_words", F.lit(1))
    found = windows(ITEMS)
    got = decontaminate.digest(docs(spark, TEXTS, True), bench).collect()
    assert sorted(map(repr, ((r[0], *r[1:]) for r in got))) == sorted(map(repr, ((i, *hits(t, found)) for i, t in TEXTS)))
    assert decontaminate.digest(docs(spark, TEXTS), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.digest(docs(spark, []), bench).count() == 0


def test_blocks_of_a_large_benchmark_give_the_same(spark):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    one, name = decontaminate.find(docs(spark, TEXTS), bench)
    many, other = decontaminate.find(docs(spark, TEXTS), bench, block_bytes=40)
    assert sorted(map(repr, one.select(name).collect())) == sorted(map(repr, many.select(other).collect()))


def test_cleaning_removes_spans_and_leaves_clean_texts(spark):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs(spark, [(1, TEXTS[0][1]), (4, "ä rare pair. ö"), (5, "clean words only"), (6, "rare pair"), (7, None)]), bench).collect()}
    assert got == {4: "ä  . ö", 5: "clean words only", 7: None}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_and_locates_every_occurrence(text, patterns):
    index = decontaminate.FMIndex(np.array([*text, 0], np.int64), 2, sample=4)
    flat = np.array([x for p in patterns for x in p], np.int64)
    sizes = np.array([len(p) for p in patterns], np.int64)
    got = {i: sorted(index.locate(np.arange(lo, hi)).tolist()) for i, lo, hi in zip(*(x.tolist() for x in index.search(flat, np.cumsum(sizes) - sizes, sizes)), strict=True)}
    want = {i: [j for j in range(len(text)) if text[j : j + len(p)] == p] for i, p in enumerate(patterns)}
    assert got == {i: x for i, x in want.items() if x}


def test_licenses(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0. All rights reserved."), (2, None), (3, ""), (4, "CC BY here and cc-by there, GNU General Public License"), (4, "CC BY here and cc-by there, GNU General Public License"), (5, "GNU Lesser General Public\nLicense v2.1"), (6, "mit der Zeit"), (7, LONG)]
    got = {r["doc_id"]: r for r in licenses.digest(docs(spark, rows, True)).collect()}
    assert (got[1]["base_labels"], got[1]["labels"], got[1]["n_base"], got[1]["first_word"]) == ("reserved", "apache,reserved", 1, 8)
    assert (got[2]["n_words"], got[2]["labels"], got[2]["first_word"], got[2]["score"]) == (0, "", None, 0.0) == (got[3]["n_words"], got[3]["labels"], got[3]["first_word"], got[3]["score"])
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"], got[4]["base_labels"]) == (3, 0, 8, "cc-by,gpl")
    assert (got[5]["base_labels"], got[5]["labels"]) == ("gpl", "gpl,lgpl") and got[6]["labels"] == ""
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(licenses.rules()) > 300
    assert licenses.digest(docs(spark, [])).count() == 0


def test_keywords_of_licenses_lose_no_match(spark):
    rows = {"(c) 2019 Acme": "copyright", "©2019 Acme": "copyright", "the Expat License": "mit", "“MIT License”": "mit", "FreeBSD License": "bsd-2-clause", "Creative Commons Zero": "cc0", "CC 0 universal": "cc0", "in the public\u00a0domain": "public-domain", "a zero": ""}
    got = {r["doc_id"]: r["labels"] for r in licenses.digest(docs(spark, list(enumerate(rows)))).collect()}
    assert list(rows.values()) == [got[i] for i in range(len(rows))]
    # rules without their keywords find nothing more
    own = licenses.Scanner.get()
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in [*rows, *texts]:
        text = (text or "").lower()
        every = licenses.resolve([(m.start(), -m.end(), licenses.PRIORITY[r.kind], i) for i, r in enumerate(own.rules) for m in r.regex.finditer(text)])
        assert [(own.rules[i].label, a, b) for i, a, b in own.detect(text)] == [(own.rules[i].label, a, b) for i, a, b in every]


#: A sentence for every rule that is written out, and the label it must bring.
SENTENCES = {
    "No part of this publication may be copied.": "reserved", "Unauthorised copying of this file is strictly prohibited.": "reserved", "Copyright by ACME": "copyright", "Redistribution is not permitted": "no-redistribution",
    "for non-commercial use only": "no-commercial-use", "not for commercial purposes": "no-commercial-use", "for personal use only": "no-commercial-use",
    "The above copyright notice and this permission notice shall be included in all copies": "permissive", "Redistributions of source code must retain the above copyright notice": "permissive",
    "Neither the name of the University nor the names of its contributors may be used to endorse": "bsd-3-clause", "All advertising materials mentioning features or use of this software must display": "bsd-4-clause",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS": "bsd", "THE SOFTWARE IS PROVIDED “AS IS”, WITHOUT WARRANTY OF ANY KIND": "mit", "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
    "This software is provided 'as-is', without any express or implied warranty": "zlib", "Altered source versions must be plainly marked as such": "zlib", "to use, reproduce, display, distribute, execute, and transmit the Software": "boost",
    "you may not use this file except in compliance with the License.": "apache", "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND": "apache", "Licensed to the Apache Software Foundation": "apache",
    "This program is free software: you can redistribute it": "gpl", "either version 3 of the License, or (at your option) any later version": "gpl", "You should have received a copy of the GNU Affero General Public License": "gpl",
    "without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "gpl", "with no Invariant Sections, no Front-Cover Texts": "gfdl", "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl",
    "If a copy of the MPL was not distributed with this file": "mpl", "This program and the accompanying materials are made available under the terms of the Eclipse": "epl", "you can use; this is free software; you can redistribute it under the same terms as Perl": "artistic",
    "This is free and unencumbered software released into the public domain": "unlicense", "Everyone is permitted to copy and distribute verbatim copies of this license document": "fsf-verbatim", "To the extent possible under law, the author has waived all copyright": "cc0",
    "no rights reserved": "cc0", "This work is dedicated to the public domain": "public-domain", "This article is licensed under a Creative Commons Attribution": "cc-by", "some rights reserved": "creative-commons",
    "The fonts and derivatives, however, cannot be released under any other type of license": "ofl", "contents of this database are licensed under": "odbl", "© Crown copyright": "crown-copyright", "Open Government Licence v3.0": "open-government",
    "Copying and distribution of this file, with or without modification, are permitted in any medium": "gnu-all-permissive", "If we meet some day, and you think this stuff is worth it": "beerware", "X is a registered trademark of Y": "trademark",
    "patents pending": "patent-pending", "End-User License Agreement": "eula", "By using this site, you agree to": "terms-of-use", "some Public Licence": "public-license", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl", "see www.apache.org/licenses/LICENSE-2.0": "apache",
}


def test_license_labels_and_score_are_those_of_brute_force(spark, sf):
    """All regexes on all texts, each match against all others, and the score's formula."""
    own = licenses.Scanner.get()
    texts = [*SENTENCES, "Under the MIT License or GPL v2; all rights reserved. CC BY-SA 4.0, (c) 2020, general public license", "CC BY " * 50, None]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = {r["doc_id"]: r for r in licenses.digest(docs(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        found = [(licenses.PRIORITY[r.kind], m.start(), m.end(), r) for r in own.rules for m in r.regex.finditer((text or "").lower())]
        stand = [x for x in found if not any(y[1] <= x[1] and y[2] >= x[2] and (y[0] < x[0] or (y[0] == x[0] and (y[1], y[2]) != (x[1], x[2]))) for y in found)]
        spans = {}
        for p, a, b, r in stand:  # of equal spans the first rule's
            spans.setdefault((a, b), (p, r))
        best = {}
        for _, r in spans.values():
            best[r.label] = max(best.get(r.label, 0), licenses.CERTAINTY[r.kind])
        base = set(filter(None, got[i]["base_labels"].split(",")))
        doubt = 0.5 ** len(base)
        for c in best.values():
            doubt *= 1 - c
        assert got[i]["labels"] == ",".join(sorted(base | set(best))) and got[i]["score"] == pytest.approx(1 - doubt), text
        if text in SENTENCES:
            assert SENTENCES[text] in best, text


def test_license_base_is_that_of_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: tuple(r[1:6]) for r in licenses.digest(table).collect()}
    for r in table.collect():
        x = WORD.findall(low(r["text"]))
        at = [(j, label) for p, label in licenses.BASE.items() for j in range(len(x)) if x[j : j + len(p.split())] == p.split()]
        want = (len(x), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({n for _, n in at})))
        assert got[r["doc_id"]] == want


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 9), st.integers(0, 3)), max_size=15))
def test_suppression_is_containment_by_order(raw):
    found = [(s, -(s + n), p, i) for i, (s, n, p) in enumerate(raw)]
    order = sorted(found, key=lambda x: (x[2], x[0] + x[1], x[0], x[3]))
    want = []
    for s, e, p, i in sorted(found, key=lambda x: (x[2], -(-x[1] - x[0]), x[0], x[3])):
        if not any(a <= s and b >= -e for _, a, b in want):
            want.append((i, s, -e))
    assert len(order) == len(found) and sorted(licenses.resolve(found)) == sorted(want)


def test_factorization_machine_learns_a_pair(spark):
    """Label 1 only where an insult meets a group word; each alone is clean, so no additive model separates them well."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(2000):
        insult, group = (rng.random(2) < 0.5).tolist()
        words = [f"filler{rng.integers(400)}" for _ in range(8)] + ["insult"] * insult + ["group"] * group
        rows.append((i, " ".join(words)))
        y.append((i, int(insult and group)))
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame(y, "doc_id bigint, toxic int"))
    test = ["insult group filler1", "insult filler1 filler2", "group filler1 filler2", "filler3 filler4"]
    scores = np.concatenate([model.raw(t, f) for t, f in toxicity.terms(pa.array(test))])
    assert scores[0] > 0 > scores[1:].max()
    i, j = (next(t for t, _ in toxicity.terms(pa.array([x])))[0] for x in ("insult", "group"))
    assert model.factor[i] @ model.factor[j] > 0.5


def test_factorization_machine_learns_a_pair_without_marginals():
    """Label 1 if both of two words are there, or none: neither tells anything alone, so a linear model stays at chance."""
    rng = np.random.default_rng(3)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    texts = [" ".join([f"filler{x}" for x in rng.integers(400, size=8)] + ["one"] * int(i) + ["two"] * int(j)) for i, j in zip(a, b, strict=True)]
    rows = [t[f[i] : f[i + 1]] for t, f in toxicity.terms(pa.array(texts)) for i in range(len(f) - 1)]
    y = (a == b).astype(float)
    model = toxicity.fit(rows[:3000], y[:3000])
    margin = model.raw(np.concatenate(rows[3000:]), np.concatenate([[0], np.cumsum([len(r) for r in rows[3000:]])]))
    assert ((margin >= 0) == (y[3000:] == 1)).mean() > 0.99


def test_factorization_machine_score_is_its_formula():
    """raw() against the sum over all pairs."""
    rng = np.random.default_rng(4)
    model = toxicity.Machine(0.3, rng.normal(size=toxicity.BUCKETS).astype(np.float32), rng.normal(size=(toxicity.BUCKETS, toxicity.FACTORS)).astype(np.float32))
    rows = [rng.choice(toxicity.BUCKETS, n, replace=False) for n in (0, 1, 2, 17)]
    want = [0.3 + sum(model.weight[i].astype(float) for i in r) + sum(model.factor[i].astype(float) @ model.factor[j].astype(float) for k, i in enumerate(r) for j in r[k + 1 :]) for r in rows]
    got = model.raw(np.concatenate(rows).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    assert got == pytest.approx(np.array(want), rel=1e-5)


def test_toxicity_fit_leaves_no_memory_with_the_driver(spark):
    """Training takes well over 100 MB of the driver's Python for a moment; pipelines go on with what is left."""

    def held():
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) / 1024 for line in f if line.startswith("RssAnon"))

    words_ = F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.hex(F.abs(F.xxhash64("doc_id", i)) % (1 << 32)))
    docs = spark.range(0, 5000, 1, 4).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", words_))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    toxicity.learn(docs.limit(50), labels)
    before = held()
    model = toxicity.learn(docs, labels)
    assert model.weight.any() and held() - before < 40


def test_toxicity_edges(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(1, None), (2, ""), (3, LONG), (None, "x"), (5, "a"), (5, "a")]
    got = toxicity.digest(docs(spark, rows, True), labels.where("false")).collect()
    assert len(got) == 6 and all(r["score"] == pytest.approx(0.1) and r["predicted"] == 0 for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3, 5)}
    assert toxicity.digest(docs(spark, []), labels).count() == 0
    a, b = toxicity.digest(d, labels).orderBy("doc_id").collect(), toxicity.digest(d.repartition(7), labels).orderBy("doc_id").collect()
    assert a == b


def test_toxicity_holds_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.digest(d, labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    assert right > 0.93


def brute_components(rows):
    sets = []
    for _, t in rows:
        x = SHOWN.findall(low(t))
        sets.append(frozenset(tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))) if x else frozenset())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    return out


def near_copies(n, seed, size=120, edits=3):
    rng = np.random.default_rng(seed)
    base = [f"word{k}" for k in rng.integers(0, 10**6, size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for k in rng.integers(0, size, edits):
            copy[k] = f"edit{rng.integers(10**6)}"
        out.append(" ".join(copy))
    return out


def test_jaccard_join_is_that_of_brute_force(spark, monkeypatch):
    texts = [*near_copies(70, 1), *near_copies(12, 2, 40, 2), *near_copies(10, 3, 200, 9), "a b c", "A B  c", "a b c d", "a b c d e", "a b c d e f", "a b c d e f", None, "", " \n", "one", LONG, LONG + " x"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, "a b c"), (None, "alone here"), (4, "one"), (4, texts[5])]
    want = sorted(map(repr, brute_components(rows)))
    assert sorted(map(repr, map(tuple, jaccard.digest(docs(spark, rows, True)).collect()))) == want
    # long prefix lists that are chained, and groups dealt over pairs of blocks
    monkeypatch.setattr(jaccard, "PER_PARTITION", 3000)
    d = docs(spark, rows)
    keys = jaccard.partition_keys(spark, 7)
    none = jaccard.Frequent([], [])
    nodes = jaccard.prefixes(jaccard.repeated_blocks(jaccard.shingle_blocks(d.select("text"), keys, none), keys), 7).cache()
    groups = jaccard.connected(jaccard.candidate_edges(nodes, keys, none), "t")
    whole = {(r["node"], r["root"]) for r in jaccard.verify(nodes, groups).collect()}
    parts = jaccard.verify(nodes, groups, group_shingles=800)
    assert parts.where("not whole").count() > 0
    split = {(r["node"], r["root"]) for r in parts.where("whole").collect()} | {(r["node"], r["root"]) for r in jaccard.connected(parts.where("not whole").select(F.col("node").alias("a"), F.col("root").alias("b")), "t2").collect()}
    assert {x for x in whole if x[0] != x[1]} == {x for x in split if x[0] != x[1]}


def test_phrases_take_few_bytes():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(20_000, size=200)) for _ in range(1000)]
    phrases = decontaminate.Phrases([str(i) for i in range(1000)], texts)
    held = sum(x.nbytes for x in vars(phrases).values() if isinstance(x, np.ndarray))
    assert held < 5 * sum(map(len, texts)) and len(phrases.sizes) == 1000 * 193


def test_shingles_of_every_document_change_nothing(spark):
    """Boilerplate in all documents, and thresholds at which nearly all shingles count as frequent."""
    common = " ".join(f"boiler{i}" for i in range(40))
    texts = [*near_copies(12, 1, 60, 2), *near_copies(6, 2, 200, 9), *[f"tail{i % 5}" for i in range(10)], *[f"{'more ' * i}end" for i in range(0, 60, 3)]]
    rows = [(i, f"{common} {t}") for i, t in enumerate(texts)] + [(900, common), (901, None), (902, "")]
    want = sorted(map(repr, brute_components(rows)))
    for frequent_docs, locally in ((20_000, 64), (20, 1), (2, 1)):
        assert sorted(map(repr, map(tuple, jaccard.link(docs(spark, rows), frequent_docs=frequent_docs, locally=locally).collect()))) == want


def test_kept_columns_may_have_any_name(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "z")]
    clash = docs(spark, rows).withColumns({c: F.lit(7) for c in ("_key", "_kept", "_node", "_root", "_row", "count", "n")})
    kept = jaccard.keep_one(clash)
    assert kept.columns == clash.columns and sorted((r["doc_id"], r["_row"], r["_kept"], r["count"]) for r in kept.collect()) == [(1, 7, 7, 7), (2, 7, 7, 7)]


def test_jaccard_edges(spark):
    assert jaccard.digest(docs(spark, [])).count() == 0
    kept = jaccard.keep_one(docs(spark, [(3, "a b c"), (2, "a b c"), (2, "a b c"), (5, None), (6, ""), (9, "z")], True))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 6, 9] and len(kept.columns) == 6


def edited_versions(n, start=0):
    """Sets of 100 shingles of which only successive ones link."""
    return [np.arange(start + 13 * i, start + 13 * i + 100, dtype=np.uint64) for i in range(n)]


def permuted_components(tokens, names, side=None):
    label = jaccard.verified(names, np.full(len(tokens), 100), tokens, side).tolist()
    groups = {frozenset(i for i in range(len(tokens)) if label[i] == own) for own in label}
    return groups


def test_components_do_not_depend_on_the_order_of_nodes():
    chain = edited_versions(4)
    for names in itertools.permutations(range(4)):
        assert permuted_components(chain, list(names)) == {frozenset(range(4))}
    # two stars: leaves differ from their hub and more from each other; the hubs link
    hub = np.arange(1000, 1100, dtype=np.uint64)
    second = np.concatenate([hub[14:], np.arange(9000, 9014, dtype=np.uint64)])
    leaf = lambda base, k: np.sort(np.concatenate([np.delete(base, np.arange(20 + 12 * k, 32 + 12 * k)), np.arange(20_000 + 100 * base[-1] + 50 * k, 20_000 + 100 * base[-1] + 50 * k + 12, dtype=np.uint64)]))
    stars = [hub, second, *[leaf(hub, k) for k in range(3)], *[leaf(second, k) for k in range(3)]]
    rng = np.random.default_rng(8)
    for _ in range(300):
        assert permuted_components(stars, rng.permutation(8).tolist()) == {frozenset(range(8))}
        assert permuted_components([*edited_versions(7), *edited_versions(5, 5000)], rng.permutation(12).tolist()) == {frozenset(range(7)), frozenset(range(7, 12))}
    # across two blocks only links between the blocks count: a chain that alternates is whole
    sides = np.array([0, 1, 0, 1, 0, 1, 0])
    for _ in range(100):
        assert permuted_components(edited_versions(7), rng.permutation(7).tolist(), sides) == {frozenset(range(7))}


def test_rows_that_share_an_id_or_have_none_stay_unless_they_link(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(None, "red apples fall"), (None, "blue rivers run"), (None, "blue rivers run"), (None, None), (None, ""), (7, "first text here"), (7, "second text there"), (3, "first text here"), (8, ""), (8, None), (9, f"{long} a"), (9, f"{long} b"), (5, "alone")]
    want = [(3, "first text here"), (5, "alone"), (7, "second text there"), (8, ""), (8, None), (9, f"{long} a"), (None, ""), (None, "blue rivers run"), (None, "red apples fall"), (None, None)]
    kept = jaccard.keep_one(docs(spark, rows, True).withColumn("_key", F.lit(1)))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr) and len(kept.columns) == 7
    # one null id: no id repeats
    assert sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs(spark, [(None, "x y"), (2, "z"), (1, "z")])).collect()), key=repr) == [(1, "z"), (None, "x y")]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
def test_union_find(edges):
    label = jaccard.union_find(np.array([a for a, _ in edges], int), np.array([b for _, b in edges], int), 16)
    want = list(range(16))
    for a, b in edges:
        x, y = want[a], want[b]
        want = [min(x, y) if v in (x, y) else v for v in want]
    assert label.tolist() == want


def test_connected_spreads_over_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 5)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in jaccard.connected(edges, "chain").collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 3, 5: 3, 3: 3}


def test_quality_is_that_of_brute_force(spark):
    texts = [(i, ("good clean prose here " if i % 2 else "bad spam junk there ") * (1 + i % 3)) for i in range(60)] + [(60, None), (61, "")]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(0, 40)] + [(41, None), (None, 1)], "doc_id bigint, quality int")
    d = docs(spark, texts, True)
    got = {r["doc_id"]: r for r in quality.sample(d, labels, 0.5).collect()}
    ratio = quality.learn(d, labels)
    raw, target, feats = Counter(), Counter(), {}
    for i, t in texts:
        feats[i] = [int(x) for b, _ in quality.features(pa.array([t], pa.string())) for x in b]
        raw.update(feats[i])
        if i in range(1, 40, 2):
            target.update(feats[i])
    n, m = sum(raw.values()), sum(target.values())
    for i in feats:
        weight = 0.0
        for b in feats[i]:
            p = (raw[b] + 1) / (n + quality.BUCKETS)
            weight += np.log((target[b] + quality.BUCKETS * p) / (m + quality.BUCKETS) / p)
        assert got[i]["log_weight"] == pytest.approx(weight) and got[i]["n_grams"] == max(0, 2 * len(WORD.findall(low(dict(texts)[i]))) - 1)
    order = sorted(got.values(), key=lambda r: (-r["gumbel_key"], r["doc_id"]))
    assert {r["doc_id"] for r in order[:31]} == {r["doc_id"] for r in got.values() if r["selected"]}
    assert ratio[feats[1][0]] > 0 > ratio[feats[0][0]]


def test_quality_edges(spark, monkeypatch):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.sample(docs(spark, []), labels).count() == 0
    rows = [(1, "a")] * 5 + [(None, "b")] * 3 + [(i, "c") for i in range(10, 40)]
    monkeypatch.setattr(quality, "EDGE_ROWS", 1)
    monkeypatch.setattr(quality, "BINS", 4)
    got = quality.sample(docs(spark, rows), labels, 0.25).collect()
    assert len(got) == 38 and sum(r["selected"] for r in got) == 10
    assert min(r["gumbel_key"] for r in got if r["selected"]) >= max(r["gumbel_key"] for r in got if not r["selected"])


def kneser_ney(counts, order):
    """Textbook recursion over dictionaries, for one language: p(symbol | context)."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        lower = Counter()
        for g in tables[k + 1]:
            lower[g[1:]] += 1
        tables[k] = lower
    discount = {}
    for k, t in tables.items():
        n1, n2 = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        discount[k] = min(0.95, max(0.1, n1 / max(n1 + 2 * n2, 1) if n1 + n2 else 0.5))

    def p(gram, k, vocabulary):
        if k == 0:
            return 1 / vocabulary
        t = tables[k]
        total = sum(c for g, c in t.items() if g[:-1] == gram[:-1])
        if not total:
            return p(gram[1:], k - 1, vocabulary)
        kinds = sum(g[:-1] == gram[:-1] for g in t)
        return max(t.get(gram, 0) - discount[k], 0) / total + discount[k] * kinds / total * p(gram[1:], k - 1, vocabulary)

    return p


def test_kneser_ney_is_that_of_the_textbook():
    texts = ["abracadabra abra", "banana band", "cab"]
    grams = Counter()
    for _, _, symbol, first in language.letters(pa.array(texts)):
        code, _ = language.grams(symbol, first)
        grams.update(code.tolist())
    keys = np.array(sorted(grams), np.uint64)
    model, = language.build(["x"], keys, np.array([[grams[k]] for k in keys.tolist()], float))
    parts = language.build(["x"], keys, np.array([[grams[k]] for k in keys.tolist()], float), 3)
    as_tuple = lambda k: tuple((k >> 16 * i) & 0xFFFF for i in (3, 2, 1, 0))
    p = kneser_ney(Counter({as_tuple(k): n for k, n in grams.items()}), 4)
    vocabulary = len({k & 0xFFFF for k in grams}) + 1
    asked = []
    for _, _, symbol, first in language.letters(pa.array(["abrand cabana zz"])):
        asked = language.grams(symbol, first)[0]
    want = [np.log(p(as_tuple(k), 4, vocabulary)) for k in asked.tolist()]
    assert np.allclose(model.log_prob(asked)[:, 0], want, atol=1e-4)
    own = language.part_of(asked, 3)
    assert len(set(own.tolist())) == 3
    for p, part in enumerate(parts):
        assert np.allclose(part.log_prob(asked[own == p])[:, 0], np.array(want)[own == p], atol=1e-4)


def test_language_edges(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 3, "en") for i in range(12)] + [(i, "der schnelle braune Fuchs springt über den faulen Hund " * 3, "de") for i in range(12, 24)]
    rows += [(30, None, "en"), (31, "", "en"), (32, "123 !!", "de"), (33, "über Hunde", None), (None, "the dog", "en"), (34, "the dog", None), (34, "the dog", None), (35, "the lazy fox " * 20_000, None), (36, "世界 " * 40, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"LANG_PRED": F.lit(1), "score": F.lit("s")})
    got = language.digest(d).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert [by[i]["lang_pred"] for i in (30, 31, 32)] == ["und"] * 3 and by[33]["lang_pred"] == "de" and by[34]["lang_pred"] == "en" and by[35]["lang_pred"] == "en"
    assert by[30]["rejected"] and by[36]["rejected"] and not by[0]["rejected"] and not by[34]["rejected"]
    assert {i: by[i]["held_out"] for i in range(24)} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(24)}
    none = language.digest(d.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language.digest(d.limit(0)).count() == 0


def test_language_holds_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.digest(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98


def test_thresholds_are_percentiles_of_all_training_rows(spark):
    rng = np.random.default_rng(4)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(12))
    rows = [(i, text("abcdefgh"), "aa") for i in range(6000)] + [(6000 + i, text("stuvwxyz"), "rare") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(d, held=9)
    assert model.langs == ["aa", "rare"]
    scored, name = language.score(d, model)
    limits = language.calibrate(scored, name, model.langs, held=9)
    got = scored.select("lang", f"{name}.*").collect()
    for own, lang in enumerate(model.langs):
        want = np.quantile([-r["total"][own] / r["n"] - language.SHORT / np.sqrt(r["n"]) for r in got if r["lang"] == lang], 0.999) + language.MARGIN
        assert want - 1e-9 <= limits[own] <= want + 2 / language.STEPS


def test_number_of_language_parts_changes_nothing(spark):
    """Also every training gram is in some part: no cut by count or size."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(d, part_cells=20_000)
    assert model.parts > 2
    held = sum(len(model.part(p).by_order[-1].keys) for p in range(model.parts))
    assert held == model.table.select("gram").distinct().count()
    one, many = ({r["doc_id"]: r for r in language.digest(d, part_cells=n).collect()} for n in (language.PART_CELLS, 20_000))
    for i, r in one.items():
        assert (r["lang_pred"], r["rejected"], r["held_out"]) == (many[i]["lang_pred"], many[i]["rejected"], many[i]["held_out"])
        assert r["score"] == pytest.approx(many[i]["score"]) and r["entropy"] == pytest.approx(many[i]["entropy"])


@pytest.mark.parametrize("module", [decontaminate, jaccard])
def test_same_rows_as_sql(module, spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert_same(module.digest(d, b) if module is decontaminate else module.digest(d), connect(sf), module.SQL)
