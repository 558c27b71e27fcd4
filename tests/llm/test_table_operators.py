import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from findspar.llm import mixing, topk, url_lists, warc
from tests.oracle import assert_same, connect

VEC = "vec_id bigint, embedding array<float>"


def brute_topk(rows, step, k):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    pad = [(i, np.array(v + [0] * (width - len(v)))) for i, v in fine]
    out = []
    for q, v in {(i, tuple(x)) for i, x in pad if i % step == 0}:
        scored = sorted((-int(np.dot(v, x)), i) for i, x in pad if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_topk_is_that_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1 + i % 3, 12)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # one vector many times
    rows += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 12), (504, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (505, [0.0] * 12), (506, [2.0, 1.0])]
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "PIVOT_SAMPLE", 64)
    df = spark.createDataFrame(rows, VEC).withColumns({"q": F.lit(1), "BLOCK": F.lit(2)})
    got = sorted(map(tuple, topk.digest(df, step=20).collect()))
    assert got == brute_topk(rows, 20, 5)


def test_topk_edges(spark):
    assert topk.digest(spark.createDataFrame([], VEC)).count() == 0
    assert topk.digest(spark.createDataFrame([(50, [1.0])], VEC)).count() == 0
    got = topk.digest(spark.createDataFrame([(50, [1.0]), (50, [1.0]), (3, [0.5]), (3, [0.5]), (2, [0.5])], VEC)).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(50, 1, 2, 32768), (50, 2, 3, 32768), (50, 3, 3, 32768)]


def test_triangle_inequality_prunes(spark):
    """Well separated clusters: a query visits few of the annuli, and still finds what brute force does."""
    rng = np.random.default_rng(1)
    rows = [(c * 100 + i, [float(x) for x in np.eye(8)[c] * 50 + rng.normal(0, 0.1, 8)]) for c in range(8) for i in range(100)]
    got = sorted(map(tuple, topk.digest(spark.createDataFrame(rows, VEC)).collect()))
    assert got == brute_topk(rows, 50, 5)


DOCS = "doc_id bigint, text string, source string"


def words(n):
    return " ".join(["w"] * n)


def test_targets_reach_the_fixed_point(spark):
    sizes = [("a", 1000), ("b", 5), ("c", 300), ("d", 40), ("e", 7), (None, 2000), ("z", 0)]
    got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    order = sorted((s for s, _ in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    size, total = dict(sizes), sum(n for _, n in sizes)
    target, open_ = {}, set(order)
    while True:  # share, cap, share the excess again
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    target |= share
    assert {s: got[s]["weight"] for s in order} == weight
    for s in order:
        assert got[s]["target"] == pytest.approx(target[s])


def test_mixing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, words(int(rng.integers(0, 60))), ["a", "b", "c", "Z", None][i % 5] if i % 7 else "a") for i in range(400)] + [(1, None, "b"), (1, "x y", "b"), (None, "p q r", "c"), (None, "p q r", "c")]
    monkeypatch.setattr(mixing, "SLOT_ROWS", 25)
    df = spark.createDataFrame(rows, DOCS).withColumns({"SIZE": F.lit("x"), "target": F.lit(0)})
    first = sorted(map(repr, mixing.digest(df).collect()))
    assert first == sorted(map(repr, mixing.digest(df.repartition(5)).collect()))
    got = mixing.assign(df, keep=("source",)).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(0 <= p <= 1 for r in own for p in r["positions"])
    # by the time u a source has taken what its integrated schedule demands
    plan = mixing.schedule(df).collect()
    assert [r["position"] for r in plan] == sorted(r["position"] for r in plan)
    tilt = {r["source"]: (r["target"], r["tilt"]) for r in mixing.targets(df.groupBy("source").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))).alias("source_size"))).collect()}
    for source, (target, t) in tilt.items():
        for u in (0.25, 0.5, 0.8):
            taken = sum(r["words"] for r in plan if r["source"] == source and r["position"] <= u)
            assert abs(taken - target * (u + t * (u * u - u))) <= 60


def test_mixing_edges(spark):
    assert mixing.digest(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.digest(spark.createDataFrame([(1, None, None), (2, "", "a")], DOCS)).collect()
    assert [(r["taken"], r["target"], r["first_position"]) for r in got] == [(0, 0.0, None)] * 2
    one = mixing.digest(spark.createDataFrame([(1, words(100_000), "a")], DOCS)).first()
    assert (one["taken"], one["target"]) == (100_000, 100_000.0)


def test_mixing_is_counted_from_the_range_sorted_order(spark, monkeypatch):
    """The query's rows come from the training order, whose files hold one range of positions each; equal rows and null ids stay apart."""
    made = []
    monkeypatch.setattr(mixing, "written", lambda df, what, f=mixing.written: made.append((what, f(df, what))) or made[-1][1])
    rows = [(i, words(1 + i % 40), ["a", "b", "c", None][i % 4] if i % 7 else "a") for i in range(300)] + [(None, "p q", "c")] * 3 + [(5, "", "b")] * 2 + [(6, "x y z", "b")] * 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(repr, mixing.digest(spark.createDataFrame(rows, DOCS)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = dict(made)["mixing-order"]
    files = order.select("*", F.input_file_name().alias("file")).collect()
    by_file = [[r["position"] for r in files if r["file"] == f] for f in sorted({r["file"] for r in files})]
    assert len(by_file) > 1 and [p for own in by_file for p in own] == sorted(r["position"] for r in files)
    assert sum(r["words"] for r in files) == sum(r["taken"] for r in mixing.assign(spark.createDataFrame(rows, DOCS)).collect())
    want = mixing.assign(spark.createDataFrame(rows, DOCS)).select("doc_id", "size", "source_size", "target", "taken", F.round(F.try_element_at("positions", F.lit(1)), 9).alias("first_position"))
    assert len(got) == len(rows) and got == sorted(map(repr, want.collect()))


PAGES = "page_id bigint, url string, html string"


def pages():
    rng = np.random.default_rng(9)
    noise = lambda n: "".join(chr(c) for c in rng.integers(32, 0x2FFF, n) if not 0xD800 <= c < 0xE000)
    same, short = noise(300), "x" * 99
    rows = [(i, f"http://h{i}.org/ä?q=1", noise(int(rng.integers(0, 3000)))) for i in range(60)]
    return rows + [(70, None, same), (65, "http://a\nb", same), (80, "u", same), (65, "again", same), (None, "n", same), (90, "s", short), (91, "s", short), (92, None, None), (93, "e", ""), (94, "l", noise(400_000))]


def want_pages(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == data]
        first = min(same) if len(data) >= 100 and sum((h or "").encode() == data for _, _, h in rows) > 1 and same else None
        revisit = first is not None and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("split", ["2k", "20k", "128m"])
def test_warc_round_trip(spark, split):
    """Ranges far smaller than a record too: every member is owned once."""
    rows = pages()
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        df = spark.createDataFrame(rows, PAGES).withColumns({"DIGEST": F.lit(1), "first": F.lit("f")}).coalesce(2)
        assert sorted(map(repr, map(tuple, warc.round_trip(df).collect()))) == want_pages(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_warc_files_are_plain_gzip_and_survive_false_starts(spark, tmp_path, monkeypatch):
    """Archives hold stored (uncompressed) members whose payloads are full of gzip magics."""
    evil = "".join(chr(c) for c in b"\x1f\x0b\x08") * 5
    payloads = [(b"\x1f\x8b\x08" * 40 + bytes([i]) * 30 + b"\x1f\x8b\x08\x00\x00") for i in range(30)]
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "a.warc", "wb") as f:
        for i, data in enumerate(payloads):
            packer = zlib.compressobj(0, zlib.DEFLATED, 31)
            f.write(packer.compress(warc.record(str(i), evil, data, hashlib.sha256(data).hexdigest(), None)) + packer.flush())
    for split in ("64b", "333b", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            got = {r["record_id"]: (bytes(r["payload"]), r["valid"]) for r in warc.read(spark, str(tmp_path / "in")).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
            spark.conf.set("spark.sql.files.openCostInBytes", "4m")
        assert got == {f"<urn:page:{i}>": (data, True) for i, data in enumerate(payloads)}
    warc.write(spark.createDataFrame(pages(), PAGES).coalesce(1), str(tmp_path / "out"))
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "out").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == len(pages()) and data.startswith(b"WARC/1.1\r\n")


def test_warc_archives_are_read_whatever_their_name(spark, tmp_path):
    rows = [(str(i), bytes([i]) * 50 + b"payload") for i in range(40)]
    data = b"".join(warc.compress(warc.record(i, None, payload, hashlib.sha256(payload).hexdigest(), None)) for i, payload in rows)
    names = ["a.warc.gz", "b.WARC.GZ", "c!.gz", "d.warc", "e-0.gz", "ä.warc.gz"]
    for name in names:
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    want = sorted((f"<urn:page:{i}>", payload, True) for i, payload in rows for _ in names)
    for split in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            parts = warc.scan(spark, str(tmp_path / "in" / "a.warc.gz")).rdd.getNumPartitions()
            got = sorted((r["record_id"], bytes(r["payload"]), r["valid"]) for r in warc.read(spark, str(tmp_path / "in")).collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
            spark.conf.set("spark.sql.files.openCostInBytes", "4m")
        assert got == want and (split == "128m" or parts > 4)
    warc.write(spark.createDataFrame(pages(), PAGES).coalesce(2), str(tmp_path / "out"))
    written = [p.name for p in (tmp_path / "out").glob("part-*")]
    assert written and all(name.endswith(".warc.gz") for name in written)
    assert warc.read(spark, str(tmp_path / "out")).where("valid").count() == len(pages())


def test_warc_members_whose_first_bytes_hold_a_magic(spark, tmp_path):
    """Too little stands before that magic to tell that a record starts there."""
    members = []
    for i in range(30):
        packed = warc.compress(warc.record(str(i), None, bytes([i]) * 90, hashlib.sha256(bytes([i]) * 90).hexdigest(), None))
        members.append(packed[:3] + b"\x08" + packed[4:10] + b"\x1f\x8b\x08" * (i % 3) + b"name\0" + packed[10:])
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    assert gzip.decompress(b"".join(members)).count(b"WARC/1.1\r\n") == 30
    for split in (*(f"{n}b" for n in (64, 201, 333)), "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            got = sorted((r["record_id"], r["valid"]) for r in warc.read(spark, str(tmp_path)).coalesce(4).collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
            spark.conf.set("spark.sql.files.openCostInBytes", "4m")
        assert got == sorted((f"<urn:page:{i}>", True) for i in range(30)), split


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def brute_urls(captures, entries):
    log = {}
    for domain, day, action, category in set(entries):
        if domain is not None and day is not None:
            log.setdefault((domain.lower(), category or ""), []).append((day, action))
    out = []
    for capture, host, day in captures:
        hit = None
        for (domain, category), events in log.items():
            past = sorted(e for e in events if day is not None and e[0] <= day)
            if host and (host == domain or host.endswith("." + domain)) and past and past[-1][1] == "add":
                hit = min(hit or (0, "~", "~", 0), (-len(domain), domain, category, past[-1][0]))
        out.append((capture, host, hit is not None, hit and hit[1], hit and hit[2], hit and hit[3]))
    return sorted(map(repr, out))


def test_url_lists_are_those_of_brute_force(spark):
    urls = ["http://a.b.example.com/x", "HTTPS://user:pw@Sub.Example.org:80/?q#f", "http://example.com", "ftp://c.example.com./", "no url", None, "http://localhost/", "http://evil.com.example.net/"]
    captures = [(i * 40 + d, u, None if d == 39 else d) for i, u in enumerate(urls) for d in range(40)] + [(None, urls[0], 5), (0, urls[0], 5)]
    entries = [("example.com", 3, "add", "spam"), ("example.com", 9, "remove", "spam"), ("example.com", 9, "remove", "spam"), ("Example.com", 15, "add", "spam"), ("b.example.com", 5, "add", "adult"), ("b.example.com", 20, "remove", "adult"),
               ("example.org", 0, "add", None), ("example.org", 7, "add", None), ("example.org", 8, "add", None), ("example.org", 8, "remove", None), ("localhost", 2, "add", "x"), (None, 1, "add", "x"), ("example.net", None, "add", "x"), ("example.com", 16, "add", "a")]
    c = spark.createDataFrame(captures, "id bigint, url string, day int").withColumns({"host": F.lit(1), "DOMAIN": F.lit(2), "best": F.lit(3)})
    e = spark.createDataFrame(entries, "domain string, day int, action string, category string")
    got = url_lists.evaluate(c, e, "id", "url", "day").select("capture_id", "host", "blocked", "matched_domain", "category", "active_since").collect()
    hosts = ["a.b.example.com", "sub.example.org", "example.com", "c.example.com", None, None, "localhost", "evil.com.example.net"]
    want = brute_urls([(i, hosts[urls.index(u)], d) for i, u, d in captures], entries)
    assert sorted(map(repr, map(tuple, got))) == want
    assert url_lists.evaluate(c.limit(0), e, "id", "url", "day").count() == 0
    assert url_lists.evaluate(c, e.limit(0), "id", "url", "day").where("blocked").count() == 0
    plan = url_lists.evaluate(c, e, "id", "url", "day")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hosts_of_many_labels_are_looked_up_whole(spark):
    host = ".".join(f"l{i}" for i in range(40)) + ".example.org"
    captures = spark.createDataFrame([(1, f"http://{host}/"), (2, f"http://x.{host}/"), (3, "http://l39.example.org/")], "id bigint, url string").withColumn("on", F.lit("2024-02-01").cast("date"))
    entries = spark.createDataFrame([(host, "add", "spam")], "domain string, action string, category string").withColumn("day", F.lit("2024-01-01").cast("date"))
    got = {r["capture_id"]: r["matched_domain"] for r in url_lists.evaluate(captures, entries, "id", "url", "on").collect()}
    assert got == {1: host, 2: host, 3: None}


@pytest.mark.parametrize(("module", "tables", "sql"), [(topk, ["embeddings"], topk.SQL), (mixing, ["documents"], mixing.SQL.replace("{docs}", "documents")), (warc, ["pages"], warc.SQL), (url_lists, ["pages"], url_lists.SQL)])
def test_same_rows_as_sql(module, tables, sql, spark, sf):
    run = module.round_trip if module is warc else module.digest
    assert_same(run(*[spark.read.parquet(f"{sf}/{t}.parquet") for t in tables]), connect(sf), sql)


def test_topk_in_small_blocks_with_repeated_ids(spark, monkeypatch):
    """Many rounds, annuli dealt over several blocks and query groups; rows that share a query id have ranks of their own."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "WIDEN", 2)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(400)] + [(50, [0.5, -0.25, 0.0, 0.75])] + [(900 + i, [0.25] * 4) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in topk.search(frame, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    as_int = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = {}
    for q, v in {(i, tuple(v.tolist())) for i, v in as_int if i % 10 == 0}:
        best = sorted((-int(np.dot(v, w)), i) for i, w in as_int if i != q)[:5]
        want.setdefault(q, []).extend((k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(got[50]) == 10
