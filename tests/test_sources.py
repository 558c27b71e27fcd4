import pytest
from pyspark.sql import functions as F

from findspar.operators import index
from findspar.sources import corpus, html, markdown, pdf
from findspar.streaming import ingest

PAGE = """<html><head><title>Deploy guide</title><style>p{}</style></head><body><nav>menu</nav>
<h1>Deploy <a href="#d">#</a></h1><p>First <b>bold</b> text
 goes on.</p><ul><li><p>one</p></li><li>two</li></ul><script>x()</script>
<h2>Codes</h2><table><tr><th>Code</th><th>Name</th></tr><tr><td>23505</td><td><code>unique</code>_violation</td></tr></table>
<pre>
  a = 1
    b</pre><div id="docComments">bye</div><footer>foot</footer></body></html>"""


def test_html():
    got = html.parse(PAGE, "t")
    assert [s["heading"] for s in got] == ["Deploy", "Deploy > Codes"]
    assert got[0]["text"] == "First bold text goes on.\none\ntwo"
    assert got[1]["text"] == "Code | Name\n23505 | unique_violation\n a = 1\n    b" or got[1]["text"].startswith("Code | Name\n23505 | unique_violation\n")


def test_html_nests_deeply_and_survives_nulls(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html.parse(deep, "t") == [{"text": "x", "heading": "t", "page": None}]
    rows = spark.createDataFrame([(1, None, None), (2, "u", "<p>a<p>b")], "page_id int, url string, html string")
    got = {r["page_id"]: r["sections"] for r in html.sections(rows).collect()}
    assert got[1] == [] and got[2][0]["text"] == "a\nb"


MDX = """---
title: "Secrets"
---
import X from 'y'

# Secrets
Ask <TeamMember name="Lo" /> of <SmallTeam slug="web" />. <CalloutBox title="Careful">Read `<CalloutBox>` first.</CalloutBox>
<!-- note
over lines -->
Use kubectl cp <source> <NAME> now.{{< note >}}

## Kinds {#kinds}
```bash
# not a heading
<b>kept</b>
```
- [link](http://x) and **bold** *it*
"""


def test_markdown():
    got = markdown.parse(MDX, "t")
    assert [s["heading"] for s in got] == ["Secrets", "Secrets > Kinds"]
    first = got[0]["text"]
    assert "Ask Lo of web team." in first and "Careful" in first and "Read <CalloutBox> first." in first
    assert "<source> <NAME> now.Note:" in first and "note\nover" not in first and "import" not in first
    assert got[1]["text"] == "# not a heading\n<b>kept</b>\n- link and bold it"


def test_corpus(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# H\r\nbody")
    (tmp_path / "y.txt").write_bytes("café".encode("cp1252"))
    (tmp_path / "z.txt").write_text("  ")
    (tmp_path / "n.bin").write_text("?")
    files = corpus.listed(spark, str(tmp_path))
    got = {r["source"]: r for r in corpus.documents(files).collect()}
    assert sorted(got) == ["a/x.md", "y.txt", "z.txt"]
    assert got["a/x.md"]["sections"][0]["text"] == "body" and got["y.txt"]["sections"][0]["text"] == "café" and "no text" in got["z.txt"]["error"]
    done = corpus.documents(files).select("source", "sha256").withColumn("parser_version", F.lit(corpus.PARSER_VERSION))
    assert corpus.changed(files, done).count() == 0
    manifest = spark.createDataFrame([("gone.md",)], "path string")
    try:
        corpus.listed(spark, str(tmp_path), manifest)
        raise AssertionError
    except FileNotFoundError as e:
        assert "gone.md" in str(e)


def test_pdf_lines(spark):
    def line(no, page, top, text, size=10.0, bold=False, x1=500.0):
        return ("d", no, page, 800.0, float(top), float(top + size), x1, text, size, bold, [text])

    rows = [line(0, 1, 20, "Report 1"), line(1, 1, 100, "1 Introduction", 10.0, True), line(2, 1, 115, "This is the first line"), line(3, 1, 127, "and the second."), line(4, 1, 180, "A new paragraph that"),
            line(5, 2, 20, "Report 2"), line(6, 2, 100, "goes over the page."), line(7, 2, 130, "1.1 Scope", 10.0, True), line(8, 2, 145, "Scope text."), line(9, 3, 20, "Report 3"), line(10, 3, 100, "More text here.")]
    kind = "doc_id string, line_no int, page int, page_height double, top double, bottom double, x1 double, text string, size double, bold boolean, segments array<string>"
    got = pdf.sections(spark.createDataFrame(rows, kind), spark.createDataFrame([("d", "T")], "doc_id string, title string")).orderBy("section_no").collect()
    assert [r["heading"] for r in got] == ["T > 1 Introduction", "T > 1 Introduction > 1.1 Scope", "T > 1 Introduction > 1.1 Scope"]
    assert got[0]["text"] == "This is the first line\nand the second.\n\nA new paragraph that\ngoes over the page." and [r["page"] for r in got] == [1, 2, 3]


def test_pdf_headings(spark):
    """Wrapped headings, nesting below numbers, entry lists, captions and pages that begin after a sentence's end."""

    def line(no, page, top, text, size=10.0, bold=False, x1=500.0, parts=None):
        return ("d", no, page, 800.0, float(top), float(top + size), x1, text, size, bold, parts or [text])

    rows = [
        line(0, 1, 100, "2 Long heading that", 10.0, True), line(1, 1, 112, "wraps here", 10.0, True, 200.0), line(2, 1, 140, "Body one."),
        line(3, 2, 100, "New page section,"), line(4, 3, 100, "same section."), line(5, 3, 130, "Note well", 10.0, True, 100.0), line(6, 3, 150, "Under note."),
        line(7, 3, 170, "Table 3 Things", 10.0, True), line(8, 3, 190, "2.1 Deep", 10.0, True, 300.0, ["2.1", "Deep"]), line(9, 3, 220, "Glossary", 10.0, True, 90.0), line(10, 3, 235, "Term", 10.0, True, 90.0),
        line(11, 3, 290, "Meaning."), line(12, 3, 302, "A bold sentence, which ends.", 10.0, True), line(13, 3, 400, "1.......... 7", 10.0, True),
        line(14, 4, 100, "Big Title", 14.0, True), line(15, 4, 130, "Last."), line(16, 4, 150, "(continued on next page)"),
    ]
    kind = "doc_id string, line_no int, page int, page_height double, top double, bottom double, x1 double, text string, size double, bold boolean, segments array<string>"
    got = pdf.sections(spark.createDataFrame(rows, kind), spark.createDataFrame([("d", None)], "doc_id string, title string")).orderBy("section_no").collect()
    assert [(r["section_no"], r["heading"], r["page"]) for r in got] == [
        (0, " > 2 Long heading that wraps here", 1), (1, " > 2 Long heading that wraps here", 2), (2, " > 2 Long heading that wraps here > Note well", 3), (3, " > Glossary > Term", 3), (4, " > Big Title", 4),
    ]
    assert [r["text"] for r in got] == ["Body one.", "New page section,\nsame section.", "Under note.\nTable 3 Things", "Meaning.\nA bold sentence, which ends.\n\n1.......... 7", "Last."]
    assert pdf.sections(spark.createDataFrame([], kind), spark.createDataFrame([], "doc_id string, title string")).count() == 0
    titles = spark.createDataFrame([("Report.docx",), (" untitled",), (" Real title ",), (None,), ("",)], "t string")
    assert [r["t"] for r in titles.select(pdf.usable_title(F.col("t")).alias("t")).collect()] == [None, None, "Real title", None, None]


def test_streamed_files_of_one_name_are_different_documents(spark, tmp_path):
    for folder, text in (("a", "# H\none"), ("b", "# H\ntwo")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "readme.md").write_text(text)
    table = index.VersionedTable(spark, str(tmp_path / "t"))
    ingest.ingest(spark, ingest.file_stream(spark, str(tmp_path / "in")), table, str(tmp_path / "c")).awaitTermination()
    assert sorted((r["source"], r["text"]) for r in table.read().collect()) == [("a/readme.md", "one"), ("b/readme.md", "two")]


def test_stream_replaces_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.md").write_text("# H\none")
    table = index.VersionedTable(spark, str(tmp_path / "t"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"))
    ingest.ingest(spark, stream, table, str(tmp_path / "c")).awaitTermination()
    assert [r["text"] for r in table.read().collect()] == ["one"]
    (tmp_path / "in" / "y.md").write_text("# H\ntwo")
    ingest.ingest(spark, stream, table, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["text"] for r in table.read().collect()) == ["one", "two"]


def test_stream_limiter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.range(6).select(F.lit("v").alias("visitor"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 900 + 1_700_000_000).alias("ts"))
    rows.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.limited(stream, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["event_id"]: r["admitted"] for r in spark.table("limited").collect()}
    assert [got[i] for i in range(6)] == [True, True, False, False, True, True]


def test_sinks(spark, tmp_path):
    from findspar.sources import sinks

    files = spark.createDataFrame([("a.md", bytearray(b"# H\nx")), ("b.txt", bytearray(b" "))], "source string, content binary")
    parsed = corpus.documents(files)
    sinks.processed_json(parsed, str(tmp_path / "json"))
    assert [r["source"] for r in spark.read.json(str(tmp_path / "json")).collect()] == ["a.md"]
    assert [r["source"] for r in sinks.new_raw(files, parsed.where("source = 'a.md'")).collect()] == ["b.txt"]
    sinks.append_lines(files.select("source"), str(tmp_path / "lines"))
    sinks.append_lines(files.select("source"), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    try:
        sinks.new_raw(spark.createDataFrame([("../x", bytearray(b""))], "source string, content binary"), parsed)
        raise AssertionError
    except ValueError as e:
        assert "root" in str(e)


def test_json_records(spark, tmp_path):
    from findspar.sources import records

    (tmp_path / "a.json").write_text('[{"id": 1, "label": "x"},\n {"id": 2, "label": null}]')
    assert [(r["id"], r["label"]) for r in records.json_table(spark, str(tmp_path / "a.json"), "id int, label string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"commit": "c", "run": 1}\n\n{"id": 1}\n{"id": 2, "more": 3}\n')
    assert [r["id"] for r in records.json_lines(spark, str(tmp_path / "b.jsonl"), "id int", "commit").orderBy("id").collect()] == [1, 2]
    assert '"c"' in records.header_of(spark, str(tmp_path / "b.jsonl"), "commit") and records.header_of(spark, str(tmp_path / "b.jsonl"), "none") is None
    (tmp_path / "c.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        records.json_lines(spark, str(tmp_path / "c.jsonl"), "id int").collect()


def test_store_keeps_the_last_good_version(spark):
    kind = f"source string, doc_id string, sha256 string, sections {html.SECTIONS_DDL}, error string"
    good = [("t", "h", None)]
    old = spark.createDataFrame([("a", "1", "s1", good, None), ("b", "2", "s2", good, None), ("c", "3", "s3", None, "bad"), ("d", "4", "s4", good, None)], kind)
    new = spark.createDataFrame([("a", "1", "s9", None, "bad"), ("b", "2", "s8", [("u", "h", None)], None), ("c", "3", "s7", None, "worse"), ("e", "5", "s5", good, None)], kind)
    got = {r["source"]: r for r in corpus.stored(old, new, spark.createDataFrame([("d",)], "source string")).collect()}
    assert {k: (r["sha256"], r["error"], r["sections"] and r["sections"][0]["text"]) for k, r in got.items()} == {"a": ("s1", "bad", "t"), "b": ("s8", None, "u"), "c": ("s7", "worse", None), "e": ("s5", None, "t")}
    assert sorted(r["source"] for r in corpus.section_rows(corpus.stored(old, new)).collect()) == ["a", "b", "d", "e"]


def test_too_long_files_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "MAX_BYTES", 5)
    (tmp_path / "x.txt").write_text("short")
    (tmp_path / "y.txt").write_text("too long")
    files = corpus.listed(spark, str(tmp_path))
    assert {r["source"]: r["content"] is None for r in files.collect()} == {"x.txt": False, "y.txt": True}
    assert {r["source"]: r["error"] for r in corpus.documents(files).collect()} == {"x.txt": None, "y.txt": "ValueError: file too large"}


def test_references_that_nothing_closes_stay(spark):
    page = "<title>a &amp; b&amp</title><h1>a &amp;&amp; b&amp</h1><p class='x&y'>R&D &lt;c&gt &#65; &#65 &amp;lt;</p>"
    rows = spark.createDataFrame([(1, "u", page)], "page_id int, url string, html string")
    assert html.sections(rows).first()["sections"][0].asDict() == {"text": "R&D <c&gt A &#65 &lt;", "heading": "a && b&amp", "page": None}
