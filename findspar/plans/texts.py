"""Queries over texts: identity, cleaning, tokens, chunks, parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findspar.functions import text as T
from findspar.operators import chunking
from findspar.plans import _sql as S
from findspar.session import spread_small
from findspar.sources import html, pdf

NAMED = ("src0", "src1")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread_small(spark.read.parquet(f"{sf}/{name}.parquet"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def path_of() -> F.Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def doc_identity(spark, sf):
    return docs(spark, sf).select("doc_id", T.doc_id_of(path_of()).alias("path_id"), T.collection_of(path_of(), NAMED).alias("collection"), T.cache_key("model-1", F.col("text")).alias("cache_key"), T.visitor_key(F.concat(F.lit("10.0.0."), F.col("doc_id").cast("string"), F.lit(", 10.1.1.1"))).alias("visitor"))


def clean_text(spark, sf):
    c = T.clean(F.col("text"))
    return docs(spark, sf).select("doc_id", F.length(c).alias("n_chars"), F.md5(F.encode(c, "UTF-8")).alias("digest"))


def noise_signals(spark, sf):
    return docs(spark, sf).select("doc_id", *T.noise(F.col("text")))


def tokenize_counts(spark, sf):
    t = docs(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.md5(F.encode(F.array_join("t", " "), "UTF-8")).alias("digest"))


def shingles_and_facts(spark, sf):
    t = docs(spark, sf).select("doc_id", T.shingles(F.col("text")).alias("s"), T.facts(F.col("text")).alias("f"))
    return t.select("doc_id", F.size("s").cast("bigint").alias("n_shingles"), F.md5(F.encode(F.array_join(F.array_sort("s"), "|"), "UTF-8")).alias("shingles"), F.array_join("f", " ").alias("facts"))


def fixed_chunks(spark, sf) -> DataFrame:
    return chunking.fixed(chunking.whole_text_sections(docs(spark, sf)))


def chunk_fixed(spark, sf):
    return fixed_chunks(spark, sf).select("chunk_id", "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "heading", F.col("char_count").cast("bigint").alias("char_count"))


def chunk_fixed_sections(spark, sf):
    chunks = chunking.fixed(chunking.line_sections(docs(spark, sf)))
    return chunks.select("chunk_id", "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "heading")


def chunk_structure(spark, sf):
    return chunking.structure(chunking.whole_text_sections(docs(spark, sf)))


def chunk_semantic(spark, sf):
    return chunking.semantic(chunking.line_sections(docs(spark, sf)), chunking.hashed_words)


def chunk_size_stats(spark, sf):
    return chunking.size_statistics(fixed_chunks(spark, sf), [F.col("source")])


def repeated_lines(spark, sf):
    """A document's lines that occur more than three times, the five most frequent."""
    lines = docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "").groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n > 3")
    order = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "line")
    return lines.withColumn("rank", F.row_number().over(order)).where("rank <= 5")


def html_sections(spark, sf):
    found = html.sections(table(spark, sf, "pages"))
    return found.select("page_id", F.posexplode("sections").alias("section_no", "s")).select("page_id", "section_no", "s.heading", "s.text")


def _pdf_lines(spark, sf) -> DataFrame:
    """Documents' lines set as pages of thirty, with running headers, numbered, plain and large headings by rule."""
    d = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "raw"))
    p = F.col("p")
    number = F.concat((F.floor(p / 11) % 4 + 1).cast("string"), F.when(p % 22 == 0, ".1").otherwise(""), F.lit(" "), F.array_join(F.slice(F.split("raw", " "), 1, 3), " "))
    page = (F.floor(p / 30) + 1).cast("int")
    text = F.when(p % 30 == 0, F.concat(F.lit("Report "), page.cast("string"))).when(p % 11 == 0, number).when(p % 13 == 5, F.lit("Glossary")).when(p % 13 == 6, F.lit("Some term")).otherwise(F.col("raw"))
    top = (60 + (p % 30) * 22 + F.when(p % 7 == 3, 6).otherwise(0) - F.when(p % 13 == 6, 11).otherwise(0)).cast("double")
    size = F.when(p % 17 == 0, 14.0).otherwise(10.0)
    rows = d.select("doc_id", p.alias("line_no"), page.alias("page"), F.lit(800.0).alias("page_height"), top.alias("top"), (top + size).alias("bottom"), F.least(F.lit(540), 60 + F.length("raw") * 5).cast("double").alias("x1"), text.alias("text"), size.alias("size"))
    return rows.withColumn("bold", (F.col("line_no") % 11 == 0) | (F.col("line_no") % 17 == 0) | (F.col("line_no") % 13).isin(5, 6)).withColumn("segments", F.array("text"))


def pdf_sections(spark, sf):
    found = pdf.sections(_pdf_lines(spark, sf), docs(spark, sf).select("doc_id", F.col("source").alias("title")))
    return found.select("doc_id", F.col("section_no").cast("bigint").alias("section_no"), "heading", F.col("page").cast("bigint").alias("page"), F.md5(F.encode("text", "UTF-8")).alias("text"))


def safe_text(spark, sf):
    """What rendering keeps of conversation turns, and the key under which a repeated question is found."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    return turns.select("conv_id", "turn", F.md5(F.encode(T.safe_markdown(F.col("text")), "UTF-8")).alias("shown"), F.md5(F.encode(T.question_key(F.col("text")), "UTF-8")).alias("key"))


QUERIES = {f.__name__: f for f in (doc_identity, clean_text, noise_signals, tokenize_counts, shingles_and_facts, chunk_fixed, chunk_fixed_sections, chunk_structure, chunk_semantic, chunk_size_stats, repeated_lines, html_sections, pdf_sections, safe_text)}

PATH = "source || '/' || doc_id || '.txt'"
SQL = {
    "doc_identity": f"""SELECT doc_id, substr(sha1({PATH}), 1, 12) AS path_id, CASE WHEN source IN ('src0', 'src1') THEN source ELSE 'demo' END AS collection,
        sha256('model-1' || chr(0) || text) AS cache_key, substr(sha256('10.0.0.' || doc_id), 1, 16) AS visitor FROM documents""",
    "clean_text": f"SELECT doc_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT doc_id, {S.clean('text')} AS c FROM documents)",
    "noise_signals": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in T.NOISE.items()) + " FROM documents",
    "tokenize_counts": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)",
    "shingles_and_facts": f"""WITH w AS (SELECT doc_id, {S.words("text")} AS w, {S.facts("text")} AS f FROM documents)
        SELECT doc_id, len(s) AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS shingles, array_to_string(f, ' ') AS facts FROM (SELECT doc_id, f, {S.shingles("w")} AS s FROM w)""",
    "chunk_fixed": f"WITH {S.FIXED} SELECT chunk_id, doc_id, chunk_index, heading, char_count FROM chunks",
    "chunk_fixed_sections": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) || chr(10) || chr(10) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
        p AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY no) AS e FROM l),
        f AS (SELECT doc_id, string_agg(t, '' ORDER BY no) AS t FROM l GROUP BY doc_id),
        c AS (SELECT doc_id, i * 680 AS at_, regexp_replace(substr(t, i * 680 + 1, 800), '^\s+|\s+$', '', 'g') AS text FROM (SELECT *, unnest(range(0, (greatest(length(t) - 800, 0) + 679) // 680 + 1)) AS i FROM f)),
        h AS (SELECT c.doc_id, c.at_, 'line ' || p.no AS heading, substr(sha1('line ' || p.no || chr(10) || chr(10) || c.text), 1, 12) AS h FROM c JOIN p ON p.doc_id = c.doc_id AND c.at_ >= p.e - length(p.t) AND c.at_ < p.e WHERE c.text <> ''),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY at_) - 1 AS chunk_index, row_number() OVER (PARTITION BY doc_id, h ORDER BY at_) AS r FROM h)
        SELECT doc_id || ':fixed:' || h || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS chunk_id, doc_id, chunk_index, heading FROM n""",
    "chunk_size_stats": f"""WITH {S.FIXED} SELECT source, count(*) AS chunks, min(char_count) AS min_chars, round(quantile_cont(char_count::DOUBLE, 0.5), 4) AS median_chars,
        round(quantile_cont(char_count::DOUBLE, 0.95), 4) AS p95_chars, max(char_count) AS max_chars, count(*) FILTER (char_count < 100) AS tiny FROM chunks GROUP BY source""",
    "repeated_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL HAVING count(*) > 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line) AS rank FROM c) SELECT * FROM r WHERE rank <= 5""",
    "html_sections": r"""WITH s AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[ \t\r\n]+', ' ', 'g'), '<script.*?</script>', '', 'g'), '<style.*?</style>', '', 'g'), '<nav.*?</nav>', '', 'g'), '<footer.*?</footer>', '', 'g'), '<!--.*?-->', '', 'g') AS x FROM pages),
        t AS (SELECT page_id, coalesce(nullif(trim(regexp_extract(x, '<title>(.*?)</title>', 1)), ''), url) AS title, trim(regexp_extract(x, '<h1[^>]*>(.*?)</h1>', 1)) AS h, string_split_regex(regexp_replace(x, '<title>.*?</title>', ''), '<h1[^>]*>.*?</h1>') AS parts FROM s),
        u AS (SELECT page_id, no, CASE WHEN no = 1 THEN title ELSE h END AS heading, regexp_replace(regexp_replace(part, '</?(p|div|ul|ol|li|table|tr|td|th|br|hr|article|section|main|blockquote)[^a-z>]*>|<div [^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text
            FROM (SELECT page_id, title, h, unnest(parts) AS part, generate_subscripts(parts, 1) AS no FROM t)),
        l AS (SELECT page_id, no, heading, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM u),
        e AS (SELECT page_id, no, replace(replace(replace(replace(heading, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS heading, replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text FROM l WHERE text <> '')
        SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY no) - 1)::INTEGER AS section_no, heading, text FROM e""",
    "pdf_sections": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
        lines AS (SELECT doc_id, p AS line_no, p // 30 + 1 AS page, (60 + (p % 30) * 22 + CASE WHEN p % 7 = 3 THEN 6 ELSE 0 END - CASE WHEN p % 13 = 6 THEN 11 ELSE 0 END)::DOUBLE AS top, CASE WHEN p % 17 = 0 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size, least(540, 60 + length(raw) * 5)::DOUBLE AS x1,
            CASE WHEN p % 30 = 0 THEN 'Report ' || (p // 30 + 1) WHEN p % 11 = 0 THEN ((p // 11) % 4 + 1) || CASE WHEN p % 22 = 0 THEN '.1' ELSE '' END || ' ' || array_to_string(string_split(raw, ' ')[1 : 3], ' ') WHEN p % 13 = 5 THEN 'Glossary' WHEN p % 13 = 6 THEN 'Some term' ELSE raw END AS text,
            p % 11 = 0 OR p % 17 = 0 OR p % 13 IN (5, 6) AS bold, max(p // 30 + 1) OVER (PARTITION BY doc_id) AS pages FROM l),
        kept AS (SELECT *, top + size AS bottom FROM lines WHERE NOT (line_no % 30 = 0 AND pages >= 2)),
        sizes AS (SELECT doc_id, size, sum(length(text)) AS n, min(line_no) AS first FROM kept GROUP BY ALL),
        body AS (SELECT doc_id, arg_max(size, (n, -first)) AS body FROM sizes GROUP BY doc_id),
        edges AS (SELECT doc_id, CASE WHEN n > 1 THEN x[low] + (x[low + 1] - x[low]) * (at_ - low) ELSE x[1] END AS right_edge FROM (SELECT *, greatest(1, least(floor(at_)::INT, n - 1)) AS low FROM (SELECT doc_id, list_sort(list(x1)) AS x, count(*)::INT AS n, (count(*) + 1) * 0.9::DOUBLE AS at_ FROM kept GROUP BY doc_id))),
        gaps AS (SELECT doc_id, CASE WHEN lag(page) OVER o = page THEN top - lag(bottom) OVER o END AS gap FROM kept WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
        usual AS (SELECT g.doc_id, quantile_cont(gap, 0.5) AS usual FROM gaps g JOIN body b USING (doc_id) WHERE gap >= 0 AND gap < 2 * body GROUP BY g.doc_id),
        m AS (SELECT b.doc_id, body, right_edge, greatest(coalesce(usual, 0) * 1.5::DOUBLE, coalesce(usual, 0) + 0.3::DOUBLE * body) AS pg FROM body b JOIN edges USING (doc_id) LEFT JOIN usual USING (doc_id)),
        c AS (SELECT k.*, m.body, m.right_edge, m.pg, len(string_split_regex(trim(text), '\s+')) AS words, CASE WHEN regexp_matches(text, '^(\d+(?:\.\d+)*)\.?\s+\S') THEN len(string_split(regexp_extract(text, '^(\d+(?:\.\d+)*)', 1), '.')) WHEN regexp_matches(text, '^Appendix\s+[A-Z]\b\.?\s+\S') THEN 1 END AS number FROM kept k JOIN m USING (doc_id)),
        r AS (SELECT *, CASE WHEN bold AND size >= body - 0.5::DOUBLE AND NOT regexp_matches(text, '(?:\.\s?){{5,}}') AND NOT regexp_matches(text, '(?i)^(?:Fig\.|Figure|Table)\s*\d') THEN
            CASE WHEN number IS NOT NULL THEN CASE WHEN words <= 20 THEN number END WHEN NOT regexp_matches(text, '[.,;]$') AND words <= 8 THEN CASE WHEN lower(text) IN ({", ".join(f"'{x}'" for x in pdf.PARTS)}) OR size > body * 1.15::DOUBLE THEN 1 ELSE 0 END END END AS rank FROM c),
        f AS (SELECT *, lag(page) OVER o AS b_page, lag(bottom) OVER o AS b_bottom, lag(rank) OVER o AS b_rank, lag(size) OVER o AS b_size, lag(x1) OVER o AS b_x1, lag(text) OVER o AS b_text, lag(line_no) OVER o AS b_line FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
        w AS (SELECT *, coalesce(rank IS NOT NULL AND number IS NULL AND b_rank IS NOT NULL AND b_page = page AND top - b_bottom < size AND abs(b_size - size) < 0.2 AND (b_x1 >= 0.9::DOUBLE * right_edge OR regexp_matches(text, '^\p{{Ll}}')), false) AS wrapped,
            coalesce(rank IS NULL AND b_line IS NOT NULL AND b_rank IS NULL AND b_page <> page AND regexp_matches(rtrim(b_text), '[.!?:]$'), false) AS finished, coalesce(b_page = page AND top - b_bottom > pg, false) AS spaced FROM f),
        n AS (SELECT *, sum((rank IS NOT NULL AND NOT wrapped)::INT) OVER o AS heading_no, sum(((rank IS NOT NULL AND NOT wrapped) OR finished)::INT) OVER o AS island FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
        h AS (SELECT doc_id, heading_no, CASE WHEN rank > 0 THEN rank ELSE coalesce(last_value(CASE WHEN number IS NOT NULL THEN number WHEN rank = 1 THEN (lower(text) IN ({", ".join(f"'{x}'" for x in pdf.ENTRY_LISTS)}))::INT END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 END AS level FROM n WHERE rank IS NOT NULL AND NOT wrapped),
        hw AS (SELECT h.*, x.words FROM h JOIN (SELECT doc_id, heading_no, string_agg(text, ' ' ORDER BY line_no) AS words FROM n WHERE rank IS NOT NULL GROUP BY ALL) x ON x.doc_id = h.doc_id AND x.heading_no = h.heading_no),
        path AS (SELECT h.doc_id, h.heading_no, string_agg(g.words, ' > ' ORDER BY g.heading_no) AS path FROM hw h JOIN hw g ON g.doc_id = h.doc_id AND g.heading_no <= h.heading_no
            WHERE NOT EXISTS (SELECT 1 FROM hw x WHERE x.doc_id = h.doc_id AND x.heading_no > g.heading_no AND x.heading_no <= h.heading_no AND x.level <= g.level) GROUP BY ALL),
        i AS (SELECT doc_id, heading_no, island, arg_min(page, line_no) AS page, string_agg(CASE WHEN spaced THEN chr(10) || text ELSE text END, chr(10) ORDER BY line_no) AS text FROM n WHERE rank IS NULL GROUP BY ALL),
        t AS (SELECT *, {S.clean("text")} AS cleaned FROM i)
        SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY island) - 1 AS section_no, coalesce(d.source, '') || coalesce(' > ' || path, '') AS heading, page, md5(cleaned) AS text FROM t LEFT JOIN path p ON p.doc_id = t.doc_id AND p.heading_no = t.heading_no JOIN documents d ON d.doc_id = t.doc_id WHERE cleaned <> ''""",
    "safe_text": r"""WITH a AS (SELECT *, regexp_replace(regexp_replace(text, '(?m)^[ \t]{0,3}\[[^\]]+\]:[ \t]*\S+.*$', '', 'g'), '!\[([^\]]*)\]\[[^\]]*\]', '\1', 'g') AS t FROM conversations),
        b AS (SELECT *, regexp_replace(regexp_replace(t, '!\[\]\([^)]*\)', '[image removed: no description]', 'g'), '!\[([^\]]+)\]\([^)]*\)', '[image removed: \1]', 'g') AS u FROM a)
        SELECT conv_id, turn, md5(regexp_replace(regexp_replace(u, '\[([^\]]+)\]\((?:[^#)][^)]*)?\)', '\1', 'g'), '\[(\d+)\]', '[\\[\1\\]](#source-\1)', 'g')) AS shown,
        md5(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS key FROM b""",
}
