"""SQL fragments that several oracle queries share (DuckDB dialect)."""

from findspar.functions.text import FOLDED_FROM, FOLDED_TO, LIGATURES, STOPWORDS

STOP = "[" + ", ".join(f"'{x}'" for x in STOPWORDS) + "]"


def folded(column: str) -> str:
    quoted = FOLDED_TO.replace("'", "''")
    out = f"translate({column}, '{FOLDED_FROM}', '{quoted}')"
    for ligature, letters in LIGATURES.items():
        out = f"replace({out}, '{ligature}', '{letters}')"
    return f"lower({out})"


def words(column: str) -> str:
    return rf"regexp_extract_all({folded(column)}, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')"


def tokens(column: str) -> str:
    parts = rf"list_filter(string_split_regex(x, '[_\-.]'), lambda p: NOT list_contains({STOP}, p))"
    found = rf"regexp_extract_all({folded(column)}, '[a-z0-9]+(?:[_\-.][a-z0-9]+)*')"
    return rf"flatten(list_transform({found}, lambda x: CASE WHEN regexp_matches(x, '[_\-.]') THEN list_concat([x], {parts}) ELSE {parts} END))"


def facts(column: str) -> str:
    w = r"[\p{L}\p{M}\p{N}\p{Pc}]"
    return rf"list_sort(list_distinct(regexp_extract_all({folded(column)}, '[a-z0-9]+(?:[_\-.][a-z0-9]+)+|{w}*\p{{Nd}}{w}*')))"


def shingles(column: str) -> str:
    """Of a column of words."""
    return f"CASE WHEN len({column}) > 0 THEN list_distinct(list_transform(range(greatest(1, len({column}) - 2)), lambda i: array_to_string({column}[i + 1 : i + 3], ' '))) ELSE [] END"


def clean(column: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({column}, chr(13) || chr(10), chr(10)), '(\S)[ \t]+', '\1 ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\s+$', '', 'g')"


# chunks(chunk_id, doc_id, source, text, chunk_index, heading, char_count) of whole documents in fixed windows
FIXED = rf"""
full_text AS (SELECT doc_id, source, lang, {clean("coalesce(text, '')")} || chr(10) || chr(10) AS t FROM documents),
windows AS (SELECT doc_id, source, lang, i, t, unnest(range(0, (greatest(length(t) - 800, 0) + 679) // 680 + 1)) AS i FROM (SELECT *, 0 AS i FROM full_text)),
cut AS (SELECT doc_id, source, lang, i_1 AS i, regexp_replace(substr(t, i_1 * 680 + 1, 800), '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, source, lang, t, unnest(range(0, (greatest(length(t) - 800, 0) + 679) // 680 + 1)) AS i_1 FROM full_text)),
hashed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, substr(sha1(coalesce(source, '') || chr(10) || chr(10) || text), 1, 12) AS h FROM cut WHERE text <> ''),
chunks AS (SELECT doc_id::VARCHAR || ':fixed:' || h || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS chunk_id, doc_id, source, lang, text, chunk_index, source AS heading, length(text) AS char_count
           FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY chunk_index) AS r FROM hashed))
"""
FIXED = "\n".join(x for x in FIXED.split("\n") if not x.startswith("windows AS"))

POSTINGS = f"""
toks AS (SELECT doc_id, lang, {tokens("coalesce(text, '')")} AS w FROM documents),
post AS (SELECT doc_id, lang, len(w) AS length, token, count(*) AS tf FROM (SELECT doc_id, lang, w, unnest(w) AS token FROM toks) GROUP BY ALL),
asked AS (SELECT item_id AS query_id, token, count(*) AS times FROM (SELECT item_id, unnest({tokens("text")}) AS token FROM benchmark) GROUP BY ALL)
"""

SPARSE = POSTINGS + """,
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
freq AS (SELECT token, count(*) AS df FROM post GROUP BY token),
scored AS (SELECT query_id, post.doc_id AS chunk_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
           FROM asked JOIN post USING (token) JOIN freq USING (token), stats GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10)
"""

DENSE = """
unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
qs AS (SELECT item_id AS query_id, v FROM benchmark JOIN unit ON vec_id = item_id),
near AS (SELECT query_id, u.vec_id AS chunk_id, list_cosine_similarity(qs.v, u.v) AS score FROM qs, unit u),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM near) WHERE rank <= 10)
"""


def fused(*lists: tuple[str, float]) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, chunk_id, '{name}' AS list, rank, {weight}::DOUBLE / (60 + rank) AS share FROM {name}" for name, weight in lists)
    ranks = ", ".join(f"max(CASE WHEN list = '{name}' THEN rank END) AS {name}_rank" for name, _ in lists)
    return f"""
parts AS ({rows}),
summed AS (SELECT query_id, chunk_id, sum(share) AS score, {ranks} FROM parts GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS fused_rank FROM summed) WHERE fused_rank <= 20)
"""
