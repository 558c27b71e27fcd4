"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a run of documents inside a task.  Its words that occur in the
benchmark are numbered; runs of such words that are too short to hold a phrase are
left out (no phrase can touch them), every run ends in a separator, and the
sequence gets a suffix array, its Burrows-Wheeler transform in a wavelet matrix,
and every 16th suffix position as a sample.  All phrases are searched backward at
once through wavelet ranks; occurrences are located by walking to the next
sampled suffix; overlapping occurrences merge into removal spans.

Nothing is shuffled: documents meet the benchmark where they are read.  The
benchmark is broadcast in blocks of about `BLOCK_BYTES` of text, as arrays of about
20 bytes a word; a larger benchmark takes one pass per block, each written to the
shared folder before the next, so neither driver nor tasks ever hold more than one
block.  Phrases are told apart by 64-bit hashes of their words.

Defined results: a null or wordless text has no words and no hits; null item
ids or texts give no phrases; rows of one item id pool their phrases; each
document row is judged alone, so repeated rows repeat their result; an empty
benchmark hits nothing.  Extra columns pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspar.llm import _words as w
from findspar.llm._frames import add_struct, fresh, narrow, written

WINDOW = 8
SAMPLE = 16
BLOCK_BYTES = 24 << 20
FIELDS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:bigint,last:bigint>>, cuts array<struct<start:bigint,end:bigint>>"


class Phrases:
    """All distinct phrases of a benchmark block: places in its sequence of word numbers, about 20 bytes a word."""

    def __init__(self, ids: list[str], texts: pa.Array | list[str], window: int = WINDOW):
        self.items = sorted(set(ids))
        number = {x: i for i, x in enumerate(self.items)}
        hashed, first, names, held = [], [np.zeros(1, np.int64)], [], 0
        for _, _, own, begin in w.words(pa.array(texts, pa.large_string()), w.ALNUM):
            hashed.append(own)
            names.append(w.shingles(own, begin, window)[0])
            first.append(begin[1:] + held)
            held += len(own)
        hashed, first, names = (np.concatenate([*x, np.zeros(0, x[0].dtype)]) if x else np.zeros(0, np.uint64) for x in (hashed, first, names))
        many = np.diff(first)
        windows = np.where(many >= window, many - window + 1, np.minimum(many, 1))
        start = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows).astype(np.int64) + np.arange(len(names)) if len(names) else np.zeros(0, np.int64)
        distinct, at, inverse = np.unique(names, return_index=True, return_inverse=True)
        owner = np.repeat(np.array([number[x] for x in ids], np.int64), windows)
        pairs = np.unique(inverse * np.int64(len(self.items) or 1) + owner)
        self.item_of = (pairs % (len(self.items) or 1)).astype(np.int32)
        self.item_from = np.searchsorted(pairs // (len(self.items) or 1), np.arange(len(distinct) + 1)).astype(np.int32)
        self.sizes = np.minimum(np.repeat(many, windows), window)[at].astype(np.int32)
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0
        self.vocabulary = np.unique(hashed)
        self.symbols = (np.searchsorted(self.vocabulary, hashed) + 2).astype(np.int32)  # 0 ends the sequence, 1 separates runs
        self.from_ = start[at].astype(np.int32)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; only ranks that still tie are sorted again.  The last symbol must be the unique smallest."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    ordered = seq[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            return order
        suffix = order[at]
        nxt = suffix + step
        key = rank[suffix] * np.int64(n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[at], key = suffix[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[at] = new
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step *= 2


class WaveletMatrix:
    """Rank of any symbol in a prefix of the sequence, in one step per bit of the alphabet."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.levels.append((b, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before at[i]."""
        lo, hi = np.zeros_like(at), at
        for b, ones, zeros in self.levels:
            up = ((symbol >> b) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return hi - lo


class FMIndex:
    def __init__(self, seq: np.ndarray, bits: int, sample: int = SAMPLE):
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]  # sa - 1 is -1 for the whole text, whose left neighbour is its end
        self.tree = WaveletMatrix(self.bwt, bits)
        counts = np.bincount(seq, minlength=(1 << bits) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.counts = counts
        marked = sa % sample == 0
        self.marked, self.sampled, self.mark_rank = marked, sa[marked], np.concatenate([[0], np.cumsum(marked)])
        self.n = len(seq)

    def search(self, symbols: np.ndarray, from_: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, lo, hi) of the suffix ranges of all phrases that occur."""
        live = np.arange(len(sizes))
        lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        for k in range(1, int(sizes.max(initial=0)) + 1):
            on = np.flatnonzero(sizes[live] >= k)
            c = symbols[from_[live[on]] + sizes[live[on]] - k]
            if k == 1:  # most phrases end here, without a walk through the tree
                lo[on], hi[on] = self.before[c], self.before[c] + self.counts[c]
            else:
                lo[on] = self.before[c] + self.tree.rank(c, lo[on])
                hi[on] = self.before[c] + self.tree.rank(c, hi[on])
            keep = lo < hi
            live, lo, hi = live[keep], lo[keep], hi[keep]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by steps to the left until a sampled one."""
        out, walk, at = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(at):
            hit = self.marked[walk]
            out[at[hit]] = self.sampled[self.mark_rank[walk[hit]]] + steps
            at, walk = at[~hit], walk[~hit]
            c = self.bwt[walk]
            walk = self.before[c] + self.tree.rank(c, walk)
            steps += 1
        return out


def occurrences(hashed: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, index of its first word) of every occurrence in a shard's words."""
    none = np.zeros(0, np.int64)
    if not len(hashed) or not len(phrases.sizes):
        return none, none
    symbol = np.searchsorted(phrases.vocabulary, hashed)
    known = phrases.vocabulary[np.minimum(symbol, len(phrases.vocabulary) - 1)] == hashed
    opens = np.zeros(len(hashed) + 1, bool)
    opens[first] = True
    start = np.flatnonzero(known & (opens[:-1] | ~np.concatenate([[False], known[:-1]])))
    end = np.flatnonzero(known & (opens[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = end - start >= phrases.shortest
    start, end = start[long], end[long]
    if not len(start):
        return none, none
    sizes = end - start + 1  # and a separator
    begin = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(start - begin[:-1], sizes) + np.arange(begin[-1])
    seq = np.ones(begin[-1] + 1, np.int64)
    words_at = np.ones(begin[-1], bool)
    words_at[begin[1:] - 1] = False
    seq[:-1][words_at] = symbol[source[words_at]] + 2
    seq[-1] = 0
    bits = max(1, int(len(phrases.vocabulary) + 2).bit_length())
    index = FMIndex(seq, bits)
    phrase, lo, hi = index.search(phrases.symbols, phrases.from_, phrases.sizes)
    times = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    return np.repeat(phrase, times), source[index.locate(rows)]


def _scan(column: pa.Array, phrases: Phrases) -> tuple[list, list, list, list, list]:
    n_words, n_hit, items, spans, cuts = [], [], [], [], []
    for _, _, data, offsets in w.slices(column):
        data = w.LOWER[data]
        starts, ends, first = w.spans(data, offsets, w.ALNUM)
        phrase, at = occurrences(w.hashes(data, starts, ends), first, phrases)
        n = len(first) - 1
        own_items: list[list[str]] = [[] for _ in range(n)]
        own_spans: list[list[dict]] = [[] for _ in range(n)]
        own_cuts: list[list[dict]] = [[] for _ in range(n)]
        hit_words = np.zeros(n, np.int64)
        if len(at):
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + phrases.sizes[phrase], -1)
            hit = np.cumsum(edge[:-1]) > 0
            hit_words = w.per_row(hit.astype(np.int64), first)
            opens = np.zeros(len(hit) + 1, bool)
            opens[first] = True
            left = np.flatnonzero(hit & (opens[:-1] | ~np.concatenate([[False], hit[:-1]])))
            right = np.flatnonzero(hit & (opens[1:] | ~np.concatenate([hit[1:], [False]])))
            for a, b, r in zip(left.tolist(), right.tolist(), (np.searchsorted(first, left, "right") - 1).tolist(), strict=True):
                own_spans[r].append({"first": a - int(first[r]), "last": b - int(first[r])})
                own_cuts[r].append({"start": int(starts[a] - offsets[r]), "end": int(ends[b] - offsets[r])})
            row = np.searchsorted(first, at, "right") - 1
            times = phrases.item_from[phrase + 1] - phrases.item_from[phrase]
            where = np.repeat(phrases.item_from[phrase] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            for r, i in np.unique(np.stack([np.repeat(row, times), phrases.item_of[where]], 1), axis=0).tolist():
                own_items[r].append(phrases.items[i])
        n_words += np.diff(first).tolist()
        n_hit += hit_words.tolist()
        items += own_items
        spans += own_spans
        cuts += own_cuts
    return n_words, n_hit, items, spans, cuts


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, name: str = "found") -> tuple[DataFrame, str]:
    """docs with a struct column of what was found, and that column's name.

    Its fields: n_words, n_hit (words inside any occurrence), items (ids with
    occurring windows, sorted as strings), spans (merged runs of hit words, by word
    number) and cuts (the same in bytes of the UTF-8 text).
    """
    items = narrow(benchmark, id=item_id, text=item_text).where("id is not null and text is not null").select(F.col("id").cast("string").alias("id"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // block_bytes) or 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    name = fresh(docs, name)
    for b in range(blocks):
        rows = items.where(block == b).toArrow()  # at most about block_bytes
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(rows["id"].to_pylist(), rows["text"].combine_chunks().cast(pa.large_string()), window))
        schema = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct({"first": pa.int64(), "last": pa.int64()})), "cuts": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))}

        def scan(column: pa.Array, sent=sent, schema: dict = schema) -> list[pa.Array]:
            return [pa.array(x, t) for x, t in zip(_scan(column, sent.value), schema.values(), strict=True)]

        if b == 0:
            docs = add_struct(docs, text, FIELDS, scan, name)
        else:
            more = fresh(docs, f"{name}_more")
            docs = _merged(add_struct(written(docs, "decontaminate"), text, FIELDS, scan, more), name, more)
    return docs, name


def _merged(docs: DataFrame, name: str, more: str) -> DataFrame:
    """Both structs as one: spans that overlap or touch become one."""

    def union(field: str, low: str, high: str, gap: int) -> F.Column:
        both = F.array_sort(F.concat(F.col(f"`{name}`.{field}"), F.col(f"`{more}`.{field}")))

        def add(done: F.Column, x: F.Column) -> F.Column:
            last = F.element_at(done, -1)
            joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last[low].alias(low), F.greatest(last[high], x[high]).alias(high))))
            return F.when((F.size(done) > 0) & (x[low] <= F.try_element_at(done, F.lit(-1))[high] + gap), joined).otherwise(F.concat(done, F.array(x)))

        return F.aggregate(both, F.array().cast(f"array<struct<{low}:bigint,{high}:bigint>>"), add)

    spans = union("spans", "first", "last", 1)
    hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"] + 1)
    struct = F.struct(
        F.col(f"`{name}`.n_words").alias("n_words"), hit.alias("n_hit"),
        F.array_sort(F.concat(F.col(f"`{name}`.items"), F.col(f"`{more}`.items"))).alias("items"),
        spans.alias("spans"), union("cuts", "start", "end", 0).alias("cuts"),
    )
    return docs.withColumn(name, struct).drop(more)


def without_cuts(text: F.Column, cuts: F.Column) -> F.Column:
    """The text without the bytes of its cuts."""
    data = F.encode(text, "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cuts, lambda c: c["end"]))
    ends = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.octet_length(text).cast("bigint")))
    parts = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(data, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    return F.when(F.size(cuts) == 0, text).otherwise(F.array_join(parts, " "))


def digest(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, name = find(narrow(docs, doc_id=doc_id, text=text), benchmark)
    items = F.col(f"{name}.items")
    return found.select(
        "doc_id", F.col(f"{name}.n_words").alias("n_words"), F.col(f"{name}.n_hit").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(items) >= 2).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Pipeline form: documents with two or more items go, and so do those with no words outside their hits; others lose the hit spans."""
    columns = docs.columns
    found, name = find(docs, benchmark, text)
    keep = found.where((F.size(f"{name}.items") < 2) & ((F.col(f"{name}.n_hit") == 0) | (F.col(f"{name}.n_hit") < F.col(f"{name}.n_words"))))
    return keep.select(*[without_cuts(F.col(f"`{c}`"), F.col(f"{name}.cuts")).alias(c) if c == text else F.col(f"`{c}`") for c in columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS k, unnest(list_transform(range(greatest(1, len(w) - 7)), lambda i: array_to_string(w[i + 1 : i + 8], ' '))) AS p FROM b WHERE len(w) > 0
), g AS (
  SELECT doc_id, k, unnest(range(greatest(0, len(w) - k + 1))) AS pos, w FROM d, (SELECT DISTINCT k FROM p)
), h AS (
  SELECT g.doc_id, g.pos, g.k, p.item_id FROM g JOIN p ON p.k = g.k AND p.p = array_to_string(g.w[g.pos + 1 : g.pos + g.k], ' ')
), n AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS x FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
