"""N-gram Jaccard join: documents link when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

1. Equal sets form one node (exact copies never meet each other as pairs).
2. Shingles are counted exactly.  A task packs its (shingle, node) pairs by range
   of shingles into compressed blocks; the shuffle moves those blocks, a few bytes
   per pair, and a range's reducer knows how many nodes hold each shingle.
   Shingles of one node can link nothing and go no further.  Shingles that the first
   pass over the texts saw in a large share of the documents (boilerplate; found by
   counting them in `BUCKETS` buckets) don't go to a range's reducer, which would
   hold them all, but straight to their nodes, with their bucket's count.  The order
   of step 3 needs one count for each shingle, the same for every node, not an exact
   one.
3. By node: shingles in the order (count, shingle), rarest first.  Two sets that
   link share a shingle among the first n - ceil(0.75 n) + 1; the ones of count 1
   stand in front, so most nodes have none left there and drop out.
4. Join on prefix shingles, with the length and positional filters, to candidate
   edges.  A long list is not expanded into pairs: sorted by set size, neighbours
   within the length filter are chained, which joins whatever could link.
5. Connected candidates come together once (large groups in pairs of blocks of
   bounded size).  There nodes are held against all others they aren't connected to,
   until those left are all in one component: the suffix
   filter (sizes of the sets' parts between fixed pivots bound the overlap), then
   the exact overlap.  Each pair is verified at most once.
6. Labels of components spread by alternating large-star and small-star steps, all
   in tables; a document gets the smallest id of its component.

Shingles are identified by 48 bits of a 64-bit hash in the join, and sets by a
64-bit hash of their shingles: the chance that a pair of documents is misjudged
is about 1e-9.

Defined results: texts without words, or null, have an empty set and link with
nothing; with fewer than five words the whole sequence is the only shingle; rows that
repeat, or share an id with different texts, are documents of their own that share a
label if their texts link; null ids never are a component's label unless no other
is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findspar.llm import _words as w
from findspar.llm._frames import add_struct, discard, fresh, narrow, written

SHINGLE = 5
FLUSH = 3_000_000  # pairs that a task holds before it packs them
PER_PARTITION = 4_000_000  # pairs that a reducer takes, about
ALL_PAIRS = 48  # prefix lists up to this long are filtered pair by pair, longer ones chained
GROUP_SHINGLES = 3_000_000  # shingles that a block of a large group holds, about
EDGES_PER_FILE = 500_000
PIVOTS = 16
BITS = 48
BUCKETS = 1 << 20  # for finding frequent shingles
FREQUENT_DOCS, FREQUENT_SHARE = 20_000, 0.001  # a frequent shingle's bucket holds so many, and such a share, of the documents
LOCALLY = 64  # documents of a task that make a bucket worth reporting
HUBS = 256


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, _, hashed, first in w.words(column, w.VISIBLE):
        shingle, begin = w.shingles(hashed, first, SHINGLE)
        for i in range(len(begin) - 1):
            yield np.unique(shingle[begin[i] : begin[i + 1]])


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    name = w.mix64(np.array([w.mix64(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))
    return int(name.view(np.int64)[0])


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as byte planes, compressed: planes of high bytes are nearly all zero."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
        used = 8
        while used and not planes[used - 1].any():
            used -= 1
        parts += [np.array([len(a), used], np.uint32).tobytes(), planes[:used].tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(raw):
        n, used = np.frombuffer(raw, np.uint32, 2, at).tolist()
        planes = np.zeros((8, n), np.uint8)
        planes[:used] = np.frombuffer(raw, np.uint8, n * used, at + 8).reshape(used, n)
        out.append(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1))
        at += 8 + n * used
    return out


def _blobs(keys: np.ndarray, bucket: np.ndarray, make) -> Iterator[tuple[int, bytes]]:
    """(key, block) per bucket; bucket must be sorted."""
    if not len(bucket):
        return
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(keys[bucket[a]]), make(a, b)


def _entries(token: np.ndarray, number: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, *rest: np.ndarray) -> bytes:
    """A block of entries in order of token: gaps of tokens, places in a header of nodes (as gaps, with sizes), further values.

    `number` counts in `nodes`, which must be sorted.
    """
    own, inverse = np.unique(number, return_inverse=True)
    return _pack(np.diff(token, prepend=np.uint64(0)), inverse, np.diff(nodes[own], prepend=np.uint64(0)), sizes[own], *rest)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], names=schema.names)


BLOCK = pa.schema([("key", pa.int64()), ("block", pa.binary())])
BLOCK_DDL = "key bigint, block binary"
MARKED = pa.schema([*BLOCK, ("ready", pa.bool_())])


def partition_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions a key that Spark's hash partitioning sends there."""
    rows = spark.range(0, 20 * n + 100, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    found = {r["p"]: r["id"] for r in rows}
    return np.array([found.get(p, p) for p in range(n)], np.int64)


def bucket_of(token: np.ndarray) -> np.ndarray:
    """The bucket of a shingle's 48 bits."""
    return (token >> np.uint64(BITS - 20)).astype(np.int64)


class Frequent:
    """Buckets of frequent shingles, sorted, with their counts: at most 1 / FREQUENT_SHARE of them for each shingle of an average document."""

    def __init__(self, buckets: list[int], counts: list[int]):
        order = np.argsort(np.array(buckets, np.int64))
        self.buckets, self.counts = np.array(buckets, np.int64)[order], np.minimum(np.array(counts, np.int64)[order], (1 << 32) - 1)

    def count(self, token: np.ndarray) -> np.ndarray:
        """The counts of frequent shingles, 0 for others."""
        if not len(self.buckets):
            return np.zeros(len(token), np.int64)
        own = bucket_of(token)
        at = np.minimum(np.searchsorted(self.buckets, own), len(self.buckets) - 1)
        return np.where(self.buckets[at] == own, self.counts[at], 0)


def shingle_blocks(texts: DataFrame, keys: np.ndarray, frequent: Frequent) -> DataFrame:
    """Step 2, first half: blocks of (shingle, node) by range of shingles; of frequent shingles (shingle, node, count) by node."""
    n = np.uint64(len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        shingles: list[np.ndarray] = []
        nodes: list[tuple[int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if shingles:
                names, sizes = np.array([x for x, _ in nodes], np.int64).view(np.uint64), np.array([s for _, s in nodes], np.int64)
                by_name = np.argsort(names)
                token = np.concatenate([shingles[i] for i in by_name]) >> np.uint64(64 - BITS)
                shingles.clear()
                names, sizes = names[by_name], sizes[by_name]
                number = np.repeat(np.arange(len(names), dtype=np.uint32), sizes)
                order = np.argsort(token)
                token, number = token[order], number[order]
                count = frequent.count(token)
                if count.any():
                    bucket = (w.mix64(names) % n).astype(np.int64)[number]
                    on = np.flatnonzero(count)
                    on = on[np.lexsort((token[on], bucket[on]))]
                    ft, fn, fc = token[on], number[on], count[on]
                    for pair in _blobs(keys, bucket[on], lambda a, b: _entries(ft[a:b], fn[a:b], names, sizes, fc[a:b])):
                        yield _batch([(*pair, True)], MARKED)
                    token, number = token[count == 0], number[count == 0]
                for pair in _blobs(keys, (token * n) >> np.uint64(BITS), lambda a, b: _entries(token[a:b], number[a:b], names, sizes)):
                    yield _batch([(*pair, False)], MARKED)
                nodes.clear()
                held = 0

        for batch in batches:
            for own in sets(batch.column("text")):
                if len(own):
                    node = node_of(own)
                    if node not in seen:
                        seen.add(node)
                        shingles.append(own)
                        nodes.append((node, len(own)))
                        held += len(own)
                        if held >= FLUSH:
                            yield from flush()
            if len(seen) > 2_000_000:
                seen.clear()
        yield from flush()

    return texts.mapInArrow(run, f"{BLOCK_DDL}, ready boolean")


def _read_pairs(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """Entries (shingle, number of its node, ...) of all blocks of a partition, then the nodes by number, and their sizes."""
    columns: list[list[np.ndarray]] = [[], []]
    heads, head_sizes, held = [], [], 0
    for batch in batches:
        for data in batch.column("block"):
            gaps, inverse, distinct, sizes, *rest = _unpack(data.as_py())
            values = [np.cumsum(gaps, dtype=np.uint64), inverse.astype(np.uint32) + np.uint32(held), *[r.astype(np.uint32) for r in rest]]
            held += len(distinct)
            heads.append(np.cumsum(distinct, dtype=np.uint64))
            head_sizes.append(sizes.astype(np.int64))
            columns += [[] for _ in values[len(columns) :]]
            for column, value in zip(columns, values, strict=True):
                column.append(value)
    if not heads:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    nodes, at, number = np.unique(np.concatenate(heads), return_index=True, return_inverse=True)
    out = []
    for column in columns:  # each list is freed as soon as it's joined
        out.append(np.concatenate(column))
        column.clear()
    out[1] = number.astype(np.uint32)[out[1]]
    return (*out, nodes, np.concatenate(head_sizes)[at])


def repeated_blocks(blocks: DataFrame, keys: np.ndarray) -> DataFrame:
    """Step 2, second half: shingles of two nodes or more with their counts, in blocks by node; blocks of frequent ones pass through."""
    n = np.uint64(len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            ready = batch.column("ready")
            if ready.true_count:
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(ready) for k in range(2)], schema=BLOCK)
            held.append(batch.filter(pc.invert(ready)))
        token, number, *_, nodes, sizes = _read_pairs(held)
        held.clear()
        if not len(token):
            return
        order = np.argsort(token, kind="stable")
        token, number = token[order], number[order]
        del order
        twin = np.concatenate([token[1:] == token[:-1], [False]])
        twin[1:] |= twin[:-1].copy()
        token, number = token[twin], number[twin]
        # one entry per shingle and node (a node can come from several tasks)
        order = np.lexsort((number, token))
        token, number = token[order], number[order]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (number[1:] != number[:-1])
        token, number = token[first], number[first]
        group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1 if len(token) else np.zeros(0, np.int64)
        count = np.bincount(group)[group] if len(token) else group
        keep = count > 1
        token, number, count = token[keep], number[keep], count[keep]
        bucket = (w.mix64(nodes) % n).astype(np.int64)[number]
        order = np.lexsort((token, bucket))
        token, number, count, bucket = token[order], number[order], count[order], bucket[order]
        if len(token):
            for pair in _blobs(keys, bucket, lambda a, b: _entries(token[a:b], number[a:b], nodes, sizes, count[a:b])):
                yield _batch([pair], BLOCK)

    return blocks.repartition(len(keys), "key").mapInArrow(run, BLOCK_DDL)


NODE = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("prefix", pa.int64()), ("shingles", pa.binary())])
NODE_DDL = "node bigint, n bigint, prefix bigint, shingles binary"


def prefixes(blocks: DataFrame, partitions: int) -> DataFrame:
    """Step 3: nodes whose prefix holds repeated shingles; all their repeated shingles, rarest first, of which `prefix` belong to the prefix.

    The prefix has n - ceil(0.75 n) + 1 shingles, and one more in case two shingles of a set share their 48 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, number, count, nodes, sizes = _read_pairs(batches)
        if not len(token):
            return
        order = np.lexsort((token, count, number))
        token, number = token[order], number[order]
        # a node's frequent shingles can come from several tasks
        once = np.concatenate([[True], (token[1:] != token[:-1]) | (number[1:] != number[:-1])])
        token, number = token[once], number[once]
        edges = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
        names = nodes.view(np.int64)
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = int(sizes[number[a]])
            own = n - (3 * n + 3) // 4 + 2 - max(0, n - (b - a))
            if own > 0:
                rows.append((int(names[number[a]]), n, min(own, b - a), token[a:b].tobytes()))
            if len(rows) >= 5000:
                yield _batch(rows, NODE)
                rows = []
        yield _batch(rows, NODE)

    return blocks.repartition(partitions, "key").mapInArrow(run, NODE_DDL)


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n items' component under the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def hub_edges(token: np.ndarray, node: int, size: int) -> list[tuple[int, int]]:
    """Edges from a node to the hubs of its frequent prefix shingles, and from those to the shingle's own hub, for its size class and the next.

    Two sets that link differ in size by at most 4 / 3, so they share a class.
    """
    level = int(np.log(size) / np.log(4 / 3))
    salt = int(w.mix64(np.array([node], np.int64).view(np.uint64))[0] % np.uint64(HUBS))
    out = []
    for k in (level, level + 1):
        top = w.mix64(token * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        low = w.mix64(top + np.uint64(salt + 1))
        out += [(node, h) for h in low.view(np.int64).tolist()] + list(zip(low.view(np.int64).tolist(), top.view(np.int64).tolist(), strict=True))
    return out


def candidate_edges(nodes: DataFrame, keys: np.ndarray, frequent: Frequent) -> DataFrame:
    """Step 4: edges (a, b) that connect all nodes which could link."""
    many = np.uint64(len(keys))

    def hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for node, n, own, data in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                token = np.frombuffer(data, np.uint64)[:own]
                found.update(hub_edges(token[frequent.count(token) > 0], node, n))
            yield _batch(sorted(found), EDGE)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, node, size, place = [], [], [], []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if token:
                t = np.concatenate(token)
                names, at = np.unique(np.array(node, np.int64).view(np.uint64), return_inverse=True)
                sizes = np.zeros(len(names), np.int64)
                sizes[at] = size
                number, p = np.repeat(at, [len(x) for x in token]), np.concatenate(place)
                order = np.argsort(t)
                t, number, p = t[order], number[order], p[order]
                for pair in _blobs(keys, (t * many) >> np.uint64(BITS), lambda a, b: _entries(t[a:b], number[a:b], names, sizes, p[a:b])):
                    yield _batch([pair], BLOCK)
                for x_ in (token, node, size, place):
                    x_.clear()
                held = 0

        for batch in batches:
            for i in range(batch.num_rows):
                one, n, own, data = (batch.column(k)[i].as_py() for k in range(4))
                tokens = np.frombuffer(data, np.uint64)
                on = np.flatnonzero(frequent.count(tokens[:own]) == 0)
                token.append(tokens[on])
                node.append(one)
                size.append(n)
                place.append(max(0, n - len(tokens)) + on)
                held += len(on)
                if held >= FLUSH:
                    yield from flush()
        yield from flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, number, place, nodes, sizes = _read_pairs(batches)
        if not len(token):
            return
        order = np.lexsort((number, sizes[number], token))
        token, number, place = token[order], number[order].astype(np.int64), place[order].astype(np.int64)
        size = sizes[number]
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        length = np.diff(edges)
        left, right = [], []
        # chains in long lists, and all pairs in short ones: by distance in the sorted list
        group = np.repeat(np.arange(len(length)), length)
        long = length[group] > ALL_PAIRS
        for step in range(1, ALL_PAIRS):
            i = np.flatnonzero(group[:-step] == group[step:]) if len(group) > step else np.zeros(0, np.int64)
            if step > 1:
                i = i[~long[i]]
            if not len(i):
                break
            j = i + step
            fits = 4 * size[i] >= 3 * size[j]  # length filter
            most = 2 + np.minimum(size[i] - place[i], size[j] - place[j]) - 1  # positional filter, with one to spare for the 48 bits
            need = -(-3 * (size[i] + size[j]) // 7)
            fits &= long[i] | (most >= need)
            left.append(i[fits])
            right.append(j[fits])
        if left:
            label = union_find(number[np.concatenate(left)], number[np.concatenate(right)], len(nodes))
            on = label != np.arange(len(nodes))  # a spanning star for each component of this range
            yield pa.RecordBatch.from_arrays([pa.array(nodes[on].view(np.int64)), pa.array(nodes[label[on]].view(np.int64))], schema=EDGE)

    joined = nodes.mapInArrow(entries, BLOCK_DDL).repartition(len(keys), "key").mapInArrow(join, "a bigint, b bigint")
    return joined.union(nodes.mapInArrow(hubs, "a bigint, b bigint")) if len(frequent.buckets) else joined


def connected(edges: DataFrame, what: str) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large-star and small-star steps."""

    def keep(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
        """df as a table of few files (its size is about that of the step before), and its state: count and hash of the rows."""
        df = written(df if rows is None else df.coalesce(1 + rows // EDGES_PER_FILE), what)
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, state = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before = now
        now, after = keep(small, state[0])
        discard(before)
        if after == state:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = after


def verified(nodes: list[int], sizes: np.ndarray, tokens: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """Component label of each node under exact links; with `side`, only links between different sides are looked for.

    A node that has been held against all others outside its component is settled:
    none of its links can be missed any more.  Nodes of what is the largest component
    at the moment are passed over; passes over those left follow until they are all
    in the same component, so that a link between two components had a settled end.
    """
    m = len(nodes)
    label = np.arange(m)
    if m < 2:
        return label
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(m), [len(t) for t in tokens])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    part = (flat >> np.uint64(BITS - 4)).astype(np.int64)
    parts = np.zeros((m, PIVOTS), np.int32)
    np.add.at(parts, (owner, part), 1)
    count = np.ones(m, np.int64)
    biggest = 0
    settled = np.zeros(m, bool)
    waiting = np.lexsort((nodes, -sizes))
    while (label[waiting] != biggest).any():
        for x in waiting.tolist():
            if label[x] == biggest and count[biggest] > 1:
                continue
            settled[x] = True
            other = ~settled & (label != label[x]) & (4 * np.minimum(sizes, sizes[x]) >= 3 * np.maximum(sizes, sizes[x]))
            if side is not None:
                other &= side != side[x]
            rivals = np.flatnonzero(other)
            if not len(rivals):
                continue
            need = -(-3 * (sizes[rivals] + sizes[x]) // 7)
            rivals = rivals[np.minimum(parts[rivals], parts[x]).sum(1) >= need]  # suffix filter
            if not len(rivals):
                continue
            if len(rivals) <= 4:
                linked = [r for r in rivals.tolist() if _links(len(np.intersect1d(tokens[r], tokens[x], assume_unique=True)), sizes[r], sizes[x])]
            else:
                a, b = np.searchsorted(flat, tokens[x]), np.searchsorted(flat, tokens[x], "right")
                times = b - a
                at = np.repeat(a - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                shared = np.bincount(owner[at], minlength=m)[rivals]
                linked = rivals[_links(shared, sizes[rivals], sizes[x])].tolist()
            for r in linked:
                if label[r] != label[x]:
                    keep, gone = label[x], label[r]
                    count[keep] += count[gone]
                    label[label == gone] = keep
            if count[label[x]] >= count[biggest]:
                biggest = label[x]
        waiting = waiting[~settled[waiting]]
    return label


def _links(shared, one, two):
    return 100 * shared >= 75 * (one + two - shared)


LINK = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("whole", pa.bool_())])


def verify(nodes: DataFrame, groups: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Step 5: (node, root, whole) of verified components; `whole` if the group was in one piece, so that the root is final."""
    sized = nodes.select("node", (F.octet_length("shingles") / 8).alias("k")).join(groups, "node")
    weight = sized.groupBy("root").agg(F.ceil(F.sum("k") / group_shingles).cast("int").alias("blocks"))
    where = groups.join(weight, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = nodes.select("node", "n", "shingles").join(where, "node")
    # a pair of blocks (i, j), i <= j, is one piece of work; a group of one block has one
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    work = placed.select("root", "blocks", "own", F.explode(pairs).alias("p"), "node", "n", "shingles").select("root", "blocks", "p.i", "p.j", "own", "node", "n", "shingles")
    work = work.repartition(F.col("root"), F.col("i"), F.col("j")).sortWithinPartitions("root", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        rows: list[tuple] = []

        def done() -> None:
            if not group:
                return
            sides = np.array([g[0] for g in group])
            names = [g[1] for g in group]
            label = verified(names, np.array([g[2] for g in group], np.int64), [np.sort(np.frombuffer(g[3], np.uint64)) for g in group], sides if key[2] != key[3] else None)
            lowest: dict[int, int] = {}
            for name, own in zip(names, label.tolist(), strict=True):
                lowest[own] = min(lowest.get(own, name), name)
            rows.extend((name, lowest[own], key[1] == 1) for name, own in zip(names, label.tolist(), strict=True) if lowest[own] != name or key[1] == 1)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for root, blocks, i, j, own, node, n, data in zip(*columns, strict=True):
                if (root, blocks, i, j) != key:
                    done()
                    key, group = (root, blocks, i, j), []
                group.append((own, node, n, data))
            if len(rows) > 10_000:
                yield _batch(rows, LINK)
                rows.clear()
        done()
        yield _batch(rows, LINK)

    return work.mapInArrow(run, "node bigint, root bigint, whole boolean")


def rooted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent_docs: int = FREQUENT_DOCS, locally: int = LOCALLY) -> DataFrame:
    """doc_id, n_shingles, node, root, component_id of every document row; node and root (the component's node) are null for rows without words."""
    spark = docs.sparkSession
    base = narrow(docs, doc_id=doc_id, text=text)
    id_type = dict(base.dtypes)["doc_id"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, rows = np.zeros(BUCKETS, np.int64), 0, 0
        held: list[np.ndarray] = []
        n_held = 0

        def tally() -> None:
            nonlocal seen, n_held
            if held:
                seen += np.bincount(bucket_of(np.concatenate(held) >> np.uint64(64 - BITS)), minlength=BUCKETS)
                held.clear()
                n_held = 0

        for batch in batches:
            own = []
            for s in sets(batch.column("text")):
                own.append((len(s), node_of(s) if len(s) else None))
                held.append(s)
                n_held += len(s)
                total += len(s)
                if n_held > FLUSH // 2:
                    tally()
            rows, kind = rows + len(own), batch.schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in own], pa.int64()), pa.array([x for _, x in own], pa.int64()), pa.nulls(len(own), pa.int64())], names=["doc_id", "n_shingles", "node", "bucket"])
        tally()
        # buckets that stand out in this task: a frequent shingle does in most
        often = np.flatnonzero(seen >= max(locally, 4 * total / BUCKETS, rows * FREQUENT_SHARE))
        if len(often):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(often), kind), pa.array(seen[often]), pa.nulls(len(often), pa.int64()), pa.array(often)], names=["doc_id", "n_shingles", "node", "bucket"])

    passed = written(base.mapInArrow(name, f"doc_id {id_type}, n_shingles bigint, node bigint, bucket bigint"), "jaccard-docs")
    named = passed.where("bucket is null").select("doc_id", "n_shingles", "node")
    size = named.agg(F.sum("n_shingles").alias("total"), F.count("*").alias("rows")).first()
    total = size["total"] or 0
    often = passed.where("bucket is not null").groupBy("bucket").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= max(frequent_docs, FREQUENT_SHARE * size["rows"])).collect()
    frequent = Frequent([r["bucket"] for r in often], [r["n"] for r in often])
    # few large ranges: each block names its nodes, so many small ones would name them again and again
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PER_PARTITION))
    keys = partition_keys(spark, parts)
    repeated = repeated_blocks(shingle_blocks(base.select("text"), keys, frequent), keys)
    nodes = written(prefixes(repeated, parts), "jaccard-nodes")
    groups = connected(candidate_edges(nodes, keys, frequent), "jaccard-candidates")
    links = written(verify(nodes, groups), "jaccard-links")
    discard(nodes, groups)
    roots = links.where("whole").select("node", "root")
    if not links.where("not whole").isEmpty():
        roots = roots.union(connected(links.where("not whole").select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard-blocks"))
    # labels by node first: copies of one text are aggregated before the shuffle, and large components are split by adaptive execution
    own = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("own"))
    own = written(own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-own")
    least = written(own.groupBy("root").agg(F.min("own").alias("least")), "jaccard-least")
    label = written(own.select("node", "root").join(least, "root"), "jaccard-labels")
    out = named.join(label, "node", "left")
    return out.select("doc_id", "n_shingles", "node", "root", F.coalesce("least", "doc_id").alias("component_id"))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **frequent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row."""
    return rooted(docs, doc_id, text, **frequent).select("doc_id", "n_shingles", "component_id")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return link(docs, doc_id, text)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pipeline form: of each component one document stays, the one whose id is the component's label; of its rows with that id the one with the smallest text.

    Documents without words are components of their own and all stay.  So do rows
    that share an id, or have none, and don't link: they are told apart by their text's node.
    """
    columns = docs.columns
    found = rooted(docs, doc_id, text)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    own = lambda df: df.select(*[F.col(f"`{c}`") for c in columns])
    key, id_, node, root, row = (fresh(docs, x) for x in ("_key", "_kept", "_node", "_root", "_row"))
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return own(docs.join(kept.select(F.col("doc_id").alias(id_)), F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)), "left_semi"))

    def name(column: pa.Array) -> list[pa.Array]:
        return [pa.array([node_of(s) if len(s) else None for s in sets(column)], pa.int64())]

    rows = add_struct(docs, text, "node bigint", name, key)
    # an id and a text's node name the same component in both tables
    kept = kept.select(F.col("doc_id").alias(id_), F.col("node").alias(node), F.col("root").alias(root)).distinct()
    stay = rows.join(kept, F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)) & F.col(f"{key}.node").eqNullSafe(F.col(node)))
    first = F.row_number().over(Window.partitionBy(root).orderBy(F.col(f"`{text}`")))
    one = stay.where(F.col(root).isNotNull()).withColumn(row, first).where(F.col(row) == 1)
    return own(one).union(own(stay.where(F.col(root).isNull())))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: md5(array_to_string(w[i + 1 : i + 5], ' '))))) AS s FROM w WHERE len(w) > 0
), c AS (
  SELECT s, len(s) AS n, min(doc_id) AS c FROM s GROUP BY s
), x AS (
  SELECT c, n, unnest(s) AS t FROM c
), o AS (
  SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS o FROM x a JOIN x b ON a.t = b.t AND a.c < b.c GROUP BY ALL
), e AS (
  SELECT a, b FROM o WHERE 100 * o >= 75 * (an + bn - o)
), l AS (
  SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT c AS u, c AS root FROM c
  UNION
  SELECT l.v, r.root FROM r JOIN l ON r.u = l.u WHERE r.root < l.v
), m AS (
  SELECT u, min(root) AS root FROM r GROUP BY u
), k AS (
  SELECT s.doc_id, len(s.s) AS n, m.root FROM s JOIN c ON s.s = c.s JOIN m ON m.u = c.c
)
SELECT w.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, coalesce(k.root, w.doc_id) AS component_id FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
