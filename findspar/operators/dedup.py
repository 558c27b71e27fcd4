"""Near-duplicate passages, and their admission in order.

Two passages are near duplicates if both have at least `MIN_CHARS` characters, the
same facts (numbers and identifiers), and 3-word shingle sets with a Jaccard
similarity of 0.9 or more.

Pairs: equal (shingles, facts) form one class first.  Sets that are as similar as
that differ in at most (n_a + n_b) / 19 shingles, so if shingles are dealt over one
part more than that by their hashes, one part at least is the same in both.  Classes
meet by a hash of such a part, some eight shingles, together with that of their facts:
single shingles recur in unrelated texts, the more the larger the corpus is; whole parts
hardly do; what met is thinned out by bits of parity.  Numbers of parts go by levels of size; a set is dealt out for its own level
and for the one below.  The overlap is then counted on the full sets, which are made
again for the classes that met, and travel once for each pair of blocks that need them.

Admission is sequential by definition: a passage is kept unless it nearly
repeats one that was kept before it.  On the pairs' graph, directed from earlier to
later, that is a fixpoint: a passage whose earlier neighbours are all decided is
decided.  Each round is a few joins; rounds are as many as the longest chain of
near duplicates of near duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType
from pyspark.sql.window import Window

from findspar.functions import text as T
from findspar.session import ensure_checkpoints

THRESHOLD = (9, 10)
MIN_CHARS = 120
MANY_IDS = 2_000_000  # so many ids are broadcast to the texts, beyond that texts go to the ids
TASK_KEYS = 500_000  # keys of parts that a task sorts, about
BLOCK_HASHES, CELL_PAIRS = 2_000_000, 100_000  # what one task verifies at a time, about
BUCKETS = 1 << 18
FREQUENT, FREQUENT_SHARE = 20, 0.001


def signatures(passages: DataFrame, chunk_id: str = "chunk_id", text: str = "text", order: Column | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """(chunk_id, ord, class, facts_key, n, hashes): what duplicates are found by; short passages are left out."""
    long = passages.where(F.length(text) >= min_chars)
    hashes = T.shingle_hashes(F.col(text))
    facts_key = F.xxhash64(F.array_join(T.facts(F.col(text)), " "))
    # inline() keeps the hashes from being computed again for each use
    found = F.inline(F.array(F.struct(hashes.alias("hashes"), facts_key.alias("facts_key"))))
    rows = long.select(F.col(chunk_id).alias("chunk_id"), (F.col(chunk_id) if order is None else order).alias("ord"), found)
    name = F.concat_ws("-", F.hex(F.xxhash64("hashes", "facts_key")), F.hex(F.xxhash64(F.lit(1), "facts_key", "hashes")), F.size("hashes").cast("string"))
    return rows.withColumn("n", F.size("hashes")).withColumn("class", name).where("n > 0")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS))


def frequent_buckets(classes: DataFrame) -> list[int]:
    """Buckets of hashes that far more classes hold than the mean: those of boilerplate.  At most a quarter of BUCKETS, whatever the corpus.  For looking at a corpus; pairs don't need them."""
    each = classes.select(F.explode(F.transform("hashes", _bucket)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    size = classes.agg(F.sum("n").alias("entries"), F.count("*").alias("classes")).first()
    least = max(FREQUENT, 4 * (size["entries"] or 0) / BUCKETS, FREQUENT_SHARE * size["classes"])
    return sorted(r["bucket"] for r in each.where(F.col("n") >= least).collect())


def _levels(most: int) -> np.ndarray:
    """The smallest size of each level up to that of `most`: similar sets are of one level or of neighbouring ones."""
    up, low = THRESHOLD[1], THRESHOLD[0]
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * up // low + 1)
    return np.array(starts)


def part_keys(offsets: np.ndarray, hashes: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of keys of each set, keys): a set's hashes are dealt over parts, more than similar sets of its level differ in, and each part is hashed."""
    up, low = THRESHOLD[1], THRESHOLD[0]
    n, hashes = np.diff(offsets), hashes.astype(np.uint64)
    starts = _levels(int(n.max(initial=1)))
    own = np.searchsorted(starts, n, "right") - 1
    largest = np.append(starts[1:], starts[-1] * up // low + 1) - 1
    parts = (largest + largest * up // low) * (up - low) // (up + low) + 1
    parts[parts == 1] = 0  # such sets are similar if they are equal
    made, counts = [], []
    for level in (own, own - 1):
        k = np.where(level >= 0, parts[level], 0)
        first = np.cumsum(k) - k
        of = np.repeat(np.arange(len(n)), n)
        dealt = k[of] > 0
        of, h = of[dealt], hashes[dealt]
        sums = np.zeros(int(k.sum()), np.uint64)
        np.add.at(sums, first[of] + ((h >> np.uint64(32)) % k[of].astype(np.uint64)).astype(np.int64), h)
        owner = np.repeat(np.arange(len(n)), k)
        place = (level[owner] * 1_000_003 + np.arange(len(owner)) - first[owner]).astype(np.uint64)
        key = (sums ^ (place * np.uint64(0x9E3779B97F4A7C15))) + salt.astype(np.uint64)[owner]
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        made.append((owner, (key ^ (key >> np.uint64(29))).astype(np.int64)))
        counts.append(k)
    owner, keys = (np.concatenate(x) for x in zip(*made, strict=True))
    return counts[0] + counts[1], keys[np.argsort(owner, kind="stable")]


def parities(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """256 bits of each set, as four numbers: whether an even number of its hashes falls on each.  Sets differ in at least as many shingles as bits."""
    n, hashes = np.diff(offsets), hashes.astype(np.uint64)
    of = np.repeat(np.arange(len(n)), n) * 4 + ((hashes >> np.uint64(6)) & np.uint64(3)).astype(np.int64)
    out = np.zeros(4 * len(n), np.uint64)
    np.bitwise_xor.at(out, of, np.uint64(1) << (hashes & np.uint64(63)))
    return out.astype(np.int64)


def compact(signed: DataFrame) -> DataFrame:
    """`signatures` with `parities`, and with the keys by which classes meet, in place of their hashes, checkpointed: a quarter of their size."""
    ensure_checkpoints(signed.sparkSession)
    schema = StructType([f for f in signed.schema.fields if f.name != "hashes"]).add("parity", ArrayType(LongType(), False)).add("keys", ArrayType(LongType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).combine_chunks()
            held = rows["hashes"].chunk(0)
            offsets = held.offsets.to_numpy()
            flat = held.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            k, keys = part_keys(offsets - offsets[0], flat, rows["facts_key"].to_numpy())
            out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)), pa.int32()), pa.array(keys))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * 4, pa.int32()), pa.array(parities(offsets - offsets[0], flat)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-2]), bits, out], names=schema.names)

    return signed.mapInArrow(run, schema).checkpoint()


def with_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """rows.join(ids, key, how) of large rows: ids are counted, and broadcast if there are few enough."""
    ids = ids.select(key)
    return rows.join(F.broadcast(ids) if ids.count() <= MANY_IDS else ids, key, how)


def _verified(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """(class_a, class_b, similarity) of the pairs of a cell that are similar; sets (of, class, hashes)."""
    up, low = THRESHOLD[1], THRESHOLD[0]
    sets = sets.combine_chunks()
    at = {c: i for i, c in enumerate(sets["class"].to_pylist())}
    held = sets["hashes"].chunk(0) if len(sets) else None
    a, b, found = [], [], []
    for x, y in zip(pairs["class_a"].to_pylist(), pairs["class_b"].to_pylist(), strict=True):
        left, right = (held[at[c]].values.to_numpy(zero_copy_only=False) for c in (x, y))
        where = np.minimum(np.searchsorted(right, left), len(right) - 1)
        shared = int((right[where] == left).sum())
        if shared * (low + up) >= low * (len(left) + len(right)):
            a.append(x)
            b.append(y)
            found.append(shared / (len(left) + len(right) - shared))
    return pa.table({"class_a": pa.array(a, pa.string()), "class_b": pa.array(b, pa.string()), "similarity": pa.array(found, pa.float64())})


def class_pairs(signed: DataFrame, small: DataFrame | None = None, chosen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(class_a, class_b, similarity) of different classes that are near duplicates.

    `small` is the `compact` form, if it was made before; `chosen` gives the signatures
    of the passages of a table (chunk_id), if that takes less than making all again.
    """
    ensure_checkpoints(signed.sparkSession)
    small = compact(signed) if small is None else small
    up, low = THRESHOLD[1], THRESHOLD[0]
    # a class is named by 64 bits here: two of one name would both be compared
    keys = small.agg(F.sum(F.size("keys"))).first()[0] or 0
    tasks = max(small.sparkSession.sparkContext.defaultParallelism, -(-keys // TASK_KEYS))
    entries = small.select(F.explode("keys").alias("key"), F.xxhash64("class").alias("c")).repartition(tasks, "key").dropDuplicates(["key", "c"])
    met = entries.alias("a").join(entries.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")))
    met = met.select(F.col("a.c").alias("ca"), F.col("b.c").alias("cb")).distinct().checkpoint()
    named = small.select(F.xxhash64("class").alias("c"), "class", "chunk_id", "n", "facts_key", "parity")
    ids = met.select(F.col("ca").alias("c")).union(met.select("cb")).distinct()
    heads = with_ids(named, ids, "c").groupBy("c", "class", "n", "facts_key", "parity").agg(F.min("chunk_id").alias("chunk_id")).checkpoint()
    a, b = (heads.select(F.col("c").alias(f"c{x}"), F.col("class").alias(f"class_{x}"), F.col("n").alias(f"n{x}"), F.col("facts_key").alias(f"f{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")
    odd = sum((F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(4)), F.lit(0))
    near = (F.col("na") * up >= F.col("nb") * low) & (F.col("nb") * up >= F.col("na") * low)
    pairs = met.join(a, "ca").join(b, "cb").where((F.col("fa") == F.col("fb")) & near & (odd * (low + up) <= (F.col("na") + F.col("nb")) * (up - low)))
    pairs = pairs.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).checkpoint()
    left = pairs.select(F.col("class_a").alias("class")).union(pairs.select("class_b")).distinct()
    heads = with_ids(heads, left, "class").checkpoint()
    hashes = heads.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-hashes // BLOCK_HASHES), int(np.ceil(np.sqrt(2 * pairs.count() / CELL_PAIRS))))
    block = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.lit(blocks))
    cell = lambda x, y: F.least(x, y) * blocks + F.greatest(x, y)
    dealt = pairs.withColumn("cell", cell(block("class_a"), block("class_b")))
    needed = dealt.select("cell", F.col("class_a").alias("class")).union(dealt.select("cell", "class_b")).distinct()
    chosen = chosen or (lambda ids: with_ids(signed, ids, "chunk_id"))
    full = chosen(heads.select("chunk_id")).groupBy("class").agg(F.first("hashes").alias("hashes"))
    sets = needed.join(full, "class").select(F.col("cell").alias("of"), "class", "hashes")
    return dealt.groupBy("cell").cogroup(sets.groupBy("of")).applyInArrow(_verified, "class_a string, class_b string, similarity double")


def admit(signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chunk_id, duplicate_of, similarity): null if kept, else the most similar kept passage before it (ties: smallest id).

    A class stands for its passages: its first member in order is decided, and
    the others repeat either that one or what it repeats.
    """
    ensure_checkpoints(signed.sparkSession)
    first = Window.partitionBy("class").orderBy("ord", "chunk_id")
    ranked = signed.select("chunk_id", "ord", "class").withColumn("_n", F.row_number().over(first))
    heads = ranked.where("_n = 1").select("class", F.col("chunk_id").alias("head"), "ord")
    a, b = heads.toDF("class_a", "id_a", "ord_a"), heads.toDF("class_b", "id_b", "ord_b")
    both = pairs.join(a, "class_a").join(b, "class_b")
    before = F.struct("ord_a", "id_a") < F.struct("ord_b", "id_b")
    edges = both.select(F.when(before, F.col("id_a")).otherwise(F.col("id_b")).alias("early"), F.when(before, F.col("id_b")).otherwise(F.col("id_a")).alias("late"), "similarity").checkpoint()
    kept = heads.select(F.col("head").alias("id")).join(edges.select(F.col("late").alias("id")), "id", "left_anti")
    state = kept.join(edges.select(F.col("early").alias("id")).distinct(), "id", "left_semi").withColumn("kept", F.lit(True)).checkpoint()
    while True:
        # a passage with a kept neighbour before it is a duplicate; one whose neighbours before it are all duplicates is kept
        open_ = edges.join(state.select(F.col("id").alias("late")), "late", "left_anti").join(state.select(F.col("id").alias("early"), "kept"), "early", "left")
        decided = open_.groupBy("late").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("dup"), F.bool_and(F.col("kept").isNotNull()).alias("known")).where("dup or known")
        fresh = decided.select(F.col("late").alias("id"), (~F.col("dup")).alias("kept")).checkpoint()
        if fresh.isEmpty():
            break
        state = state.union(fresh).checkpoint()
    dropped = state.where("not kept").select(F.col("id").alias("late"))
    of = edges.join(dropped, "late", "left_semi").join(state.where("kept").select(F.col("id").alias("early")), "early", "left_semi")
    choice = of.groupBy("late").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("early").alias("id"))).alias("c")).select(F.col("late").alias("head"), F.col("c.id").alias("of"), (-F.col("c.s")).alias("similarity"))
    members = ranked.join(heads.select("class", "head"), "class").join(choice, "head", "left")
    target = F.coalesce("of", F.when(F.col("_n") > 1, F.col("head")))
    return members.select("chunk_id", target.alias("duplicate_of"), F.when(target.isNotNull(), F.coalesce("similarity", F.lit(1.0))).alias("similarity"))
