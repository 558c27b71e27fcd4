"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time u in [0, 1]; its integral
is the source's cumulative demand for words, and what it has taken by the end is its
target.  A document occupies an interval of its source's word sequence (in the order
of a hash of the id, the whole sequence again for each further pass); inverting the
cumulative demand at the interval's start gives the document's training position.
Range-sorting by position yields the training order.

Targets: sources, by code point with null last, weigh 1, 2, 3, repeating; they
share all words by weight, no target is over `CAP` times its source's size, and
the excess is shared again by weight until none is.  That fixed point is
min(CAP x size, level x weight) with the level at which targets add up, which a
cumulative sum over sources sorted by CAP x size / weight finds directly.

Schedules: source i's rate is target x (1 + tilt_i (2u - 1)) with tilts from -TILT
(first source: early) to TILT (last source: late).  Cumulative demand is
target x (u + tilt (u^2 - u)), inverted in closed form.

A source's positions come from a two-level prefix sum: sums by (source, slot of
the hash), running totals over slots, and running totals inside a slot.  Slots
hold about `SLOT_ROWS` rows of the largest source, so a source with a third of all
rows is spread over as many tasks as any other.

Defined results: a null text has size 0 and takes nothing; a null source is a
source; repeated rows and null ids occupy intervals of their own (ties are ordered by
size); with no words at all every target is 0; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findspar.llm._frames import made, narrow, release, written

CAP = 3
TILT = 0.8
SLOT_ROWS = 4_000
FEW = 100_000  # rows of a name and a few numbers that are broadcast
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target, tilt from (source, source_size); a row per source."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(every)).withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("n", F.count("*").over(whole)).withColumn("total", F.sum("source_size").over(whole).cast("double"))
    # capped sources are a prefix of this order: before each, what the capped ones take and the weight that is left
    by_need = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(F.col("source_size") * F.lit(cap)).over(by_need), F.lit(0)).cast("double")
    used = F.coalesce(F.sum("weight").over(by_need), F.lit(0.0))
    ranked = ranked.withColumn("level", (F.col("total") - capped) / (F.sum("weight").over(whole) - used))
    ranked = ranked.withColumn("open", F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(cap))
    level = F.min(F.when(F.col("open"), F.struct(F.col("source_size") * cap / F.col("weight"), "rank", "level"))).over(whole)["level"]
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    tilt = F.when(F.col("n") > 1, (F.col("rank") - 1) * 2.0 / (F.col("n") - 1) - 1).otherwise(F.lit(0.0)) * TILT
    return ranked.select("source", "source_size", "weight", target.alias("target"), tilt.alias("tilt"))


def _order_key() -> F.Column:
    """The leading 52 bits of an md5 of the id, as a number: an order that any engine can repeat.  Rows without an id go by their text's md5."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint")


def position(words: F.Column) -> F.Column:
    """Training time at which the source has taken so many words: the inverse of target x (u + tilt (u^2 - u))."""
    y = words / F.col("target")
    a, b = F.col("tilt"), 1 - F.col("tilt")
    return F.when(F.abs(a) < 1e-9, y).otherwise(2 * y / (b + F.sqrt(b * b + 4 * a * y)))


def _assigned(docs: DataFrame, doc_id: str, text: str, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: doc_id, source, start (its first word's place in its source's sequence), size, source_size, target, taken, positions, partial_words, kept0, ..."""
    base = narrow(docs, doc_id=doc_id, source=source, text=text, **{f"kept{i}": c for i, c in enumerate(keep)})
    sized = base.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")).withColumn("key", _order_key()).drop("text")
    measured = written(sized.select("doc_id", "source", "size", "key"), "mixing-sizes")  # ids and numbers only: texts are counted once for all that follows
    per_source = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    largest = per_source.agg(F.max("rows")).first()[0] or 0
    slots = 1 + largest // SLOT_ROWS
    slot = F.floor(F.col("key") / float(1 << 52) * slots).cast("int")
    sized = (sized if keep else measured).withColumn("slot", slot)
    cells = measured.withColumn("slot", slot).groupBy("source", "slot").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "slot", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    goal = targets(per_source.select("source", "source_size"))
    plan = cells.join(goal, cells["source"].eqNullSafe(goal["source"])).select(cells["source"].alias("c_source"), F.col("slot").alias("c_slot"), "offset", "source_size", "target", "tilt")
    if cells.count() <= FEW:  # texts then stay where they are; beyond it adaptive execution decides
        plan = F.broadcast(plan)
    inside = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(plan, placed["source"].eqNullSafe(plan["c_source"]) & (placed["slot"] == plan["c_slot"])).withColumn("start", F.col("offset") + F.col("inner"))
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.floor(F.col("target") - passes * F.col("source_size"))  # words of the last, partial pass
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("bigint")
    placed = placed.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0).cast("int")).withColumn("partial", partial)
    count = F.col("passes") + F.when(F.col("partial") > 0, 1).otherwise(0)
    starts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: position(F.least(i * F.col("source_size") + F.col("start"), F.col("target"))))
    return placed.select(
        "doc_id", "source", "start", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("partial")).cast("bigint").alias("taken"),
        F.when(count > 0, starts).otherwise(F.array().cast("array<double>")).alias("positions"), F.col("partial").alias("partial_words"),
        *[f"kept{i}" for i in range(len(keep))],
    )


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken, positions (training time of each pass that takes words of it).

    `keep`: further columns of docs to carry along.
    """
    kept = [F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)]
    return _assigned(docs, doc_id, text, source, keep).select("doc_id", "size", "source_size", "target", "taken", "positions", "partial_words", *kept)


def _order(mixed: DataFrame, *columns: str) -> DataFrame:
    """A row for each time a document of `_assigned` is taken, range-sorted by position: position, pass, words, and the columns named."""
    passes = mixed.select("*", F.posexplode("positions").alias("pass", "position"), F.size("positions").alias("times"))
    words = F.when((F.col("pass") == F.col("times") - 1) & (F.col("partial_words") > 0), F.col("partial_words")).otherwise(F.col("size"))
    return passes.select("position", "pass", words.alias("words"), *columns).orderBy("position", "doc_id", "pass")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position of every document row, counted from the training order of `schedule` without its texts."""
    since = made()
    mixed = written(_assigned(docs, doc_id, text, source), "mixing-documents")
    whole = ("doc_id", "size", "source_size", "target")
    order = written(_order(mixed, "source", "start", *whole), "mixing-order")  # in files by position
    release(docs.sparkSession, since, mixed, order)
    # a source's words are numbered, so what is taken has a start of its own, whatever its id
    taken = order.groupBy("source", "start", *whole).agg(F.sum("words").alias("taken"), F.round(F.min("position"), 9).alias("first_position"))
    left = mixed.where(F.size("positions") == 0).select(*whole, F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast("double").alias("first_position"))
    return taken.select(*whole, "taken", "first_position").union(left)


def schedule(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The training order: a row for each time a document is taken, range-sorted by position, with its text and the words taken of it.

    Documents of which nothing is taken don't occur.
    """
    mixed = _assigned(docs, doc_id, text, source, keep=(text,)).withColumnRenamed("kept0", "text")
    return _order(mixed, "doc_id", "source", "text").select("position", "doc_id", "source", "pass", "words", "text")


# For DuckDB; {docs} is the table.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT AS key
  FROM {docs}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), r AS (
  SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, count(*) OVER () AS n, sum(source_size) OVER ()::DOUBLE AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(source_size * 3) OVER need, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER need, 0.0)) AS level
  FROM r WINDOW need AS (ORDER BY source_size * 3 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, coalesce((SELECT arg_min(level, (source_size * 3 / weight, rank)) FROM l WHERE level * weight <= source_size * 3), 'inf'::DOUBLE) * weight) AS target,
         0.8 * CASE WHEN n > 1 THEN (rank - 1) * 2.0::DOUBLE / (n - 1) - 1 ELSE 0 END AS tilt
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt, floor(t.target / greatest(t.source_size, 1)) AS passes,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, floor(target - passes * source_size) - start)) AS partial, start / nullif(target, 0) AS y FROM p
)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN passes ELSE 0 END * size + partial)::BIGINT AS taken,
       CASE WHEN (size > 0 AND passes > 0) OR partial > 0 THEN round(CASE WHEN abs(tilt) < 1e-9 THEN least(y, 1) ELSE 2 * least(y, 1) / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * least(y, 1))) END, 9) END AS first_position
FROM q
"""
