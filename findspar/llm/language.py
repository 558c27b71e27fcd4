"""Language identification with interpolated Kneser-Ney character models.

Letters are lower-cased; every run of other characters is one space.  Counts of
character 4-grams are gathered over all training documents, one table for all
languages, summed per task before the only shuffle of this operator.  From them
comes one model per language: absolute discounting at the highest order,
continuation counts below, each order interpolated with the next lower one down to
a uniform floor.  The model is stored as arrays sorted by a 64-bit hash of the gram
and read by binary search inside slots of the hash's leading bits.  A text gets the language of the
lowest cross-entropy per character.

Every gram of every training document is in the model, so it grows with the corpus.
Orders 1 and 2 (pairs of symbols) are in every part of it; orders 3 and 4 are dealt
over as many parts as `PART_CELLS` asks for, by a hash of a gram's two middle symbols,
which all look-ups of that gram, its lower orders and their contexts have in common.
A part is built from its grams alone, broadcast, and adds up what it knows of every
document; the sums of further parts are added in passes over tables in the shared
folder.  The result doesn't depend on the number of parts, and neither driver nor
executors hold more than one.

Documents are measured once, and written.  From that table rejection is calibrated:
per language, over all its training documents, the threshold is the 99.9th percentile of the cross-entropy (in steps of 1 / `STEPS` nats,
rounded up) plus `MARGIN` nats, and short texts get `SHORT` / sqrt(length) more.

Defined results: null texts and texts without a letter are `und`, with score 0,
and rejected; without any training row every text is `und` and rejected.  Equal cross-entropies go
to the language that sorts first.  Repeated rows repeat their result; null ids aren't used for
training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspar.llm import _words as w
from findspar.llm._frames import add_struct, crc_residue, fresh, narrow, return_memory, written

ORDER = 4
PART_CELLS = 8_000_000  # grams x languages of a part
STEPS = 1_000
MARGIN, SHORT = 0.5, 6.0
FLUSH = 2_000_000
SUMS = "total array<double>, n bigint"
LEHMER, MERSENNE = 48271, 2147483647

_fold: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Code point -> 16-bit symbol: 0 for what isn't a letter, else the lower-case letter (beyond the BMP: its low bits)."""
    if not _fold:
        table = np.zeros(0x110000, np.uint16)
        for i in range(0x33480):  # no letters beyond
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0]) & 0xFFFF or 1
        _fold.append(table)
    return _fold[0]


def letters(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, symbols, index of each row's first symbol): one 0 opens each row with letters, then words with one 0 after each."""
    fold = _symbols()
    for at, end, data, offsets in w.slices(column):
        text = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        symbol = fold[points]
        # character offsets of the rows: bytes that don't continue a character
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first = heads[offsets]
        if len(points) != heads[-1]:  # broken UTF-8: rows are decoded alone
            rows = [fold[np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)] for i in range(end - at)]
            symbol, first = np.concatenate([*rows, np.zeros(0, np.uint16)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        # a space before every row, and one space for each run of others
        n = len(symbol) + (end - at)
        padded = np.zeros(n, np.uint16)
        place = np.ones(n, bool)
        opens = first[:-1] + np.arange(end - at)
        place[opens] = False
        padded[place] = symbol
        space = padded == 0
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]  # the space that ends a word
        keep[opens] = True
        keep &= ~(space & np.concatenate([[False], space[:-1]]) & ~np.isin(np.arange(n), opens)) if n else keep
        run = np.concatenate([[0], np.cumsum(keep)])
        yield at, end, padded[keep], run[np.concatenate([opens, [n]])]


def grams(symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each symbol but a row's opening space, as 64 bits, and the index of each row's first one.

    Before a row's start stand spaces.
    """
    n = len(symbol)
    code = symbol.astype(np.uint64)
    opens = first[:-1][np.diff(first) > 0]
    distance = np.arange(n) - np.repeat(first[:-1], np.diff(first)) if n else np.zeros(0, np.int64)
    for k in range(1, ORDER):
        part = np.zeros(n, np.uint64)
        part[k:] = symbol[:-k] if n > k else 0
        part[distance < k] = 0
        code |= part << np.uint64(16 * k)
    inner = np.ones(n, bool)
    inner[opens] = False
    return code[inner], np.concatenate([[0], np.cumsum(inner)])[first]


@dataclass
class Table:
    """Rows of `values`, found by gram: sorted by the gram's hash, with the first row of each slot of leading bits."""

    keys: np.ndarray
    values: np.ndarray
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shift: int = 0
    longest: int = 0

    @classmethod
    def of(cls, gram: np.ndarray, values: np.ndarray) -> Table:
        hashed = w.mix64(gram)
        order = np.argsort(hashed)
        hashed, values = hashed[order], values[order]
        bits = max(1, int(len(hashed)).bit_length() + 1)
        shift = 64 - bits
        slots = np.searchsorted(hashed >> np.uint64(shift), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(hashed, values, slots, shift, int(np.diff(slots).max(initial=0)))

    def find(self, gram: np.ndarray) -> np.ndarray:
        """Row of each gram, or -1."""
        hashed = w.mix64(gram)
        slot = (hashed >> np.uint64(self.shift)).astype(np.int64)
        low, end = self.slots[slot], self.slots[slot + 1]
        out = np.full(len(gram), -1, np.int64)
        at = np.flatnonzero(low < end)
        low = low[at]
        for _ in range(self.longest):
            hit = self.keys[low] == hashed[at]
            out[at[hit]] = low[hit]
            more = ~hit & (low + 1 < end[at])
            at, low = at[more], low[more] + 1
            if not len(at):
                break
        return out


def _group(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of `values` by key."""
    distinct, inverse = np.unique(key, return_inverse=True)
    return distinct, np.stack([np.bincount(inverse, values[:, j], len(distinct)) for j in range(values.shape[1])], 1)


def part_of(gram: np.ndarray, parts: int) -> np.ndarray:
    """The part that knows a gram, from its two middle symbols."""
    middle = (gram >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
    return (middle % np.uint64(MERSENNE) * np.uint64(LEHMER) % np.uint64(MERSENNE) % np.uint64(parts)).astype(np.int64)


def part_column(gram: F.Column, parts: int) -> F.Column:
    """The same in Spark's expressions."""
    middle = F.shiftrightunsigned(gram, 16).bitwiseAND(F.lit(0xFFFFFFFF))
    return middle % MERSENNE * LEHMER % MERSENNE % parts


@dataclass
class Model:
    """One of `parts` parts: what it knows of grams that belong to it."""

    langs: list[str]
    by_order: list[Table]  # log probabilities of seen grams; order 1 first
    back_off: list[Table]  # log weights of the lower order after a context; order 2 first
    floor: np.ndarray  # log probability of a symbol never seen
    part: int = 0
    parts: int = 1

    def log_prob(self, gram: np.ndarray) -> np.ndarray:
        """One row of natural log probabilities per gram, a column per language."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        at = np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            own = gram[at] & np.uint64((1 << 16 * order) - 1)
            table = self.by_order[order - 1]
            row = table.find(own)
            hit = row >= 0
            out[at[hit]] += table.values[row[hit]]
            at, own = at[~hit], own[~hit]
            if order > 1 and len(at):
                context = self.back_off[order - 2]
                row = context.find(own >> np.uint64(16))
                hit = row >= 0
                out[at[hit]] += context.values[row[hit]]
        out[at] += self.floor
        return out

    def sums(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log probabilities over this part's grams (rows x languages), and numbers of characters of texts with letters, else 0."""
        rows, sizes = [], []
        for _, _, symbol, first in letters(column):
            gram, begin = grams(symbol, first)
            lettered = w.per_row((symbol > 0).astype(np.int64), first) > 0
            sizes.append(np.where(lettered, np.diff(begin), 0))
            if self.parts > 1:
                own = part_of(gram, self.parts) == self.part
                gram, begin = gram[own], np.concatenate([[0], np.cumsum(own)])[begin]
            rows.append(w.per_row(self.log_prob(gram).astype(np.float64), begin))
        if not rows:
            return np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(sizes)


def discounts(ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    return np.clip(np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5), 0.1, 0.95)


def interpolated(keys: np.ndarray, c: np.ndarray, discount: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the grams, their contexts, and each context's weight of the lower order."""
    context, total = _group(keys >> np.uint64(16), c)
    _, kinds = _group(keys >> np.uint64(16), (c > 0).astype(np.float64))
    at = np.searchsorted(context, keys >> np.uint64(16))
    spare = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(c - discount, 0) / np.maximum(total[at], 1) + spare[at] * below, context, spare


@dataclass
class Lower:
    """Orders 1 and 2, which every part holds, from counts of pairs (how many symbols stand before each), and the discounts of orders 3 and 4."""

    langs: list[str]
    keys: np.ndarray  # sorted pairs
    count: np.ndarray  # pairs x languages
    higher: list[np.ndarray]  # discounts

    def part(self, gram: np.ndarray, count: np.ndarray, part: int = 0, parts: int = 1) -> Model:
        """The part of the model that knows the given 4-grams (sorted; grams x languages)."""
        mask = [np.uint64((1 << 16 * k) - 1) for k in range(ORDER + 1)]
        continued = (self.count > 0).astype(np.float64)
        tables = [_group(self.keys & mask[1], continued), (self.keys, self.count), _group(gram & mask[3], (count > 0).astype(np.float64)), (gram, count.astype(np.float64))]
        discount = [discounts((c == 1).sum(0), (c == 2).sum(0)) for _, c in tables[:2]] + self.higher
        floor = np.full(len(self.langs), 1 / (len(tables[0][0]) + 1))
        by_order, back_off = [], []
        lower_keys, lower = np.zeros(1, np.uint64), floor[None, :]
        for order, ((keys, c), d) in enumerate(zip(tables, discount, strict=True), 1):
            below = lower[np.searchsorted(lower_keys, keys & mask[order - 1])] if order > 1 else np.broadcast_to(floor, c.shape)
            p, context, spare = interpolated(keys, c, d, below)
            by_order.append(Table.of(keys, np.log(p).astype(np.float32)))
            if order > 1:
                back_off.append(Table.of(context, np.log(spare).astype(np.float32)))
            elif len(spare):
                floor = spare[0] * floor
            lower_keys, lower = keys, p
        return Model(self.langs, by_order, back_off, np.log(floor).astype(np.float32), part, parts)


def build(langs: list[str], gram: np.ndarray, count: np.ndarray, parts: int = 1) -> list[Model]:
    """All parts of the model of counts (grams x languages, sorted by gram)."""
    third, c3 = _group(gram & np.uint64((1 << 48) - 1), (count > 0).astype(np.float64))
    second, c2 = _group(third & np.uint64((1 << 32) - 1), (c3 > 0).astype(np.float64))
    lower = Lower(langs, second, c2, [discounts((c == 1).sum(0), (c == 2).sum(0)) for c in (c3, count)])
    own = part_of(gram, parts)
    return [lower.part(gram[own == p], count[own == p], p, parts) for p in range(parts)]


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over documents (lang, text): each task sums first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def add(lang: str, gram: np.ndarray) -> None:
            own.setdefault(lang, []).append(np.unique(gram, return_counts=True))

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            for lang, parts in own.items():
                keys, n = _group(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])[:, None].astype(np.float64))
                own[lang] = [(keys, n[:, 0].astype(np.int64))]
            held = sum(len(p[0][0]) for p in own.values())
            if last or held > FLUSH // 2:
                for lang, ((keys, n),) in own.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
                own.clear()
                held = 0

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at, end, symbol, first in letters(batch.column("text")):
                gram, begin = grams(symbol, first)
                row = np.repeat(langs[at:end], np.diff(begin))
                for lang in dict.fromkeys(langs[at:end].tolist()):
                    add(lang, gram[row == lang])
                    held += len(own[lang][-1][0])
                if held > FLUSH:
                    yield from emit(False)
        yield from emit(True)

    return docs.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Learned:
    """A model by parts, each of which is built when it is asked for."""

    langs: list[str]
    table: DataFrame  # lang, gram, n
    lower: Lower | None
    parts: int

    def part(self, p: int) -> Model:
        own = F.array_position(F.array(*[F.lit(x) for x in self.langs]), F.col("lang")) - 1
        rows = self.table.where(part_column(F.col("gram"), self.parts) == p).select(own.cast("int").alias("lang"), "gram", "n").toArrow()
        return self.lower.part(*_matrix(rows, len(self.langs)), p, self.parts)


def _matrix(rows: pa.Table, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted grams, counts by gram and language) from rows (lang, gram, n)."""
    gram, inverse = np.unique(rows["gram"].to_numpy().view(np.uint64), return_inverse=True)
    matrix = np.zeros((len(gram), langs))
    matrix[inverse, rows["lang"].to_numpy()] = rows["n"].to_numpy()
    return gram, matrix


def in_training(doc_id: str, lang: str, folds: int, held: int) -> F.Column:
    return F.col(f"`{lang}`").isNotNull() & F.coalesce(crc_residue(doc_id, folds) != held, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2, part_cells: int = PART_CELLS) -> Learned:
    """Counts of all grams of the training documents, as a table, and what the parts of the model share."""
    train = narrow(docs, id=doc_id, text=text, lang=lang).where(F.col("text").isNotNull() & in_training("id", "lang", folds, held))
    table = written(counts(train.select(F.col("lang").cast("string").alias("lang"), "text")), "language-grams")
    ones, twos = F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")
    fourth = {r["lang"]: r for r in table.groupBy("lang").agg(ones, twos, F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(fourth)
    if not langs:
        return Learned([], table, None, 1)
    lower = lambda bits: F.col("gram").bitwiseAND(F.lit((1 << bits) - 1)).alias("gram")
    third = table.groupBy("lang", lower(48)).agg(F.count("*").alias("n"))
    own = (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int").alias("lang")
    pairs = third.groupBy("lang", lower(32)).agg(F.count("*").alias("n"), ones, twos).select(own, "gram", "n", "ones", "twos").toArrow()  # pairs of symbols
    keys, count = _matrix(pairs, len(langs))
    of_third = [np.bincount(pairs["lang"].to_numpy(), pairs[x].to_numpy(), len(langs)) for x in ("ones", "twos")]
    of_fourth = [np.array([float(fourth[x][k]) for x in langs]) for k in ("ones", "twos")]
    parts = -(-sum(r["n"] for r in fourth.values()) * len(langs) // part_cells)
    return Learned(langs, table, Lower(langs, keys, count, [discounts(*of_third), discounts(*of_fourth)]), max(1, parts))


def score(docs: DataFrame, model: Learned, text: str = "text", name: str = "language") -> tuple[DataFrame, str]:
    """docs with a struct column of SUMS (log probabilities by language, number of characters), and its name."""
    name = fresh(docs, name)
    if not model.langs:
        return docs.withColumn(name, F.struct(F.array().cast("array<double>").alias("total"), F.lit(0).cast("bigint").alias("n"))), name
    for p in range(model.parts):
        sent = docs.sparkSession.sparkContext.broadcast(model.part(p))
        return_memory()

        def run(column: pa.Array, sent=sent) -> list[pa.Array]:
            total, n = sent.value.sums(column)
            offsets = pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32())
            return [pa.ListArray.from_arrays(offsets, pa.array(total.reshape(-1))), pa.array(n)]

        if not p:
            docs = add_struct(docs, text, SUMS, run, name)
            continue
        more = fresh(docs, f"{name}_more")
        docs = add_struct(written(docs, "language-sums"), text, SUMS, run, more)
        total = F.zip_with(F.col(f"`{name}`.total"), F.col(f"`{more}`.total"), lambda a, b: a + b)
        docs = docs.withColumn(name, F.struct(total.alias("total"), F.col(f"`{name}`.n").alias("n"))).drop(more)
    return docs, name


def _entropy(name: str) -> tuple[F.Column, F.Column]:
    """Cross-entropies per character by language, and the allowance of a text's length."""
    n = F.greatest(F.col(f"`{name}`.n"), F.lit(1))
    return F.transform(F.col(f"`{name}`.total"), lambda x: -x / n), F.lit(SHORT) / F.sqrt(n.cast("double"))


def calibrate(scored: DataFrame, name: str, langs: list[str], doc_id: str = "doc_id", lang: str = "lang", folds: int = 4, held: int = 2) -> list[float]:
    """Thresholds from all training rows: their entropies, less the short-text allowance, are counted by steps, and one number per language reaches the driver."""
    entropy, allowance = _entropy(name)
    own = F.get(entropy, F.array_position(F.array(*[F.lit(x) for x in langs]).cast("array<string>"), F.col(f"`{lang}`").cast("string")).cast("int") - 1)
    rows = scored.where((F.col(f"`{name}`.n") > 0) & in_training(doc_id, lang, folds, held)).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.ceil((own - allowance) * STEPS).alias("step"))
    found = rows.groupBy("lang", "step").agg(F.count("*").alias("n")).groupBy("lang").agg((F.percentile("step", F.lit(0.999), F.col("n")) / STEPS).alias("h")).collect()
    by_lang = {r["lang"]: r["h"] + MARGIN for r in found}
    return [by_lang.get(x, float("inf")) for x in langs]


def decided(name: str, langs: list[str], limits: list[float]) -> dict[str, F.Column]:
    """lang, score, entropy and rejected from the column of SUMS.

    score is the posterior of the language under equal priors, by the evidence of 20
    characters at most.
    """
    entropy, allowance = _entropy(name)
    n = F.col(f"`{name}`.n")
    known = (n > 0) & F.lit(bool(langs))
    lowest = F.array_min(entropy)
    best = F.array_position(entropy, lowest).cast("int") - 1
    weight = F.aggregate(entropy, F.lit(0.0), lambda total, x: total + F.exp(-F.least((x - lowest) * F.least(n, F.lit(20)), F.lit(700.0))))
    limit = F.get(F.array(*[F.lit(x) for x in limits]).cast("array<double>"), best)
    return {
        "lang": F.when(known, F.get(F.array(*[F.lit(x) for x in langs]).cast("array<string>"), best)).otherwise("und"),
        "score": F.when(known, 1 / weight).otherwise(0.0),
        "entropy": F.when(known, lowest),
        "rejected": ~known | F.coalesce(lowest - allowance > limit, F.lit(False)),
    }


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", part_cells: int = PART_CELLS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and whether the text is rejected, of every document row."""
    base = narrow(docs, doc_id=doc_id, text=text, lang=lang)
    model = learn(base, part_cells=part_cells)
    scored, name = score(base, model)
    scored = written(scored.select("doc_id", "lang", name), "language-sums")
    found = decided(name, model.langs, calibrate(scored, name, model.langs))
    return scored.select(
        "doc_id", F.coalesce(crc_residue("doc_id", 4) == 2, F.lit(False)).alias("held_out"), found["lang"].alias("lang_pred"), found["score"].alias("score"),
        found["entropy"].alias("entropy"), found["rejected"].alias("rejected"),
    )


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Pipeline form: documents whose language is rejected go."""
    columns = docs.columns
    model = learn(docs, doc_id, text, lang)
    scored, name = score(docs, model, text)
    scored = written(scored, "language-sums")
    found = decided(name, model.langs, calibrate(scored, name, model.langs, doc_id, lang))
    return scored.where(~found["rejected"]).select(*[F.col(f"`{c}`") for c in columns])
