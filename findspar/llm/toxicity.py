"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>) over the distinct
terms of a text.  Terms are words and word
stems.  The pair part learns what no additive model can, such as an
insult next to a group mention.  Terms get weights if they tell something about the
label alone or next to another term (`selected`); the weights are learned by AdaGrad
with soft-thresholding, so that terms without a signal keep exactly nothing and a
long clean text doesn't drift away from a short one.

Fitting uses a sample of at most `MAX_TRAIN` labelled rows (chosen by a hash of the
id), which the driver reads as term numbers; its size doesn't grow with the corpus.
Scoring covers every document where it is read, without a shuffle: the model is
`BUCKETS` x (1 + FACTORS) floats, whatever the corpus.

Defined results: a null or wordless text gets the score of the bias alone; rows
repeat their result; without training rows the bias is that of no evidence (score
0.1); several labels of one id count as toxic if any is; null labels don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspar.llm import _words as w
from findspar.llm._frames import add_struct, crc_residue, fresh, narrow, return_memory

BUCKETS = 1 << 18
FACTORS = 4
MAX_TRAIN = 10_000
MIN_ROWS = 4
MIN_G2 = 10.8  # chance 0.001 for a term without a signal
MIN_PAIR_G2 = 60.0  # far beyond chance: millions of pairs are tried, and near copies of a text agree in many
LEADING, FREQUENT = 256, 1024
#: Stems are the first so many bytes of longer words: they carry over to inflected forms that training never saw.
STEMS = (4, 5, 6, 7)
EPOCHS, BATCH, RATE = 8, 128, 0.4
L1, PAIR_L1 = 4e-4, 2e-4
FIELDS = "score double, predicted int"


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # BUCKETS
    factor: np.ndarray  # BUCKETS x FACTORS

    def raw(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The margin of each row of distinct terms."""
        linear = w.per_row(self.weight[terms].astype(np.float64), first)
        v = self.factor[terms].astype(np.float64)
        pair = w.per_row(v, first) ** 2 - w.per_row(v * v, first)
        return self.bias + linear + 0.5 * pair.sum(1)


def terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashed terms of each row, by runs of rows: words (lower-cased), and their stems of a few lengths in bytes."""
    for _, _, data, offsets in w.slices(column):
        data = w.LOWER[data]
        starts, ends, first = w.spans(data, offsets, w.ALNUM)
        row = w.row_of(first)
        rows, hashed = [row], [w.hashes(data, starts, ends)]
        for size in STEMS:
            on = ends - starts > size
            rows.append(row[on])
            hashed.append(w.mix64(w.hashes(data, starts[on], starts[on] + size) + np.uint64(size)))
        key = np.unique((np.concatenate(rows) << 18) | (np.concatenate(hashed) >> np.uint64(46)).astype(np.int64))
        yield key & (BUCKETS - 1), np.searchsorted(key >> 18, np.arange(len(first)))


def g2(both: np.ndarray, have: np.ndarray, positive: np.ndarray | float, n: np.ndarray | float) -> np.ndarray:
    """Likelihood-ratio statistics of terms against the label: `have` of n rows hold the term, `both` of the `positive` ones."""
    out = np.zeros(np.shape(have))
    for seen, total in ((both, positive), (have - both, n - positive)):
        for observed, margin in ((seen, have), (total - seen, n - have)):
            expected = np.maximum(margin * total / np.maximum(n, 1), 1e-12)
            out += 2 * np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / expected), 0)
    return out


def selected(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Terms that get weights: those of at least MIN_ROWS rows that tell something about the label, alone or next to another term.

    Alone: G2 of at least MIN_G2.  Next to another: G2 of at least MIN_PAIR_G2 among
    the rows that hold one of the LEADING terms with the highest G2; or, among the
    FREQUENT most frequent terms, whatever their own G2, among the rows with another
    of them.  So both terms of a pair stay even if each says nothing alone.
    Rows that repeat count once.
    """
    once = {(hash(row.tobytes()), label): i for i, (row, label) in enumerate(zip(rows, labels.tolist(), strict=True))}
    kept = sorted(once.values())
    labels = labels[kept]
    n, positive = len(kept), float(labels.sum())
    # everything goes row by row: the driver holds no copy of all terms but the list `own`
    support, toxic_support = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, label in zip(kept, labels.tolist(), strict=True):
        support[rows[i]] += 1
        if label:
            toxic_support[rows[i]] += 1
    names = np.flatnonzero(support >= MIN_ROWS)
    if not len(names):
        return names
    local = np.full(BUCKETS, -1, np.int32)
    local[names] = np.arange(len(names))
    own = [x[x >= 0] for x in (local[rows[i]] for i in kept)]
    m, have = len(names), support[names]
    alone = g2(toxic_support[names], have, positive, n)
    keep = alone >= MIN_G2

    leading = [i for i in np.argsort(-alone, kind="stable")[:LEADING].tolist() if keep[i] and have[i] >= 2 * MIN_ROWS]
    is_leading = np.zeros(m, bool)
    is_leading[leading] = True
    holders_of: dict[int, list[int]] = {i: [] for i in leading}
    for r, terms_ in enumerate(own):
        for lead in terms_[is_leading[terms_]].tolist():
            holders_of[lead].append(r)
    for holders in holders_of.values():
        seen, toxic = np.zeros(m), np.zeros(m)
        for r in holders:
            seen[own[r]] += 1
            if labels[r]:
                toxic[own[r]] += 1
        keep |= (seen >= MIN_ROWS) & (g2(toxic, seen, float(labels[holders].sum()), len(holders)) >= MIN_PAIR_G2)

    common = np.argsort(-have, kind="stable")[:FREQUENT]
    place = np.full(m, -1, np.int32)
    place[common] = np.arange(len(common))
    holds = np.zeros((n, len(common)), np.float32)
    for r, terms_ in enumerate(own):
        at = place[terms_]
        holds[r, at[at >= 0]] = 1
    together = holds.T @ holds
    holds = holds[labels > 0]
    toxic = holds.T @ holds
    for i in range(len(common)):  # a row at a time: the statistics of all pairs at once are many matrices of their size
        if together[i, i] >= 2 * MIN_ROWS:
            keep[common] |= g2(toxic[i].astype(float), together[i].astype(float), float(toxic[i, i]), float(together[i, i])) >= MIN_PAIR_G2
    return names[keep]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad over mini-batches of the `selected` terms; rows hold distinct terms."""
    model = Machine(float(np.log(0.1 / 0.9)), np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    if not len(rows):
        return model
    kept = selected(rows, labels)
    local = np.full(BUCKETS, -1, np.int64)
    local[kept] = np.arange(len(kept))
    packed = [x[x >= 0] for x in (local[r] for r in rows)]
    share = np.clip(labels.mean(), 0.01, 0.99)
    rng = np.random.default_rng(seed)
    n, k = len(kept), FACTORS
    bias, weight, factor = float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, 0.01, (n, k))
    g_bias, g_weight, g_factor = 1e-4, np.full(n, 1e-4), np.full((n, k), 1e-4)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(packed))
        for at in range(0, len(order), BATCH):
            batch = [packed[i] for i in order[at : at + BATCH]]
            first = np.concatenate([[0], np.cumsum([len(x) for x in batch])])
            index = np.concatenate(batch).astype(np.int64)
            y = labels[order[at : at + BATCH]]
            v = factor[index]
            total = w.per_row(v, first)
            margin = bias + w.per_row(weight[index], first) + 0.5 * (total**2 - w.per_row(v * v, first)).sum(1)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(batch)
            each = np.repeat(slope, np.diff(first))
            used, inverse = np.unique(index, return_inverse=True)
            d_weight = np.bincount(inverse, each, len(used))
            row_total = np.repeat(total, np.diff(first), axis=0)
            d_pair = each[:, None] * (row_total - v)
            d_factor = np.stack([np.bincount(inverse, d_pair[:, j], len(used)) for j in range(k)], 1)
            g_weight[used] += d_weight**2
            g_factor[used] += d_factor**2
            g_bias += slope.sum() ** 2
            weight[used] -= RATE / np.sqrt(g_weight[used]) * d_weight
            factor[used] -= RATE / np.sqrt(g_factor[used]) * d_factor
            # every term shrinks at every step, so that rare ones aren't spared
            weight = np.sign(weight) * np.maximum(np.abs(weight) - RATE / np.sqrt(g_weight) * L1, 0)
            factor = np.sign(factor) * np.maximum(np.abs(factor) - RATE / np.sqrt(g_factor) * PAIR_L1, 0)
            bias -= RATE / np.sqrt(g_bias) * slope.sum()
    model.bias = bias
    model.weight[kept], model.factor[kept] = weight, factor
    return model


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic", folds: int = 5, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on labelled documents whose crc32(id) modulo `folds` isn't 0."""
    known = narrow(labels, id=label_id, y=label).where(F.col("id").isNotNull() & F.col("y").isNotNull()).where(crc_residue("id", folds) != 0)
    known = known.groupBy("id").agg(F.max(F.col("y").cast("int")).alias("y"))
    share = max_train / max(1, known.count())
    if share < 1:  # the rows of the lowest hashes: a stated sample of at most max_train rows
        known = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    joined = narrow(docs, id=doc_id, text=text).join(F.broadcast(known), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for term, first in terms(batch.column("text")):
                cells += [term[first[i] : first[i + 1]].astype(np.int32).tobytes() for i in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(cells, pa.binary())], names=["id", "y", "terms"])

    id_type = dict(joined.dtypes)["id"]
    # one row for each id, so that repeated documents don't go beyond the sample's bound
    rows = joined.select("id", "y", "text").mapInArrow(features, f"id {id_type}, y int, terms binary").groupBy("id", "y").agg(F.min("terms").alias("terms")).orderBy("id").select("y", "terms").toArrow()
    model = fit([np.frombuffer(r.as_buffer(), np.int32) for r in rows["terms"]], rows["y"].to_numpy().astype(np.float64))
    del rows
    return_memory()
    return model


def score(docs: DataFrame, model: Machine, text: str = "text", name: str = "toxicity") -> tuple[DataFrame, str]:
    """docs with a struct column (score, predicted), and its name."""
    name = fresh(docs, name)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        own = sent.value
        margins = [own.raw(term, first) for term, first in terms(column)]
        score = 1 / (1 + np.exp(-np.clip(np.concatenate(margins), -700, 700))) if margins else np.zeros(0)
        return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]

    return add_struct(docs, text, FIELDS, run, name), name


def digest(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document row; a null id counts as not held out."""
    scored, name = score(narrow(docs, doc_id=doc_id, text=text), learn(docs, labels, doc_id, text))
    return scored.select("doc_id", F.coalesce(crc_residue("doc_id", 5) == 0, F.lit(False)).alias("held_out"), f"{name}.score", f"{name}.predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pipeline form: documents that are predicted toxic go."""
    columns = docs.columns
    scored, name = score(docs, learn(docs, labels, doc_id, text), text)
    return scored.where(F.col(f"{name}.predicted") == 0).select(*[F.col(f"`{c}`") for c in columns])
