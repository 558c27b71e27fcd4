"""Exact top-k by inner product with a pivot-distance index.

Integer vectors are lifted to a common length (one more component, sqrt(R^2 -
|x|^2) with R the largest norm; 0 for queries), which turns the largest inner
product into the smallest distance.  Each vector is keyed by its nearest pivot and
its distance to it; a pivot's vectors, in order of that distance, fall into annuli.

A query expands its annuli in order of their lower bound: by the triangle
inequality nothing in an annulus [low, high] around a pivot at distance d from the
query is nearer to it than low - d or d - high.  Its first visit goes to the nearest
annulus; each further round takes a growing run of the next ones (`WIDEN`), with the
radius that the k-th best score so far gives, and a query stops as soon as its next
annulus begins beyond that radius.  Scores are integer inner products, so the result
is exact.  Queries are a stated set; they meet vectors in blocks of about `BLOCK`
rows and at most about `QUERIES` queries (an annulus with more rows, such as thousands
of copies of one vector, is dealt over several blocks by a hash, and so are its
queries), never as a cross join.

The pivots are chosen from a bounded sample of `PIVOT_SAMPLE` vectors by farthest
point; every vector is indexed.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, neither do rows without an id; vectors of unequal length
are compared as if padded with zeros; rows that share an id are one candidate
each, but none for queries of that id; a query row that is repeated gets each rank
once (one query per distinct id and vector, each with ranks of its own); with fewer than k candidates all are
returned; no candidates, no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findspar.llm._frames import discard, narrow, written

SCALE = 256
PIVOTS = 32
PIVOT_SAMPLE = 4096
BLOCK = 2048
RINGS = 1024
QUERIES = 4096
QUERY_BLOCK = 256
WIDEN = 8
NO_FLOOR = -(2**62)


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) with v = floor(SCALE x component); only vectors that take part."""
    rows = narrow(vectors, vec_id=vec_id, e=embedding).withColumn("e", F.col("e").cast("array<double>"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & fine)
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(SCALE))).cast("bigint")).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-point choice, starting from the sample's first row."""
    chosen = [0]
    distance = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen].astype(np.float64)


def search(vectors: DataFrame, is_query: F.Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row with `is_query` (a condition on vec_id), ties to the smaller vec_id."""
    data = written(quantised(vectors, vec_id, embedding), "topk-vectors")
    id_type = dict(data.dtypes)["vec_id"]
    squared = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    bounds = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(squared).alias("top")).first()
    out = f"query_id {id_type}, rank int, vec_id {id_type}, score bigint"
    if not bounds["n"]:
        return data.sparkSession.createDataFrame([], out)
    width_of, top = bounds["width"], float(bounds["top"])
    share = PIVOT_SAMPLE / bounds["n"]
    rows = data.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).select("v").toPandas()
    if rows.empty:
        rows = data.limit(1).select("v").toPandas()

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v.astype(np.float64), np.sqrt(np.maximum(top - (v * v).sum(1), 0))[:, None]], 1)

    pivots = choose_pivots(lifted(_matrix(rows["v"], width_of)))

    def distances(points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
        return np.sqrt(np.maximum(square, 0))

    def key(batches):  # each vector's pivot and distance
        for batch in batches:
            d = distances(lifted(_matrix(batch["v"], width_of))) if len(batch) else np.zeros((0, len(pivots)))
            near = d.argmin(1) if len(batch) else np.zeros(0, np.int64)
            yield batch.assign(pivot=near.astype(np.int32), distance=d[np.arange(len(near)), near])

    keyed = written(data.mapInPandas(key, f"vec_id {id_type}, v array<bigint>, pivot int, distance double"), "topk-keyed")
    # annuli: about BLOCK rows each, by quantiles of a pivot's distances
    fine = max(1, min(RINGS, bounds["n"] // BLOCK))
    quantiles = [i / fine for i in range(1, fine)] or [0.5]
    cuts = {}
    for r in keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", quantiles, 10_000).alias("cuts")).collect():  # a row per pivot
        step = max(1, round(fine * BLOCK / r["n"]))
        cuts[r["pivot"]] = np.unique(np.array(r["cuts"][step - 1 :: step], float)) if fine > 1 else np.zeros(0)

    def ring(batches):
        for batch in batches:
            own = [pivot * RINGS + int(np.searchsorted(cuts[pivot], d)) for pivot, d in zip(batch["pivot"].tolist(), batch["distance"].tolist(), strict=True)]
            yield batch.assign(cell=np.array(own, np.int32))[["vec_id", "v", "distance", "cell"]]

    index = written(keyed.mapInPandas(ring, f"vec_id {id_type}, v array<bigint>, distance double, cell int"), "topk-index")
    discard(keyed)
    cells = sorted(index.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect())  # at most PIVOTS x RINGS rows
    cell, sizes, low, high = (np.array(x) for x in zip(*cells, strict=True))
    blocks = dict(zip(cell.tolist(), (-(-sizes // BLOCK)).tolist(), strict=True))
    queries = data.where(is_query).distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.xxhash64("vec_id", "v").alias("name"))
    queries = written(queries, "topk-queries")

    def expand(start: int, width: int):
        def run(batches):
            for batch in batches:
                q = _matrix(batch["q"], width_of)
                at = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], 1)
                d = distances(at) if len(batch) else np.zeros((0, len(pivots)))
                reach = np.sqrt(np.maximum(top + (at * at).sum(1) - 2.0 * np.maximum(batch["floor"].to_numpy(float), -1e15), 0)) * (1 + 1e-9) + 1e-6
                chosen = []
                for own, limit in zip(d, reach.tolist(), strict=True):
                    away = own[cell // RINGS]
                    bound = np.maximum(np.maximum(low - away, away - high), 0)
                    next_ = np.lexsort((away, bound))[start : start + width]
                    chosen.append(cell[next_[bound[next_] <= limit]].tolist())
                yield batch.assign(cells=chosen)

        return run

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Each query's k best in one block, of scores not below its floor."""
        found = []
        if len(left) and len(right):
            v, ids = _matrix(right["v"], width_of), right["vec_id"].to_numpy()
            for at in range(0, len(left), QUERY_BLOCK):
                part = left.iloc[at : at + QUERY_BLOCK]
                # products below 2^53 are exact in double precision, and much faster
                q = _matrix(part["q"], width_of)
                wide = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * width_of >= 2**53
                scores = q @ v.T if wide else (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
                for query, name, own, bar in zip(part["query_id"].to_numpy(), part["name"].to_numpy(), scores, part["floor"].to_numpy(), strict=True):
                    on = np.flatnonzero((ids != query) & (own >= bar))
                    if len(on) > 4 * k:  # all that tie with the k-th stay until ties are broken
                        kth = np.partition(own[on], len(on) - k)[len(on) - k]
                        on = on[own[on] >= kth]
                    found += [(query, name, ids[i], int(own[i])) for i in on[np.lexsort((ids[on], -own[on]))][:k]]
        return pd.DataFrame(found, columns=["query_id", "name", "vec_id", "score"])

    hits = f"query_id {id_type}, name bigint, vec_id {id_type}, score bigint"
    rank = F.row_number().over(Window.partitionBy("query_id", "name").orderBy(F.col("score").desc(), "vec_id"))
    best = data.sparkSession.createDataFrame([], hits).withColumn("rank", F.lit(0))
    start, width = 0, 1
    while start < len(cells):
        floor = best.groupBy("query_id", "name").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        asked = queries.join(floor, ["query_id", "name"], "left").select("query_id", "q", "name", F.coalesce("floor", F.lit(NO_FLOOR)).alias("floor"))
        asked = written(asked.mapInPandas(expand(start, width), f"query_id {id_type}, q array<bigint>, name bigint, floor bigint, cells array<int>"), "topk-visits")
        visits = asked.select("query_id", "q", "name", "floor", F.explode("cells").alias("cell"))
        busy = [(r["cell"], blocks[r["cell"]], -(-r["n"] // QUERIES)) for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()]  # at most PIVOTS x RINGS rows
        if not busy:
            discard(asked)
            break
        busy = F.broadcast(data.sparkSession.createDataFrame(busy, "cell int, blocks int, groups int"))
        left = visits.join(busy, "cell").withColumn("group", F.pmod(F.xxhash64("name", "cell"), F.col("groups")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = index.join(busy, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        keys = ["cell", "block", "group"]
        got = left.select(*keys, "query_id", "q", "name", "floor").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "v").groupBy(*keys)).applyInPandas(visit, hits)
        before, best = best, written(got.union(best.drop("rank")).withColumn("rank", rank).where(F.col("rank") <= k), "topk-best")
        discard(asked, before)
        start, width = start + width, width * WIDEN
    discard(data, index, queries)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(vectors: DataFrame, step: int = 50, k: int = 5) -> DataFrame:
    """Queries: rows whose vec_id is divisible by `step`; candidates: every row but the query's own."""
    return search(vectors, F.col("vec_id") % step == 0, k)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0
), s AS (
  SELECT q.vec_id AS query_id, q.v, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
