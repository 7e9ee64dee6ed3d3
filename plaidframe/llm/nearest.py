"""Approximate nearest neighbours by collision counting on single projections.

Largest inner product becomes smallest distance by one more component: a vector x gets the one that makes its
norm the largest of all, a query none and the norm scaled to it.  ``PROJECTIONS`` random lines are the hash functions.
A block of vectors keeps, for each line, its projections sorted.  A query opens a window around its own projection
on every line; virtual rehashing widens all windows by a factor each round, counting only what is new.  A
vector that has been inside the windows of at least ``THRESHOLD`` of the lines is verified on the original vector.
A query stops in a block when ``VERIFY`` of the block (``LEAST`` times ``k`` at least) is verified; as windows grow until
they cover the block, it always finds ``k`` if there are so many.

Vectors are dealt into blocks of about ``BLOCK`` by a hash of the id, queries likewise; each pair of a block of
vectors and a block of queries is a task of its own, so neither all vectors nor all queries meet anywhere.  The k best
of each block are merged by a window over the query.

Defined cases: vectors that are null, zero, hold null or non-finite components, have no id or another length than
most vectors take no part; rows with one id are one vector, the smallest; ties go to the smaller id; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 48
THRESHOLD = 0.75
VERIFY = 0.1
LEAST = 25
WIDEN = 1.4
BLOCK = 16384
QUERIES = 4096


def lines(width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).standard_normal((width + 1, PROJECTIONS))


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added from the first to the last."""
    total = np.zeros(len(vectors))
    for k in range(len(query)):
        total += vectors[:, k] * query[k]
    return total


class Block:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        self.ids, self.vectors = ids, vectors
        self.lines = lines(vectors.shape[1])
        self.largest = largest
        rest = np.sqrt(np.maximum(largest ** 2 - (vectors ** 2).sum(axis=1), 0))
        places = np.column_stack([vectors, rest]) @ self.lines
        self.order = np.argsort(places, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(places.T, self.order, axis=1)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, vector ids and scores of up to ``k`` neighbours for each query."""
        n, m = len(self.ids), PROJECTIONS
        enough = min(n, max(LEAST * k, math.ceil(VERIFY * n)))
        needed = max(1, math.ceil(THRESHOLD * m))
        scaled = queries * (self.largest / np.sqrt((queries ** 2).sum(axis=1)))[:, None]
        centre = scaled @ self.lines[:-1]
        spread = max(float(self.sorted[:, -1].max() - self.sorted[:, 0].min()), 1e-12)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts = np.zeros((len(ids), n), np.uint8) if len(ids) * n <= 1 << 28 else None
        if counts is None:  # keep the counters of one call within memory
            halves = np.array_split(np.arange(len(ids)), 2)
            parts = [self.search(ids[h], queries[h], k) for h in halves]
            return tuple(np.concatenate(x) for x in zip(*parts))
        active = np.arange(len(ids))
        low = np.stack([np.searchsorted(self.sorted[j], centre[:, j]) for j in range(m)], axis=1)
        high = low.copy()
        half = spread / 64
        while len(active):
            new_low, new_high = low[active].copy(), high[active].copy()
            for j in range(m):
                new_low[:, j] = np.searchsorted(self.sorted[j], centre[active, j] - half, side="left")
                new_high[:, j] = np.searchsorted(self.sorted[j], centre[active, j] + half, side="right")
            np.minimum(new_low, low[active], out=new_low)
            np.maximum(new_high, high[active], out=new_high)
            left = []
            for at, q in enumerate(active):
                row = counts[q]
                for j in range(m):  # an id is at most once on a line, so plain indexing counts right
                    row[self.order[j, new_low[at, j]:low[q, j]]] += 1
                    row[self.order[j, high[q, j]:new_high[at, j]]] += 1
                found = np.flatnonzero(row >= needed)
                if len(found) >= enough or (new_high[at] - new_low[at]).min() == n:
                    out.append(self.verify(ids[q], queries[q], found, k))
                else:
                    left.append(q)
            low[active], high[active] = new_low, new_high
            active = np.array(left, np.int64)
            half *= WIDEN
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)

    def verify(self, query_id: int, query: np.ndarray, found: np.ndarray, k: int):
        found = found[self.ids[found] != query_id]
        rough = self.vectors[found] @ query
        if len(found) > k:  # rounding can move a product by far less than this margin
            bound = np.partition(rough, len(rough) - k)[len(rough) - k]
            found = found[rough >= bound - 1e-9 * max(1.0, abs(bound), self.largest * float(np.abs(query).sum()))]
        score = exact_scores(self.vectors[found], query)
        best = np.lexsort((self.ids[found], -score))[:k]
        return np.full(len(best), query_id), self.ids[found][best], score[best]


def usable(vectors: DataFrame, vec_id: str, column: str) -> DataFrame:
    """``(vec_id, vector)`` in double precision of the rows that take part."""
    vector = F.col(column).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector"))
            .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
            .where(finite & F.exists("vector", lambda x: x != 0)))


def search(vectors: DataFrame, query: Column, k: int = 20, vec_id: str = "vec_id",
           column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of each vector for which ``query`` (on vec_id) holds."""
    known = usable(vectors, vec_id, column)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    size = (known.groupBy(F.size("vector").alias("width"))
            .agg(F.count("*").alias("n"), F.max(F.sqrt(square)).alias("largest"),
                 F.count(F.when(query, 1)).alias("queries"))
            .orderBy(F.desc("n"), "width").limit(1).collect())
    if not size:
        return vectors.sparkSession.range(0).selectExpr(
            "id as query_id", "cast(id as int) as rank", "id as vec_id", "cast(id as double) as score")
    width, n, largest, asked = size[0]
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERIES))
    known = known.where(F.size("vector") == width)
    h = F.xxhash64("vec_id")
    dealt = known.withColumn("block", F.pmod(h, F.lit(blocks)).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asking = known.where(query).withColumn("part", F.pmod(F.shiftright(h, 20), F.lit(parts)).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def unique(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = np.stack(frame["vector"].to_numpy()) if len(frame) else np.zeros((0, width))
        ids = frame["vec_id"].to_numpy()
        order = np.lexsort((*rows.T[::-1], ids))
        first = np.r_[True, ids[order][1:] != ids[order][:-1]] if len(ids) else np.zeros(0, bool)
        return ids[order][first], rows[order][first]

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        block = Block(*unique(left), largest)
        return pd.DataFrame(dict(zip(names, block.search(*unique(right), k))))

    found = (dealt.groupBy("block", "part").cogroup(asking.groupBy("block", "part"))
             .applyInPandas(pair, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
