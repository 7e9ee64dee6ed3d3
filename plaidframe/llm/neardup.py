"""Near duplicates by an LSH forest of MinHash signatures, every link confirmed on full sets.

A document's set holds the hashes of its distinct 5-word shingles (64 bits; a wrong link needs
colliding hashes within one pair, below 1e-12).  Documents with equal sets form a class, only
its smallest id goes on.  A signature has 128 minima.  Each of 48 trees orders the classes by 16
of them: a key of the first 8 levels, then of 12, then of 16.  Neighbours in a tree's order that
agree in at least 8 levels are candidates; those confirmed are joined to components.  This makes
dense groups few components at little cost, but a forest alone misses links: trees share minima
(at similarity 0.85 all 48 miss a pair with probability 1.1e-4, at 0.80 with 3.1e-3), and a crowded
region keeps links apart in every order.

So what is left is searched exactly.  Shingles have one order, those that repeat often last.  Two sets that
reach the threshold share a shingle among the first few of both (a prefix filter), and from its places
follows how many they can share at most.  Pairs of different components that pass both are confirmed; no pair
beyond the threshold is left out, whatever the order and however dense the region.

Defined cases: null, empty and blank texts have no shingles, link with nothing and stay; rows with
the same doc_id are one node with several texts; rows without doc_id stay, with a null component;
ties do not matter, since components do not depend on order; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, sized
from .common import append, mix, slices, spaced_words
from .components import components

SHINGLE = 5
MINIMA = 128
TREES = 48
DEPTH = 16
FIRST = 8
REACH = 1
COUNTERS = 1 << 20
CHUNK = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(7))
_MASKS = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_FACTORS = _RANDOM.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ORDERS = np.stack([_RANDOM.permutation(MINIMA) for _ in range(TREES)])
_PLACES = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order of the rows."""
    for first, end, offsets, raw in slices(column):
        words, at = spaced_words(offsets, raw)
        n = len(words) - SHINGLE + 1
        if n > 0:
            rolled = words[:n] * _PLACES[0]
            for k in range(1, SHINGLE):
                rolled = rolled + words[k:k + n] * _PLACES[k]
            rolled = mix(rolled)
        for k in range(end - first):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= SHINGLE:
                yield np.unique(rolled[a:b - SHINGLE + 1])
            elif b > a:  # fewer words: the sequence as a whole
                yield mix(np.array([(words[a:b] * _PLACES[8:8 + b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        part = (low[k:k + 4096, None] ^ _MASKS) * _FACTORS
        best = np.minimum(best, part.min(axis=0))
    return best


def sketch(columns: list[pa.Array]) -> list[pa.Array]:
    """Set size, a 128-bit digest of the set and the signature of each text."""
    sizes, left, right, signs = [], [], [], []
    for shingles in shingle_sets(columns[0]):
        sizes.append(len(shingles))
        left.append(int(shingles.sum(dtype=np.uint64).view(np.int64)) if len(shingles) else 0)
        right.append(int(mix(shingles ^ _PLACES[9]).sum(dtype=np.uint64).view(np.int64)) if len(shingles) else 0)
        signs.append((signature(shingles) & np.uint32(0xFFFF)).astype("<u2").tobytes() if len(shingles) else None)
    return [pa.array(sizes, pa.int64()), pa.array(left, pa.int64()), pa.array(right, pa.int64()),
            pa.array(signs, pa.binary())]


def tree_rows(classes: DataFrame) -> DataFrame:
    """``(key, deep, node, component)``: the place of every class in every tree's order.

    The first 8 levels make the key.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, TREES + 1, dtype=np.uint64))
        for whole in batches:
            for start in range(0, len(whole), 4096):
                batch = whole.slice(start, 4096)
                sign = np.stack([np.frombuffer(b, "<u2") for b in batch.column(0).to_pylist()]).astype(np.uint64)
                keys, deep = [], []
                for tree in range(TREES):
                    path = sign[:, _ORDERS[tree, :DEPTH]]
                    key = (path[:, :FIRST] * _PLACES[:FIRST]).sum(axis=1, dtype=np.uint64) + seeds[tree]
                    mid = mix((path[:, FIRST:12] * _PLACES[FIRST:12]).sum(axis=1, dtype=np.uint64))
                    end = mix((path[:, 12:] * _PLACES[12:16]).sum(axis=1, dtype=np.uint64))
                    keys.append(mix(key).view(np.int64))
                    deep.append(((mid & np.uint64(0x7FFF)) << np.uint64(16) | (end & np.uint64(0xFFFF))).astype(np.int32))
                n = len(batch)
                again = np.tile(np.arange(n), TREES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(deep)),
                     batch.column(1).take(pa.array(again)), batch.column(2).take(pa.array(again))],
                    names=["key", "deep", "node", "component"])

    return (classes.select("signature", "node", "component")
            .mapInArrow(expand, "key long, deep int, node long, component long"))


def neighbours(ordered: DataFrame, reach: int) -> DataFrame:
    """Pairs of different components, at most ``reach`` places apart, whose first 8 levels agree."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            key, node, part = (np.concatenate([a, b]) for a, b in zip(last, new))
            old = len(last[0])
            for lag in range(1, min(reach, len(key) - 1) + 1):
                begin = max(old - lag, 0)
                same = key[begin:-lag] == key[begin + lag:]
                if not same.any():
                    break
                at = np.flatnonzero(same & (part[begin:-lag] != part[begin + lag:])) + begin
                a, b = node[at], node[at + lag]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])
            last = [x[-reach:] for x in (key, node, part)]

    return ordered.select("key", "node", "component").mapInArrow(pair, "u long, v long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach ``percent`` per cent of their union.

    Only texts that occur in a pair are shuffled.
    """
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = texts.join(sized(nodes, nodes.count(), 64), "node", "left_semi")
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("__left"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("__right"))

    def check(columns: list[pa.Array]) -> list[pa.Array]:
        linked = []
        for a, b in zip(shingle_sets(columns[0]), shingle_sets(columns[1])):
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked.append(bool(both) and 100 * both >= percent * (len(a) + len(b) - both))
        return [pa.array(linked, pa.bool_())]

    joined = pairs.join(left, "u").join(right, "v")
    return append(joined, "linked boolean", ["__left", "__right"], check).where("linked").select("u", "v")


def repeats(rows: DataFrame) -> np.ndarray:
    """How often shingles repeat within a chunk of texts, by hash in ``COUNTERS`` buckets.

    It orders the shingles of prefixes and decides on their cost only, so that counts may be low or shared.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(COUNTERS, np.int64), [], 0

        def settle() -> None:
            shingle, n = np.unique(np.concatenate(held), return_counts=True)
            np.add.at(total, bucket_of(shingle[n > 1]), n[n > 1])
            held.clear()

        for batch in batches:
            for shingles in shingle_sets(batch.column(0)):
                held.append(shingles)
                size += len(shingles)
                if size >= CHUNK:
                    settle()
                    size = 0
        if held:
            settle()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    table = (rows.select("text").mapInArrow(count, "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(COUNTERS, np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def prefix_rows(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``(token, place, n, node, component)``: the first shingles of every class, n is the size of its set.

    A set of n shares at least ``percent`` of its shingles with any it is linked to, so one of the first
    n - least + 1 is shared.
    """
    sent = rows.sparkSession.sparkContext.broadcast(repeats(rows))

    def prefix(columns: list[pa.Array]) -> list[pa.Array]:
        sizes, left, right, packed = [], [], [], []
        for shingles in shingle_sets(columns[0]):
            n = len(shingles)
            sizes.append(n)
            left.append(int(shingles.sum(dtype=np.uint64).view(np.int64)) if n else 0)
            right.append(int(mix(shingles ^ _PLACES[9]).sum(dtype=np.uint64).view(np.int64)) if n else 0)
            order = np.argsort(sent.value[bucket_of(shingles)], kind="stable")
            packed.append(shingles[order[:n + percent * -n // 100 + 1]].tobytes() if n else b"")
        return [pa.array(sizes, pa.int64()), pa.array(left, pa.int64()), pa.array(right, pa.int64()),
                pa.array(packed, pa.binary())]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                packed = [np.frombuffer(b, np.int64) for b in batch.column(0).to_pylist()]
                again = pa.array(np.repeat(np.arange(len(packed)), [len(x) for x in packed]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(packed)), pa.array(np.concatenate([np.arange(len(x)) for x in packed])),
                     *[batch.column(k).take(again) for k in (1, 2, 3)]],
                    names=["token", "place", "n", "node", "component"])

    made = append(rows.withColumnRenamed("doc_id", "node"), "n long, left long, right long, packed binary", ["text"], prefix)
    held = made.drop("text").join(sized(classes, classes.count(), 64), ["node", "left", "right"])
    return cut(held.select("packed", "n", "node", "component")).mapInArrow(
        expand, "token long, place long, n long, node long, component long")


def remaining_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components of ``classes(node, left, right, component)``, none that is linked left out.

    Only shingles with several components in their prefixes are joined, in bands of sizes that can be linked.  The
    smaller set of a pair needs fewer of its shingles.  Their places tell how many shingles can be shared.
    """
    every = prefix_rows(rows, classes, percent)
    mixed = cut(every.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                .where("low < high").select("token"))
    width = math.log(100 / percent) + 1e-9
    some = cut(every.join(sized(mixed, mixed.count(), 64), "token", "left_semi").dropDuplicates()
               .withColumn("band", F.floor(F.log("n") / F.lit(width))))
    few = some.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)))
    a = few.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("a")
    b = some.alias("b")
    shared = F.least(F.expr("a.n - a.place"), F.expr("b.n - b.place"))
    fits = (F.expr("a.token = b.token and a.band = b.band and a.component <> b.component")
            & F.expr("a.n < b.n or (a.n = b.n and a.node < b.node)")
            & (percent * F.col("b.n") <= 100 * F.col("a.n"))
            & ((100 + percent) * shared >= percent * (F.col("a.n") + F.col("b.n"))))
    return a.join(b, fits).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, reach: int = REACH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id, text)``.

    ``reach``, how far the forest looks in an order, moves work between the two searches and leaves the result.
    """
    rows = docs.select("doc_id", "text")
    sketched = cut(append(rows, "n_shingles long, left long, right long, signature binary", ["text"], sketch)
                   .drop("text"))
    full = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # equal sets: one class, told by its smallest id; ids with several texts link their classes
    classes = full.groupBy("left", "right").agg(F.min("doc_id").alias("node"))
    members = full.select("doc_id", "left", "right").join(classes, ["left", "right"])
    lead = cut(full.select("left", "right", "signature", F.col("doc_id").alias("node"))
               .join(classes, ["left", "right", "node"], "left_semi").dropDuplicates(["left", "right", "node"]))
    texts = rows.where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "node")
    ordered = sort_trees(tree_rows(lead.withColumn("component", F.col("node"))))
    tried = cut(neighbours(ordered, reach))
    links = cut(confirm(tried, texts, percent))
    joined = cut(components(links))
    rest = remaining_pairs(rows, lead.join(joined, "node", "left")
                           .select("node", "left", "right", F.coalesce("component", "node").alias("component")), percent)
    more = confirm(cut(rest.join(tried, ["u", "v"], "left_anti")), texts, percent)
    links = joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
    same_set = members.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = components(links.unionByName(same_set))
    return (sketched.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))))


def sort_trees(placed: DataFrame) -> DataFrame:
    return placed.repartitionByRange("key", "deep", "node").sortWithinPartitions("key", "deep", "node")
