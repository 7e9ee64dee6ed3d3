"""All unordered bin pairs as a blocked equi-join.

The dense model matrix has one row per pair, so its size is the size of the
result.  Bins carry a block number; a small table of block pairs is joined to the
bins once on each side.  Every join is an equi-join on a block, each block pair is
an independent unit of work and a hot bin costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import int_div
from ..session import sized

PAIR_BLOCK = 256
MOST_TASKS = 4096  # the driver holds a record of every task


def block_pairs(spark, n_bins: int, size: int, per_task: int = 32) -> DataFrame:
    """``(block1 <= block2)`` for every unordered pair of blocks.

    Block ``b`` is paired with the half of the blocks that follow it on a circle, so
    every range of rows holds the same amount of work and no shuffle is needed to
    spread it.  A task takes ``per_task`` pairs of blocks, more where there would be too many tasks.
    """
    blocks = -(-n_bins // size)
    half = blocks // 2 + 1
    tasks = min(max(spark.sparkContext.defaultParallelism, min(-(-blocks * half // per_task), MOST_TASKS)), blocks * half)
    b, k = int_div(F.col("id"), half), F.pmod("id", F.lit(half)).cast("int")
    rows = spark.range(0, blocks * half, 1, tasks).select(b.alias("b"), k.alias("k"))
    if blocks % 2 == 0:  # opposite blocks would be met from both sides
        rows = rows.where((F.col("k") < blocks // 2) | (F.col("b") < blocks // 2))
    other = F.pmod(F.col("b") + F.col("k"), F.lit(blocks))
    return rows.select(F.least("b", other).alias("block1"), F.greatest("b", other).alias("block2"))


def bin_pairs(bins: DataFrame, n_bins: int, *, window1: tuple[int, int] | None = None,
              window2: tuple[int, int] | None = None, diagonal: bool = False,
              size: int = PAIR_BLOCK) -> DataFrame:
    """Rows ``bin1_id < bin2_id`` with every other column of ``bins`` on both ends.

    ``window1``/``window2`` are half-open bin ranges of the two ends; they cut the
    inputs before the join, so a slice costs only its own pairs.
    """
    spark = bins.sparkSession
    extra = [c for c in bins.columns if c != "bin_id"]

    def side(k: int, window):
        part = bins if window is None else bins.where(
            (F.col("bin_id") >= window[0]) & (F.col("bin_id") < window[1]))
        return part.select(int_div(F.col("bin_id"), size).alias(f"block{k}"),
                           F.col("bin_id").alias(f"bin{k}_id"),
                           *[F.col(c).alias(f"{c}{k}") for c in extra])

    order = F.col("bin1_id") <= F.col("bin2_id") if diagonal else F.col("bin1_id") < F.col("bin2_id")
    # the block pairs stay spread over the tasks while the bin side can be broadcast
    width = 32 + 32 * len(extra)
    return (block_pairs(spark, n_bins, size)
            .join(sized(side(1, window1), n_bins, width), "block1")
            .join(sized(side(2, window2), n_bins, width), "block2")
            .where(order).drop("block1", "block2"))


def _tiles_beside(bins: DataFrame, n_bins: int, cells: DataFrame, value: str | None, size: int) -> DataFrame:
    """Block pairs with the usable bins of both blocks and the cells stored there, packed in lists."""
    packed = (bins.where("bin_id is not null").groupBy(int_div(F.col("bin_id"), size).alias("block"))
              .agg(F.sort_array(F.collect_list("bin_id")).alias("ids")))
    ends = [F.pmod(f"bin{k}_id", F.lit(size)).cast("int").alias(name) for k, name in ((1, "i"), (2, "j"))]
    held = (cells.groupBy(*[int_div(F.col(f"bin{k}_id"), size).alias(f"block{k}") for k in (1, 2)])
            .agg(F.collect_list(F.struct(*ends, *([F.col(value).alias("x")] if value else []))).alias("held")))
    held = held.select("block1", "block2", *[F.col(f"held.{c}").alias(c) for c in (["i", "j", "x"] if value else ["i", "j"])])
    out = block_pairs(bins.sparkSession, n_bins, size).join(held, ["block1", "block2"], "left")
    for k in (1, 2):
        side = packed.select(F.col("block").alias(f"block{k}"), F.col("ids").alias(f"ids{k}"))
        out = out.join(sized(side, -(-n_bins // size), 32 + 8 * size), f"block{k}")
    return out


def _lists(batch: pa.RecordBatch, name: str) -> list[pa.Array]:
    """A column of lists as one array a row, empty where the list is NULL."""
    column = batch.column(name)
    empty = column.type.value_type
    return [row.values if row.is_valid else pa.array([], empty) for row in column]


def pairs_beside(bins: DataFrame, n_bins: int, cells: DataFrame, value: str, *, diagonal: bool = False,
                 size: int = PAIR_BLOCK) -> DataFrame:
    """Every pair of ``bins`` with the ``value`` stored for it in ``cells``, NULL where none is.

    Only the cells are exchanged: they are packed by block pair, and the pairs of a block pair are
    made beside them in memory.  A pair that ``cells`` repeats comes once for each.
    """
    kind, number = bins.schema["bin_id"].dataType.simpleString(), cells.schema[value].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_lists(batch, c) for c in ("ids1", "ids2", "i", "j", "x")]
            for b1, b2, ids1, ids2, i, j, x in zip(batch.column("block1").to_pylist(), batch.column("block2").to_pylist(), *columns):
                ids1, ids2, i, j = (c.to_numpy() for c in (ids1, ids2, i, j))
                place = np.full((size, size), -1, np.int64)
                place[i, j] = np.arange(len(i))
                rows, cols = np.nonzero(_ordered(ids1, ids2, diagonal))
                at = place[ids1[rows] % size, ids2[cols] % size]
                again = np.flatnonzero(place[i, j] != np.arange(len(i)))  # stored more than once
                if len(again):
                    pair = np.argsort(place[i[again], j[again]], kind="stable")
                    first = place[i[again], j[again]][pair]
                    low, high = np.searchsorted(first, at, "left"), np.searchsorted(first, at, "right")
                    many = np.where(at >= 0, high - low, 0)
                    whole = np.repeat(np.arange(len(at)), many)
                    nth = np.arange(len(whole)) - np.repeat(np.cumsum(many) - many, many)
                    at = np.r_[at, again[pair][low[whole] + nth]]
                    rows, cols = np.r_[rows, rows[whole]], np.r_[cols, cols[whole]]
                yield pa.RecordBatch.from_arrays([pa.array(ids1[rows]), pa.array(ids2[cols]), x.take(pa.array(at, mask=at < 0))],
                                                 names=["bin1_id", "bin2_id", value])

    tiles = _tiles_beside(bins.select("bin_id"), n_bins, cells, value, size)
    return tiles.mapInArrow(run, f"bin1_id {kind}, bin2_id {kind}, `{value}` {number}")


def pairs_without(bins: DataFrame, n_bins: int, cells: DataFrame, *, diagonal: bool = False,
                  size: int = PAIR_BLOCK) -> DataFrame:
    """Every pair of ``bins`` that ``cells`` does not hold, made like :func:`pairs_beside`."""
    kind = bins.schema["bin_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[c.to_numpy() for c in _lists(batch, name)] for name in ("ids1", "ids2", "i", "j")]
            for ids1, ids2, i, j in zip(*columns):
                free = np.ones((size, size), bool)
                free[i, j] = False
                rows, cols = np.nonzero(free[ids1 % size][:, ids2 % size] & _ordered(ids1, ids2, diagonal))
                yield pa.RecordBatch.from_arrays([pa.array(ids1[rows]), pa.array(ids2[cols])], names=["bin1_id", "bin2_id"])

    tiles = _tiles_beside(bins.select("bin_id"), n_bins, cells, None, size)
    return tiles.mapInArrow(run, f"bin1_id {kind}, bin2_id {kind}")


def _ordered(ids1: np.ndarray, ids2: np.ndarray, diagonal: bool) -> np.ndarray:
    return ids1[:, None] <= ids2[None, :] if diagonal else ids1[:, None] < ids2[None, :]
