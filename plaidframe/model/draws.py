"""Keyed draws of reads from a model whose cells are never rows.

A tile, a pair of blocks of state vectors, makes its cells in memory.  A first pass hands on one mass for
each row of a tile; running totals of these are where the rows of the tiles begin in the cumulative mass
(cells ordered by ids).  Reads are merged with the beginnings, go packed to their tiles, and a second pass
makes the cells again and finds each read's cell in its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.permutation import DIGITS, hashed
from ..operators.ordered import last_before, running_total
from ..session import cut
from .mass import Model
from .moments import between_blocks, block_count, block_of, tile_matrix, tiles

TILE = 1024


def multinomial_keyed(model: Model, n: int, seed: int = 0, out: str = "count", size: int = TILE,
                      reads_per_piece: int = 1 << 20) -> DataFrame:
    """Draw ``n`` reads with replacement by inverting the cumulative distribution with hashed uniforms.

    Only reads and row masses are exchanged; cells are made where they are needed.  A piece of the
    cumulative mass, with about ``reads_per_piece`` reads, is merged apart and meets a tile apart.
    """
    spark, genome = model.states.sparkSession, model.genome
    values, blocks = tile_matrix(model), block_count(genome, size)

    def masses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rows, _, cells = values(r)
                mass = np.cumsum(cells, axis=1)[:, -1]
                some = mass > 0
                yield pd.DataFrame({"segment": rows[some] * blocks + int(r.block2), "mass": mass[some]})

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rows, cols, cells = values(r)
                ends = np.cumsum(cells, axis=1)
                bins, offsets = np.asarray(r.bins), np.asarray(r.offsets)
                order = np.argsort(bins, kind="stable")
                at, offsets = np.searchsorted(rows, bins[order]), offsets[order]
                cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
                cell = np.empty(len(at), np.int64)
                for low, high in zip(cuts[:-1], cuts[1:]):
                    end = ends[at[low]]
                    last = np.searchsorted(end, end[-1])  # the last cell with mass
                    cell[low:high] = np.minimum(np.searchsorted(end, offsets[low:high], side="right"), last)
                hit, reads = np.unique(at * len(cols) + cell, return_counts=True)
                yield pd.DataFrame({"bin1_id": rows[hit // len(cols)].astype(np.int32),
                                    "bin2_id": cols[hit % len(cols)].astype(np.int32), "reads": reads})

    held = cut(tiles(model, size).mapInPandas(masses, "segment long, mass double"))
    total = float(held.agg(F.sum("mass")).first()[0] or 0.0)
    if not total:
        return spark.createDataFrame([], f"bin1_id int, bin2_id int, {out} long")
    begins = running_total(held, F.col("mass"), "segment", "u")
    marks = begins.select("u", F.struct("segment", F.col("u").alias("begin")).alias("state"))
    pieces = max(1, -(-int(n) // reads_per_piece))
    piece = F.floor(F.col("u") / F.lit(total) * F.lit(pieces))
    uniform = hashed(F.lit(str(seed)), F.col("id")) / F.lit(float(16 ** DIGITS)) * F.lit(total)
    reads = spark.range(0, int(n)).select(uniform.alias("u"))
    row = F.call_function("div", F.col("last.segment"), F.lit(blocks)).cast("int")
    dealt = (last_before(marks, reads, "u", piece)
             .select(row.alias("bin"), F.pmod("last.segment", F.lit(blocks)).cast("int").alias("block2"),
                     (F.col("u") - F.col("last.begin")).alias("offset"), piece.alias("piece"))
             .groupBy(block_of(genome, F.col("bin"), size).alias("block1"), "block2", "piece")
             .agg(F.collect_list("bin").alias("bins"), F.collect_list("offset").alias("offsets")))
    cells = between_blocks(dealt, model, size).mapInPandas(drawn, "bin1_id int, bin2_id int, reads long")
    return cells.groupBy("bin1_id", "bin2_id").agg(F.sum("reads").alias(out))
