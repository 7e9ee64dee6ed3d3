"""Mass of all usable pairs without forming them.

The sum of model values over every pair of bins is a convolution of the state vectors
with the decay within a chromosome and a product of sums between chromosomes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import int_div, weighted_states
from ..genome import Genome

MASS_BLOCK = 1024


class Model:
    """A point of the parameter space with its state table."""

    def __init__(self, states: DataFrame, genome: Genome, cis_weights, trans_weights, alpha: float,
                 beta: float, resolution: float | None = None):
        self.states = states.where(F.col("probs").isNotNull()).select("bin_id", "probs")
        self.genome = genome
        self.cis, self.trans = np.asarray(cis_weights, float), np.asarray(trans_weights, float)
        self.alpha, self.beta, self.resolution = float(alpha), float(beta), resolution

    @property
    def n_states(self) -> int:
        return len(self.cis)

    @property
    def ln_resolution(self) -> float:
        return float(np.log(self.resolution)) if self.resolution else 0.0


def _state_sums(states: DataFrame, model: Model) -> DataFrame:
    """Sum of the state vectors outside each chromosome, one row per chromosome."""
    chrom = model.genome.chrom_of(F.col("bin_id")).alias("chrom_idx")
    names = [f"s{k}" for k in range(model.n_states)]
    sums = (states.groupBy(chrom)
            .agg(*[F.sum(F.col("probs")[k]).alias(n) for k, n in enumerate(names)]))
    totals = [sums.agg(F.sum(n)).scalar() for n in names]
    return sums.select("chrom_idx", F.array(*[t - F.col(n) for t, n in zip(totals, names)]).alias("far"))


def pair_mass(model: Model, size: int = MASS_BLOCK) -> DataFrame:
    """Decay-weighted sums of the other bins' state vectors, per bin.

    ``near``: over bins of the same chromosome with weight ``d**alpha``;
    ``near_ln``: the same with an extra ``ln d``; ``far``: over all other chromosomes.
    State vectors are packed into blocks, each block meets the blocks of its
    chromosome through an equi-join and a pair of blocks is one FFT convolution.
    """
    genome, n_states, alpha, ln_res = model.genome, model.n_states, model.alpha, model.ln_resolution
    b = F.col("bin_id")
    offset = b - genome.start_of(b)
    packed = (model.states
              .groupBy(genome.chrom_of(b).alias("chrom_idx"), int_div(offset, size).alias("blk"))
              .agg(F.collect_list(F.pmod(offset, F.lit(size))).alias("pos"),
                   F.flatten(F.collect_list("probs")).alias("vec")))
    counts = F.element_at(F.array(*[F.lit(-(-n // size)) for n in genome.lengths]), F.col("chrom_idx") + 1)
    own = (packed.select("chrom_idx", F.col("blk").alias("to_blk"), F.col("pos").alias("to_pos"))
           .withColumn("blk", F.explode(F.sequence(F.lit(0), counts - 1))))
    tiles = own.join(packed, ["chrom_idx", "blk"])
    starts = genome.starts

    def convolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = 1 << (3 * size).bit_length()
        for frame in frames:
            for c, to, frm, to_pos, pos, vec in zip(frame["chrom_idx"], frame["to_blk"], frame["blk"],
                                                    frame["to_pos"], frame["pos"], frame["vec"]):
                block = np.zeros((size, n_states))
                block[pos] = np.asarray(vec).reshape(-1, n_states)
                lags = np.abs((int(to) - int(frm)) * size + np.arange(-(size - 1), size))
                with np.errstate(divide="ignore"):
                    ln_d = np.where(lags > 0, np.log(lags) + ln_res, 0.0)
                kernel = np.where(lags > 0, np.exp(alpha * ln_d), 0.0)
                spectrum = np.fft.rfft(block, width, axis=0)
                out = [np.fft.irfft(np.fft.rfft(k, width)[:, None] * spectrum, width, axis=0)[size - 1:2 * size - 1]
                       for k in (kernel, kernel * ln_d)]
                first = starts[int(c)] + int(to) * size
                yield pd.DataFrame({"bin_id": (first + np.asarray(to_pos)).astype(np.int32),
                                    "near": list(out[0][to_pos]), "near_ln": list(out[1][to_pos])})

    parts = tiles.mapInPandas(convolve, "bin_id int, near array<double>, near_ln array<double>")
    sums = parts.groupBy("bin_id").agg(*[F.sum(F.col(c)[k]).alias(f"{c}_{k}")
                                         for c in ("near", "near_ln") for k in range(n_states)])
    near = sums.select("bin_id", *[F.array(*[F.col(f"{c}_{k}") for k in range(n_states)]).alias(c)
                                   for c in ("near", "near_ln")])
    outside = F.broadcast(_state_sums(model.states, model))  # one row per chromosome
    return (model.states.withColumn("chrom_idx", genome.chrom_of(b))
            .join(near, "bin_id").join(outside, "chrom_idx").drop("chrom_idx"))


def _dot(a: Column, b: list[Column]) -> Column:
    total = a[0] * b[0]
    for k in range(1, len(b)):
        total = total + a[k] * b[k]
    return total


def pair_mass_sums(mass: DataFrame, model: Model) -> DataFrame:
    """One row: ``z`` and its derivatives by weights, ``alpha`` and ``beta``."""
    decay = float(np.exp(model.beta))
    p, near, near_ln, far = (F.col(c) for c in ("probs", "near", "near_ln", "far"))
    cis = _dot(p, weighted_states(model.cis, near)) / 2.0
    trans = _dot(p, weighted_states(model.trans, far)) * (decay / 2.0)
    n = model.n_states
    return mass.agg(
        F.sum(cis + trans).alias("z"), F.sum(_dot(p, weighted_states(model.cis, near_ln)) / 2.0).alias("z_alpha"),
        F.sum(trans).alias("z_beta"),
        *[F.sum(p[s] * near[t] / 2.0).alias(f"z_cis_{s}_{t}") for s in range(n) for t in range(n)],
        *[F.sum(p[s] * far[t] * (decay / 2.0)).alias(f"z_trans_{s}_{t}") for s in range(n) for t in range(n)])


def pair_mass_gradient(mass: DataFrame, model: Model) -> DataFrame:
    """``dZ/d lambda`` per bin as an array column ``z``."""
    decay = float(np.exp(model.beta))
    near = weighted_states(model.cis, F.col("near"))
    far = weighted_states(model.trans, F.col("far"))
    return mass.select("bin_id", F.array(*[a + F.lit(decay) * b for a, b in zip(near, far)]).alias("z"))
