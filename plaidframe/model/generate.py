"""Model matrices: all pairs, slices and chromosomes, as lazy frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bilinear, ln_decay, ln_distance, share, zero_to_null
from ..genome import Genome
from ..operators.pairs import bin_pairs
from ..operators.reshape import select_fit
from ..operators.select import attach_ends
from .mass import Model, pair_mass, pair_mass_sums


def with_model_terms(pairs: DataFrame, model: Model) -> DataFrame:
    """Add ``cis``, ``ln_d``, ``g`` (compartment term), ``ln_decay`` and ``ln_p`` to
    pairs that carry ``probs1`` and ``probs2``."""
    p1, p2 = F.col("probs1"), F.col("probs2")
    return (pairs.withColumn("cis", model.genome.same_chrom(F.col("bin1_id"), F.col("bin2_id")))
            .withColumn("ln_d", ln_distance(F.col("bin1_id"), F.col("bin2_id"), model.resolution))
            .withColumn("g", F.when(F.col("cis"), bilinear(p1, model.cis, p2))
                        .otherwise(bilinear(p1, model.trans, p2)))
            .withColumn("ln_decay", ln_decay(F.col("cis"), F.col("ln_d"), model.alpha, model.beta))
            .withColumn("ln_p", F.ln("g") + F.col("ln_decay")))


def pixel_terms(model: Model, pixels: DataFrame) -> DataFrame:
    """Model terms of stored pixels; pixels on the diagonal or with an unusable bin drop out."""
    pairs = attach_ends(pixels.where("bin1_id < bin2_id"), model.states, ["probs"], model.genome.n_bins,
                        row_bytes=32 + 8 * model.n_states)
    return with_model_terms(pairs, model)


class ModelMatrix:
    """Matrix of a model whose cells are computed when and where they are asked for."""

    def __init__(self, model: Model):
        self.model, self.genome = model, model.genome

    @property
    def shape(self) -> tuple[int, int]:
        return self.genome.n_bins, self.genome.n_bins

    def pairs(self, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
        pairs = bin_pairs(self.model.states, self.genome.n_bins, window1=rows, window2=cols)
        return with_model_terms(pairs, self.model)

    def values(self) -> DataFrame:
        """Every usable pair ``i < j`` with its unnormalised value."""
        return self.pairs().select("bin1_id", "bin2_id", F.exp("ln_p").alias("value"))

    def normalised(self) -> DataFrame:
        """Every usable pair ``i < j`` with probabilities that sum to one.

        The total comes from the pair mass, so the pairs are formed once.
        """
        total = pair_mass_sums(pair_mass(self.model), self.model).select("z").scalar()
        return self.values().withColumn("value", F.col("value") / total)

    def __getitem__(self, key) -> DataFrame:
        """Unnormalised cells of a 2-d slice, each unordered pair once (``bin1 < bin2``)."""
        if not isinstance(key, tuple) or len(key) != 2:
            raise ValueError("a model matrix takes two indices")
        spans = []
        for part in key:
            if not isinstance(part, slice):
                part = slice(part, part + 1)
            lo, hi, step = part.indices(self.genome.n_bins)
            if step != 1:
                raise ValueError("slices must have step one")
            spans.append((lo, hi))
        rows, cols = spans
        direct = self.pairs(rows, cols).select("bin1_id", "bin2_id", F.exp("ln_p").alias("value"))
        if rows == cols or rows[1] <= cols[0]:
            return direct
        # pairs of the block met only below the diagonal
        seen = F.col("bin1_id").between(rows[0], rows[1] - 1) & F.col("bin2_id").between(cols[0], cols[1] - 1)
        below = self.pairs(cols, rows).where(~seen).select("bin1_id", "bin2_id", F.exp("ln_p").alias("value"))
        return direct.unionByName(below)

    def chromosome(self, number: int, normalise: bool = True) -> DataFrame:
        """Cis block of the ``number``-th chromosome (from 1), scaled so that the
        triangle sums to one.  The sum comes from the pair mass, so the pairs are formed once."""
        if not 1 <= number <= len(self.genome.names):
            raise IndexError("chromosome number out of range")
        lo = self.genome.starts[number - 1]
        hi = lo + self.genome.lengths[number - 1]
        cells = self[lo:hi, lo:hi]
        inside = self.model.states.where((F.col("bin_id") >= lo) & (F.col("bin_id") < hi))
        return _shared(cells, _total(self.model, inside)) if normalise else cells

    def select(self, numbers: int | Sequence[int]) -> "ModelMatrix":
        """Model restricted to chromosomes given by number (from 1)."""
        wanted = [numbers] if isinstance(numbers, int) else list(numbers)
        if any(not 1 <= n <= len(self.genome.names) for n in wanted):
            raise IndexError("chromosome number out of range")
        m = self.model
        states, genome = select_fit(m.states, self.genome, [n - 1 for n in wanted])
        return ModelMatrix(Model(states, genome, m.cis, m.trans, m.alpha, m.beta, m.resolution))


def _shared(cells: DataFrame, total: Column) -> DataFrame:
    return cells.withColumn("value", F.col("value") / zero_to_null(total))


def _by_bin(states: DataFrame, n_states: int) -> DataFrame:
    """State vectors by bin, those of a repeated bin added up."""
    return (states.where("bin_id is not null").groupBy("bin_id")
            .agg(F.array(*[F.sum(F.col("probs")[k]) for k in range(n_states)]).alias("probs")))


def _total(model: Model, states: DataFrame) -> Column:
    """Sum of the model over all pairs of ``states`` in different bins."""
    part = Model(_by_bin(states, model.n_states), model.genome, model.cis, model.trans, model.alpha, model.beta, model.resolution)
    return pair_mass_sums(pair_mass(part), part).select("z").scalar()


def compartment_matrix(states: DataFrame, genome: Genome, cis_weights) -> DataFrame:
    """Compartment term alone for every usable pair, scaled to sum one.

    Over all pairs it is a form in the sums of states and of their products, so the pairs are formed once.
    """
    usable = states.where(F.col("probs").isNotNull()).select("bin_id", "probs")
    cells = (bin_pairs(usable, genome.n_bins)
             .select("bin1_id", "bin2_id", bilinear(F.col("probs1"), cis_weights, F.col("probs2")).alias("value")))
    weights = np.asarray(cis_weights, float)
    if not np.array_equal(weights, weights.T):  # it matters which of two bins comes first
        return cells.withColumn("value", share(cells, "value"))
    p, n = F.col("probs"), range(len(weights))
    twice = sum(F.lit(float(weights[s, t])) * (F.sum(p[s]) * F.sum(p[t]) - F.sum(p[s] * p[t])) for s in n for t in n)
    return _shared(cells, _by_bin(usable, len(weights)).select((twice / 2.0).alias("z")).scalar())


def decay_matrix(bins: DataFrame, genome: Genome, alpha: float, beta: float, resolution: float = 1.0) -> DataFrame:
    """Decay term alone for every usable pair, scaled to sum one.

    The sum is that of a model with a single state, from its pair mass, so the pairs are formed once.
    """
    good = bins.where("weight is not null").select("bin_id")
    b1, b2 = F.col("bin1_id"), F.col("bin2_id")
    term = ln_decay(genome.same_chrom(b1, b2), ln_distance(b1, b2, resolution), alpha, beta)
    cells = bin_pairs(good, genome.n_bins).select("bin1_id", "bin2_id", F.exp(term).alias("value"))
    one = good.withColumn("probs", F.array(F.lit(1.0)))
    return _shared(cells, _total(Model(one, genome, [[1.0]], [[1.0]], alpha, beta, resolution), one))
