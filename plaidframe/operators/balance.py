"""Matrix balancing: alternating column/row scaling to unit means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, sized
from .select import attach_ends, mirrored


def balanced_by_coefficients(cells: DataFrame, coefficients: DataFrame, n_bins: int,
                             value: str = "value") -> DataFrame:
    """``value * c_i * c_j`` for a per-bin ``coefficient`` column."""
    return (attach_ends(cells, coefficients, ["coefficient"], n_bins)
            .withColumn(value, F.col(value) * F.col("coefficient1") * F.col("coefficient2"))
            .drop("coefficient1", "coefficient2"))


class Balanced:
    """Scaling vectors of a balanced matrix, ``x_ij * row_i * col_j``, and how they were reached."""

    def __init__(self, factors: DataFrame, passes: int, deviation: float, converged: bool = True):
        self.factors, self.passes, self.deviation, self.converged = factors, passes, deviation, converged


def balancing_factors(cells: DataFrame, n_bins: int, value: str = "value", epsilon: float = 1e-5,
                      max_passes: int = 1000, fixed_passes: int | None = None) -> Balanced:
    """Row and column factors that give all columns mean one.

    A pass divides the columns by their means and turns the matrix over, as in
    alternating scaling.  Only the two factor vectors change, so a pass is one
    aggregation over the (persisted) cells: ``mean_j = col_j * sum_i x_ij row_i / n``.
    The factors stay distributed and are checkpointed after every pass; the driver
    sees one number, the largest deviation.  Bins without any non-zero cell take no
    part.  The loop ends within ``max_passes``; ``fixed_passes`` runs exactly that many.
    """
    full = mirrored(cells.where(F.col(value) != 0)
                    .select("bin1_id", "bin2_id", F.col(value).alias("x"))).persist()
    try:
        active = full.select(F.col("bin1_id").alias("bin_id")).distinct()
        factors = cut(active.withColumn("row", F.lit(1.0)).withColumn("col", F.lit(1.0)))
        n_active = factors.count()
        passes = 0
        while True:
            sums = (full.join(sized(factors.select(F.col("bin_id").alias("bin1_id"), "row"), n_bins, 16), "bin1_id")
                    .groupBy(F.col("bin2_id").alias("bin_id"))
                    .agg((F.sum(F.col("x") * F.col("row")) / F.lit(n_active)).alias("s")))
            scaled = cut(factors.join(sums, "bin_id").withColumn("mean", F.col("s") * F.col("col")))
            deviation = float(scaled.agg(F.max(F.abs(F.col("mean") - 1.0))).first()[0] or 0.0)
            done = deviation <= epsilon if fixed_passes is None else passes >= fixed_passes
            if done or passes >= max_passes:
                return Balanced(factors, passes, deviation, done)
            # divide the columns, then let rows and columns swap roles
            factors = scaled.select("bin_id", (F.col("col") / F.col("mean")).alias("row"),
                                    F.col("row").alias("col"))
            passes += 1
    finally:
        full.unpersist()


def balance(cells: DataFrame, n_bins: int, value: str = "value", out: str = "balanced",
            **options) -> DataFrame:
    """Balanced matrix, both orientations of every cell (converged means differ by at
    most ``epsilon``, so the two may differ in the last digits).

    Zero cells stay unstored, missing cells stay missing (NULL).  Bins without non-zero cells are absent from the result;
    whether they count as zero or as unusable is up to the bin table of the caller.
    """
    result = balancing_factors(cells, n_bins, value, **options)
    if not result.converged:
        print(f"balancing stopped after {result.passes} passes, means still differ by {result.deviation:.3g}")
    # after an odd number of passes the scaled matrix lies transposed
    factors = result.factors
    full = mirrored(cells.where(F.col(value).isNull() | (F.col(value) != 0)).select("bin1_id", "bin2_id", value))
    rows = factors.select(F.col("bin_id").alias("bin1_id"), F.col("row").alias("__r"))
    cols = factors.select(F.col("bin_id").alias("bin2_id"), F.col("col").alias("__c"))
    return (full.join(sized(rows, n_bins, 16), "bin1_id", "left").join(sized(cols, n_bins, 16), "bin2_id", "left")
            .select("bin1_id", "bin2_id", (F.col(value) * F.col("__r") * F.col("__c")).alias(out)))
