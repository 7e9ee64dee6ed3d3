"""Cleaning operators: diagonal, unusable bins, symmetry, duplicates, marginals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import attach_ends, mirrored


def null_diagonal(cells: DataFrame, column: str = "value") -> DataFrame:
    return cells.withColumn(column, F.when(F.col("bin1_id") != F.col("bin2_id"), F.col(column)))


def symmetrised(cells: DataFrame, column: str = "value") -> DataFrame:
    """Larger of the two orientations of a cell, NULL if either is NULL.

    One aggregation on the unordered pair replaces a self join on swapped ids.
    """
    a, b = F.col("bin1_id"), F.col("bin2_id")
    return (cells.groupBy(F.least(a, b).alias("bin1_id"), F.greatest(a, b).alias("bin2_id"))
            .agg(F.when(F.count(column) == F.count("*"), F.max(column)).alias(column)))


def preprocessed(cells: DataFrame, column: str = "value") -> DataFrame:
    return null_diagonal(symmetrised(cells, column), column)


def bins_with_values(cells: DataFrame, column: str = "value") -> DataFrame:
    """Bins with at least one non-NULL cell in their row."""
    return (mirrored(cells.select("bin1_id", "bin2_id", column))
            .groupBy(F.col("bin1_id").alias("bin_id"))
            .agg(F.count(column).alias("__n")).where("__n > 0").select("bin_id"))


def drop_unusable_bins(cells: DataFrame, n_bins: int, column: str = "value") -> DataFrame:
    return attach_ends(cells, bins_with_values(cells, column), [], n_bins)


def deduplicated(pixels: DataFrame, mode: str, value: str = "count", order: str | None = None) -> DataFrame:
    """Resolve repeated pixels: ``keep`` all, ``fix`` by summing, ``ignore`` all but
    the first by ``order``, ``remove`` every repeated one."""
    keys = ["bin1_id", "bin2_id"]
    if mode == "keep":
        return pixels.select(*keys, value)
    grouped = pixels.groupBy(*keys)
    if mode == "fix":
        return grouped.agg(F.sum(value).alias(value))
    if mode == "remove":
        return (grouped.agg(F.count("*").alias("__n"), F.first(value).alias(value))
                .where("__n = 1").drop("__n"))
    if mode == "ignore":
        if order is None:
            raise ValueError("mode 'ignore' needs an order column to define the first pixel")
        return grouped.agg(F.min_by(value, order).alias(value))
    raise ValueError(f"unknown duplicate mode {mode!r}")


def merged_by_diagonal(a: DataFrame, b: DataFrame, column: str = "value") -> DataFrame:
    """Lower half of ``a`` and upper half of ``b``; both hold each unordered cell once."""
    upper = b.where("bin1_id < bin2_id").select("bin1_id", "bin2_id", column)
    lower = (a.where("bin1_id < bin2_id")
             .select(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"), column))
    return lower.unionByName(upper)


def row_totals(pixels: DataFrame, value: str = "count") -> DataFrame:
    """Sum of every matrix row (each off-diagonal pixel counts for both ends)."""
    return (mirrored(pixels.select("bin1_id", "bin2_id", value))
            .groupBy(F.col("bin1_id").alias("bin_id")).agg(F.sum(value).alias("total")))


def marginal_filter(pixels: DataFrame, n_bins: int, cutoff: float = 10, value: str = "count") -> DataFrame:
    """NULL the cells of rows whose total is below ``cutoff``."""
    weak = row_totals(pixels, value).select("bin_id", (F.col("total") >= cutoff).alias("strong"))
    return (attach_ends(pixels, weak, ["strong"], n_bins)
            .withColumn(value, F.when(F.col("strong1") & F.col("strong2"), F.col(value)))
            .drop("strong1", "strong2"))


def rows_without_band(cells: DataFrame, rows: DataFrame, margin: int, column: str = "value") -> DataFrame:
    """Chosen matrix rows (all columns) with a band of ``margin`` cells around the
    diagonal set to zero."""
    near = F.abs(F.col("bin1_id") - F.col("bin2_id")) <= margin
    chosen = rows.select(F.col("bin_id").alias("bin1_id")).distinct()
    return (mirrored(cells).join(chosen, "bin1_id", "left_semi")
            .withColumn(column, F.when(near, F.lit(0).cast(cells.schema[column].dataType))
                        .otherwise(F.col(column))))


def expanded(values: DataFrame, bins: DataFrame, column: str) -> DataFrame:
    """One row per bin of the full index, NULL where ``values`` has none."""
    return bins.select("bin_id").join(values.select("bin_id", column), "bin_id", "left")
