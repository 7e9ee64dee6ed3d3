"""Choosing among scored fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_fits(fits: DataFrame, n: int = 1, score: str = "optimize_value", order: str = "fit_id") -> DataFrame:
    """The ``n`` lowest scores, ties by ``order``, with their rank from 1."""
    best = fits.where(F.col(score).isNotNull()).orderBy(score, order).limit(n)
    lowest = F.array_sort(F.collect_list(F.struct(score, order)))
    ranked = best.agg(lowest.alias("l")).select(F.posexplode("l").alias("rank", "f"))  # n rows
    return ranked.select((F.col("rank") + 1).alias("rank"), f"f.{order}", f"f.{score}")


def best_fit(fits: DataFrame, score: str = "optimize_value", order: str = "fit_id") -> DataFrame:
    """The lowest score; the first one on ties."""
    lowest = F.min(F.struct(score, order))
    return fits.where(F.col(score).isNotNull()).agg(lowest.alias("f")).select(f"f.{order}", f"f.{score}")
