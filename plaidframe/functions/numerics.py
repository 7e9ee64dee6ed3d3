"""Stable and exact aggregates built from mergeable partial sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 32  # bits of a limb of an exact sum


def log_sum_exp(df: DataFrame, column: str, keys: Sequence[str] = (), out: str = "lse") -> DataFrame:
    """One-pass ``ln(sum(exp(x)))``, per key or over the whole frame.

    Values are first summed per integer part (map-side combined, every partial sum
    lies in [1, e) per row), which leaves one row per distinct integer part; those
    few rows are then rescaled by the largest one.
    """
    level = F.floor(F.col(column))
    parts = (df.where(F.col(column).isNotNull())
             .groupBy(*keys, level.alias("__level"))
             .agg(F.sum(F.exp(F.col(column) - level)).alias("__mass")))
    merged = parts.groupBy(*keys).agg(
        F.max("__level").alias("__top"),
        F.collect_list(F.struct("__level", "__mass")).alias("__parts"))
    scaled = F.aggregate(
        "__parts", F.lit(0.0),
        lambda acc, p: acc + p["__mass"] * F.exp((p["__level"] - F.col("__top")).cast("double")))
    return merged.select(*keys, (F.ln(scaled) + F.col("__top")).alias(out))


def exact_sum(x: Column, scale: int = 18) -> Column:
    """Order-independent sum with ``scale`` decimal digits (compensated-sum analogue)."""
    return F.sum(x.cast(f"decimal(28,{scale})"))


def limb_sums(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact sum of doubles as integers on a fixed grid, ``(*keys, limb, total)``.

    Limb ``k`` counts units of ``2 ** (LIMB k)``.  A double is cut into whole numbers of at
    most four neighbouring limbs, largest first, which is exact and has one outcome; the
    numbers are added up by a plain sum, so neither order nor partitioning matters.  NULL, NaN
    and infinite values take no part.
    """
    x = F.col(column).cast("double")
    finite = df.select(*keys, x.alias("__x")).where((F.col("__x") != 0) & ~F.isnan("__x") & (F.abs("__x") < float("inf")))
    top = (F.floor(F.log2(F.abs("__x")) / LIMB) + 1).cast("int")  # none of the digits lies above it
    half = F.lit(2.0)

    def unit(k: Column, sign: int) -> Column:  # in two factors, as the whole may be beyond a double
        return F.pow(half, k * (sign * LIMB // 2))

    def cut_off(state: Column, step: Column) -> Column:
        k = state["k"]
        whole = state["rest"] * unit(k, -1) * unit(k, -1)
        whole = F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast("double")
        return F.struct((k - 1).alias("k"), (state["rest"] - whole * unit(k, 1) * unit(k, 1)).alias("rest"),
                        F.concat(state["limbs"], F.array(F.struct(k.alias("limb"), whole.cast("long").alias("q")))).alias("limbs"))

    start = F.struct(top.alias("k"), F.col("__x").alias("rest"), F.array().cast("array<struct<limb:int,q:long>>").alias("limbs"))
    limbs = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, cut_off, lambda state: state["limbs"])
    return (finite.select(*keys, F.explode(limbs).alias("__l")).where("__l.q <> 0")
            .groupBy(*keys, F.col("__l.limb").alias("limb"))
            .agg(F.sum(F.col("__l.q").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total")))


def float_sum(df: DataFrame, column: str) -> float:
    """Correctly rounded sum of doubles, from at most 70 limbs; NaN if a value is not finite."""
    x = F.col(column).cast("double")
    if df.where(F.isnan(x) | (F.abs(x) == float("inf"))).limit(1).count():
        return math.nan
    total = sum((Fraction(int(r.total)) * Fraction(2) ** (LIMB * r.limb) for r in limb_sums(df, column).collect()), Fraction(0))
    return float(total)
