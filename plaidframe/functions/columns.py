"""Column expressions: guarded arithmetic and the terms of the compartment model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def int_div(a: Column, b: Column | int) -> Column:
    """Integer quotient in long arithmetic (no detour through doubles)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("int")


def finite(x: Column) -> Column:
    """NaN and infinities become NULL, the only marker for a missing value."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def safe_div(a: Column, b: Column) -> Column:
    """Quotient that is NULL wherever either side is zero or missing."""
    return zero_to_null(a) / zero_to_null(b)


def safe_log(df: DataFrame, column: str, epsilon: float | None = None) -> Column:
    """``ln(x + eps)``; by default eps is a tenth of the smallest non-zero value."""
    if epsilon is None:
        eps = (df.select(F.min(zero_to_null(F.col(column))) / F.lit(10.0))).scalar()
    else:
        eps = F.lit(float(epsilon))
    return F.ln(F.col(column) + eps)


def share(df: DataFrame, column: str) -> Column:
    """``x / sum(x)`` over the whole frame.  The total is a one-row scalar subquery
    (partial sums per task), not a window over a single partition."""
    return F.col(column) / zero_to_null(df.select(F.sum(column)).scalar())


def rounded(x: Column | str, digits: int) -> Column:
    """``round`` of a double, without a decimal number for every row.

    The scaled number is off by less than 2**-12 below 2**40, so its nearest integer is the one that ``round`` finds,
    and a quotient of two exact numbers is the nearest double; what lies near a half, is larger or is no number goes
    through ``round`` itself.
    """
    x = F.col(x) if isinstance(x, str) else x
    scaled = x * F.lit(10.0 ** digits)
    near = F.floor(scaled + F.lit(0.5))
    sure = (F.abs(scaled) < F.lit(2.0 ** 40)) & (F.abs(scaled + F.lit(0.5) - near) > 0.001) & (F.abs(scaled + F.lit(0.5) - near) < 0.999)
    return F.when(sure, near.cast("double") / F.lit(10.0 ** digits)).otherwise(F.round(x, digits))


def share_by(df: DataFrame, column: str, keys: Sequence[str], out: str) -> DataFrame:
    """``x / sum(x)`` within each key, as an aggregate joined back (skew-safe)."""
    totals = df.groupBy(*keys).agg(F.sum(column).alias("__total"))
    return (df.join(totals, list(keys))
            .withColumn(out, F.col(column) / zero_to_null(F.col("__total")))
            .drop("__total"))


def bilinear(p1: Column, weights: np.ndarray, p2: Column) -> Column:
    """``p1 . W . p2`` for array columns, unrolled over the few states so that it
    stays inside whole-stage codegen."""
    total = None
    for s, row in enumerate(np.asarray(weights, dtype=float)):
        inner = None
        for t, w in enumerate(row):
            if w == 0.0:
                continue
            term = F.lit(float(w)) * p2[t]
            inner = term if inner is None else inner + term
        if inner is None:
            continue
        total = p1[s] * inner if total is None else total + p1[s] * inner
    return F.lit(0.0) if total is None else total


def weighted_states(weights: np.ndarray, p: Column) -> list[Column]:
    """Entries of ``W . p``, one column per state."""
    out = []
    for row in np.asarray(weights, dtype=float):
        entry = F.lit(0.0)
        for t, w in enumerate(row):
            if w != 0.0:
                entry = entry + F.lit(float(w)) * p[t]
        out.append(entry)
    return out


def ln_distance(b1: Column, b2: Column, resolution: float | None = None) -> Column:
    base = F.ln(F.abs(b2 - b1).cast("double"))
    return base if resolution is None else base + F.lit(float(np.log(resolution)))


def ln_decay(cis: Column, ln_d: Column, alpha: float, beta: float) -> Column:
    """Power law of the distance within a chromosome, a constant between two."""
    return F.when(cis, F.lit(float(alpha)) * ln_d).otherwise(F.lit(float(beta)))
