"""Regularisers of the state probabilities: value with gradient, and as Spark aggregates.

``N`` (usable bins) scales every term, because the likelihood grows with the number
of pairs.  Differences run over consecutive usable bins, across chromosome borders.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import previous


def l1diff(states: np.ndarray) -> tuple[float, np.ndarray]:
    n = len(states)
    step = np.diff(states, axis=0)
    grad = np.zeros_like(states)
    grad[1:] += np.sign(step)
    grad[:-1] -= np.sign(step)
    return n * float(np.abs(step).sum()), n * grad


def l2diff(states: np.ndarray) -> tuple[float, np.ndarray]:
    """Largest singular value of the matrix of differences."""
    n = len(states)
    u, s, vt = np.linalg.svd(np.diff(states, axis=0), full_matrices=False)
    outer = np.outer(u[:, 0], vt[0])
    grad = np.zeros_like(states)
    grad[1:] += outer
    grad[:-1] -= outer
    return n * float(s[0]), n * grad


def nonuniform(states: np.ndarray) -> tuple[float, np.ndarray]:
    n = len(states)
    return -n * float(np.abs(states - 0.5).sum()), -n * np.sign(states - 0.5)


def none(states: np.ndarray) -> tuple[float, np.ndarray]:
    return 0.0, np.zeros_like(states)


REGULARISERS = {"l1diff": l1diff, "l2diff": l2diff, "nonuniform": nonuniform}


def resolve(name):
    if name is None:
        return none
    if callable(name):
        return name
    if name not in REGULARISERS:
        raise ValueError(f"unknown regularisation {name!r}")
    return REGULARISERS[name]


def _differences(states: DataFrame, n_states: int) -> DataFrame:
    used = states.where(F.col("probs").isNotNull()).select("bin_id", "probs")
    stepped = previous(used, "probs", "bin_id", "__prev")
    return stepped.select(*[(F.col("probs")[s] - F.col("__prev")[s]).alias(f"d{s}")
                            for s in range(n_states)])


def terms(states: DataFrame, n_states: int) -> DataFrame:
    """``l1diff`` and ``nonuniform`` of a distributed state table."""
    n = states.where(F.col("probs").isNotNull()).agg(F.count("*").cast("double")).scalar()
    steps = _differences(states, n_states)
    l1 = steps.agg(F.sum(sum((F.abs(F.col(f"d{s}")) for s in range(n_states)), F.lit(0.0)))).scalar()
    away = states.agg(F.sum(F.aggregate("probs", F.lit(0.0), lambda a, p: a + F.abs(p - 0.5)))).scalar()
    one = states.sparkSession.range(1)
    return one.select((n * l1).alias("l1diff"), (-n * away).alias("nonuniform"))


def gram(states: DataFrame, n_states: int) -> DataFrame:
    """Entries of ``D'D`` for the differences ``D``; its largest eigenvalue is the
    squared spectral norm."""
    steps = _differences(states, n_states)
    sums = steps.agg(*[F.sum(F.col(f"d{s}") * F.col(f"d{t}")).alias(f"g_{s}_{t}")
                       for s in range(n_states) for t in range(n_states)])
    entries = [F.struct(F.lit(s).alias("s1"), F.lit(t).alias("s2"), F.col(f"g_{s}_{t}").alias("g"))
               for s in range(n_states) for t in range(n_states)]
    return sums.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def l2diff_frame(states: DataFrame, n_states: int) -> float:
    n = states.where(F.col("probs").isNotNull()).count()
    matrix = np.zeros((n_states, n_states))
    for row in gram(states, n_states).collect():  # states squared rows
        matrix[row["s1"], row["s2"]] = row["g"]
    return n * float(np.sqrt(np.linalg.eigvalsh(matrix)[-1]))
