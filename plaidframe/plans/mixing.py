"""Mixing experiment: are mixed rows a mix of cells or mixed in every cell?

Single-cell reads of chosen matrix rows are scored against read profiles made from
the bulk matrix, with and without the compartment signal.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import int_div
from ..operators.sampling import simulate_mixture
from ..operators.select import mirrored
from ..session import cut, may_broadcast

EPSILON = 1e-10
MARGIN = 4
READ_THRESHOLD = 5


def row_group(states: DataFrame, condition: Column, factor: int = 1, drop_positions: list[int] | None = None
              ) -> DataFrame:
    """Distinct (re-binned) bins whose state vector meets ``condition``, without the
    ones at the listed positions of the sorted result."""
    rows = states.where(condition).select(int_div(F.col("bin_id"), factor).alias("bin_id")).distinct()
    if not drop_positions:
        return rows
    bad = {r["bin_id"] for k, r in enumerate(
        rows.orderBy("bin_id").limit(max(drop_positions) + 1).collect()) if k in set(drop_positions)}
    return rows.where(~F.col("bin_id").isin(*bad)) if bad else rows


def labelled(groups: dict[str, DataFrame]) -> DataFrame:
    """Row groups as one table ``(bin_id, profile)``."""
    return reduce(DataFrame.unionByName,
                  [frame.select("bin_id", F.lit(name).alias("profile")) for name, frame in groups.items()])


def read_profiles(cells: DataFrame, groups: DataFrame, columns: DataFrame, names: list[str],
                  margin: int = MARGIN, value: str = "value", epsilon: float = EPSILON) -> DataFrame:
    """Read probability of every column for every row group, ``(profile, col, p)``.

    Column sums over the rows of a group outside the diagonal band, normalised,
    smoothed by ``epsilon`` and normalised again; the second total is ``1 + n epsilon``.
    All groups come out of one pass over the cells.
    """
    near = F.abs(F.col("bin1_id") - F.col("bin2_id")) <= margin
    rows = groups.select(F.col("bin_id").alias("bin1_id"), "profile")
    sums = (mirrored(cells.where(~near).select("bin1_id", "bin2_id", value)).join(rows, "bin1_id")
            .join(columns.select(F.col("bin_id").alias("bin2_id")), "bin2_id", "left_semi")
            .groupBy("profile", F.col("bin2_id").alias("col")).agg(F.sum(value).cast("double").alias("s")))
    totals = F.broadcast(sums.groupBy("profile").agg(F.sum("s").alias("total")))  # one row per group
    n = columns.agg(F.count("*")).scalar()
    grid = columns.select(F.col("bin_id").alias("col"),
                          F.explode(F.array(*[F.lit(name) for name in names])).alias("profile"))
    part = F.coalesce(F.col("s") / F.col("total"), F.lit(0.0))
    return (grid.join(sums, ["profile", "col"], "left").join(totals, "profile")
            .select("profile", "col", ((part + F.lit(epsilon)) / (F.lit(1.0) + n * F.lit(epsilon))).alias("p")))


def cell_vectors(cell_pixels: DataFrame, rows: DataFrame, columns: DataFrame, margin: int = MARGIN) -> DataFrame:
    """Reads of every cell per column, over the chosen rows outside the band."""
    b1, b2 = F.col("bin1_id"), F.col("bin2_id")
    chosen = rows.select("bin_id").distinct()
    far = cell_pixels.where(F.abs(b1 - b2) > margin)
    ends = F.array(F.struct(b1.alias("row"), b2.alias("col")), F.struct(b2.alias("row"), b1.alias("col")))
    return (far.select("cell_id", "count", F.explode(ends).alias("e"))
            .select("cell_id", "count", "e.row", "e.col")
            .join(chosen.select(F.col("bin_id").alias("row")), "row", "left_semi")
            .join(columns.select(F.col("bin_id").alias("col")), "col", "left_semi")
            .groupBy("cell_id", "col").agg(F.sum("count").alias("count")))


def read_counts(vectors: DataFrame) -> DataFrame:
    """Reads per cell with the flag for cells that have enough of them."""
    return (vectors.groupBy("cell_id").agg(F.sum("count").alias("reads"))
            .withColumn("enough", F.col("reads") >= READ_THRESHOLD))


def ln_factorial(n: Column) -> Column:
    """``ln(n!)``: exact sum of logarithms for small ``n``, Stirling's series above
    (its error is below 1e-15 relative there)."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0),
                        lambda acc, k: acc + F.ln(k.cast("double")))
    inv = F.lit(1.0) / x
    series = (x * F.ln(x) - x + F.lit(0.5) * F.ln(F.lit(2 * np.pi) * x) + inv / 12.0
              - F.pow(inv, F.lit(3.0)) / 360.0 + F.pow(inv, F.lit(5.0)) / 1260.0)
    return F.when(n <= 1, F.lit(0.0)).when(n < 64, small).otherwise(series)


def profile_scores(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """Multinomial log-likelihood of every cell under every profile.

    Cells and profiles meet on the column; the multinomial coefficient of a cell is
    the same for all profiles and is added afterwards.
    """
    fit = (vectors.join(profiles, "col").groupBy("cell_id", "profile")
           .agg(F.sum(F.col("count") * F.ln("p")).alias("__ln_p")))
    coeff = (vectors.groupBy("cell_id")
             .agg(F.sum("count").alias("__n"), F.sum(ln_factorial(F.col("count"))).alias("__f"))
             .select("cell_id", (ln_factorial(F.col("__n")) - F.col("__f")).alias("__coeff")))
    return (fit.join(coeff, "cell_id")
            .select("cell_id", "profile", (F.col("__ln_p") + F.col("__coeff")).alias("score")))


def log_ratio(scores: DataFrame, populations: list[str], mixed: str) -> DataFrame:
    """Score of the mixed profile minus the best population profile, per cell."""
    best = F.max(F.when(F.col("profile").isin(*populations), F.col("score")))
    own = F.max(F.when(F.col("profile") == mixed, F.col("score")))
    return scores.groupBy("cell_id").agg((own - best).alias("lr"))


def mixed_log_ratio(with_signal: DataFrame, decay_only: DataFrame) -> DataFrame:
    """Difference of the two log ratios per cell."""
    return (with_signal.select("cell_id", F.col("lr").alias("__a"))
            .join(decay_only.select("cell_id", F.col("lr").alias("__b")), "cell_id")
            .select("cell_id", (F.col("__a") - F.col("__b")).alias("mlr")))


def profile_arrays(profiles: DataFrame, names: list[str]) -> tuple[list[int], np.ndarray]:
    """Profiles as rows of an array for the simulator, after a size check (a profile
    has one entry per column of the matrix)."""
    profiles = cut(profiles)
    entries = profiles.count()
    if not may_broadcast(profiles.sparkSession, entries, 16):
        raise ValueError("read profiles exceed the broadcast limit")
    frame = profiles.toPandas().pivot(index="col", columns="profile", values="p").sort_index()
    return frame.index.tolist(), frame[names].to_numpy().T


def simulate(reads: DataFrame, profiles: DataFrame, names: list[str], probs, seed: int = 1) -> DataFrame:
    """Simulated read vectors for cells with the observed numbers of reads."""
    columns, table = profile_arrays(profiles.where(F.col("profile").isin(*names)), names)
    drawn = simulate_mixture(reads, table / table.sum(axis=1, keepdims=True), probs, seed)
    lookup = profiles.sparkSession.createDataFrame(list(enumerate(columns)), "col int, __bin int")
    return drawn.join(F.broadcast(lookup), "col").drop("col").withColumnRenamed("__bin", "col")  # size checked above


def experiment(vectors: DataFrame, reads: DataFrame, profiles: DataFrame, populations: list[str], mixed: str,
               seed: int = 1) -> DataFrame:
    """Log ratios of simulated population mixes, simulated mixed cells and the data."""
    vectors, reads, profiles = cut(vectors), cut(reads), cut(profiles)
    parts = {
        "population": simulate(reads, profiles, populations, 0.5, seed),
        "cell": simulate(reads, profiles, [mixed], 1.0, seed),
        "data": vectors,
    }
    out = [log_ratio(profile_scores(frame.select("cell_id", "col", "count"), profiles), populations, mixed)
           .withColumn("source", F.lit(name)) for name, frame in parts.items()]
    return reduce(DataFrame.unionByName, out)
