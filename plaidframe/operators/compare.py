"""Agreement between two matrices or two fits: correlation, likelihood, state differences."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import average_rank


def paired(a: DataFrame, b: DataFrame, value_a: str, value_b: str) -> DataFrame:
    """Cells ``(bin1_id, bin2_id, a, b)`` where both matrices have a value."""
    left = a.select("bin1_id", "bin2_id", F.col(value_a).cast("double").alias("a"))
    right = b.select("bin1_id", "bin2_id", F.col(value_b).cast("double").alias("b"))
    return left.join(right, ["bin1_id", "bin2_id"]).where(F.col("a").isNotNull() & F.col("b").isNotNull())


def densified(cells: DataFrame, pairs: DataFrame, value: str = "value") -> DataFrame:
    """Long matrix over the cells of ``pairs``: unstored cells become zero."""
    return (pairs.select("bin1_id", "bin2_id")
            .join(cells.select("bin1_id", "bin2_id", F.col(value).cast("double").alias("value")),
                  ["bin1_id", "bin2_id"], "left")
            .withColumn("value", F.coalesce("value", F.lit(0.0))))


def beside(dense: DataFrame, sparse: DataFrame, value: str = "value", count: str = "count") -> DataFrame:
    """Cells ``(bin1_id, bin2_id, a, b)`` of a dense matrix ``b`` with the sparse matrix
    ``a`` next to it, zero where nothing is stored (one join)."""
    stored = sparse.select("bin1_id", "bin2_id", F.col(count).cast("double").alias("a"))
    return (dense.select("bin1_id", "bin2_id", F.col(value).alias("b"))
            .join(stored, ["bin1_id", "bin2_id"], "left")
            .select("bin1_id", "bin2_id", F.coalesce("a", F.lit(0.0)).alias("a"), "b"))


def pearson(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlation of columns ``a`` and ``b``, in one pass."""
    varies = (F.min("a") < F.max("a")) & (F.min("b") < F.max("b"))
    spread = cells.groupBy(*keys).agg(
        varies.alias("__varies"), F.covar_pop("a", "b").alias("__c"),
        F.stddev_pop("a").alias("__sa"), F.stddev_pop("b").alias("__sb"))
    return spread.select(*keys, F.when(F.col("__varies"), F.col("__c") / F.col("__sa") / F.col("__sb"))
                         .alias("pearson"))


def spearman(cells: DataFrame, ranges: int = 64) -> DataFrame:
    """Spearman correlation: Pearson on average ranks.  The cells are written once, as
    both rankings and the final pass read them."""
    cells = cut(cells.select("a", "b"))
    ranked = average_rank(average_rank(cells, "a", "__ra", ranges), "b", "__rb", ranges)
    return (pearson(ranked.select(F.col("__ra").alias("a"), F.col("__rb").alias("b")))
            .withColumnRenamed("pearson", "spearman"))


def sparse_pearson(a: DataFrame, b: DataFrame, n_cells: int | Column, value_a: str, value_b: str) -> DataFrame:
    """Pearson over ``n_cells`` cells of two matrices whose zero cells are not stored.

    The stored cells of both sides meet in one aggregation on the cell; the zeros only
    contribute to the number of cells.
    """
    cells = stacked(a, b, value_a, value_b)
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    sums = cells.agg(*[F.sum(expr).alias(name) for name, expr in {
        "sa": F.col("a"), "sb": F.col("b"), "saa": F.col("a") * F.col("a"),
        "sbb": F.col("b") * F.col("b"), "sab": F.col("a") * F.col("b")}.items()])
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    return sums.select(F.when((va > 0) & (vb > 0), cov / F.sqrt(va) / F.sqrt(vb)).alias("pearson"))


def stacked(a: DataFrame, b: DataFrame, value_a: str, value_b: str) -> DataFrame:
    """Cells stored in either matrix, zero where a side has none (union + aggregate
    instead of a full outer join)."""
    left = a.select("bin1_id", "bin2_id", F.col(value_a).cast("double").alias("a"), F.lit(0.0).alias("b"))
    right = b.select("bin1_id", "bin2_id", F.lit(0.0).alias("a"), F.col(value_b).cast("double").alias("b"))
    return (left.unionByName(right).groupBy("bin1_id", "bin2_id")
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))


def fit_likelihood(cells: DataFrame, keep: Column | None = None) -> DataFrame:
    """``sum(x ln p)`` with data ``a`` and model ``b`` each scaled to sum one.

    The sums run over all cells of each side; the terms over cells where both are
    usable, positive in the model and allowed by ``keep``.  Both totals and the terms
    come out of one aggregation:
    ``sum(a/A * ln(b/B)) = (sum(a ln b) - ln B * sum(a)) / A``.
    """
    usable = F.col("a").isNotNull() & (F.col("b") > 0)
    if keep is not None:
        usable = usable & keep
    sums = cells.agg(F.sum("a").alias("__a"), F.sum("b").alias("__b"),
                     F.sum(F.when(usable, F.col("a") * F.ln("b"))).alias("__t"),
                     F.sum(F.when(usable, F.col("a"))).alias("__u"))
    return sums.select(((F.col("__t") - F.ln("__b") * F.col("__u")) / F.col("__a")).alias("likelihood"))


def likelihood_ratio(cells: DataFrame, model_only: bool = False) -> DataFrame:
    """``exp(L(data, model) - L(data, data))`` over cells where both are non-zero
    (``model_only``: where the model is).  One scan gives both likelihoods."""
    keep = F.col("b") > 0 if model_only else (F.col("a") > 0) & (F.col("b") > 0)
    positive = keep & (F.col("a") > 0)
    sums = cells.agg(
        F.sum("a").alias("__a"), F.sum("b").alias("__b"),
        F.sum(F.when(keep, F.col("a") * F.ln("b"))).alias("__ab"),
        F.sum(F.when(positive, F.col("a") * F.ln("a"))).alias("__aa"),
        F.sum(F.when(keep, F.col("a"))).alias("__u"))
    gap = (F.col("__ab") - F.col("__aa") - (F.ln("__b") - F.ln("__a")) * F.col("__u")) / F.col("__a")
    return sums.select(F.exp(gap).alias("likelihood_ratio"))


def state_difference(a: DataFrame, b: DataFrame, n_states: int) -> DataFrame:
    """Mean absolute difference of state probabilities under the best matching of
    states.  Spark averages every pair of states; the few permutations are compared
    in one expression on the resulting row."""
    both = (a.select("bin_id", F.col("probs").alias("pa"))
            .join(b.select("bin_id", F.col("probs").alias("pb")), "bin_id"))
    means = both.agg(*[F.avg(F.abs(F.col("pa")[s] - F.col("pb")[t])).alias(f"d_{s}_{t}")
                       for s in range(n_states) for t in range(n_states)])
    options = []
    for perm in permutations(range(n_states)):
        total = F.col(f"d_0_{perm[0]}")
        for s in range(1, n_states):
            total = total + F.col(f"d_{s}_{perm[s]}")
        options.append(total / n_states)
    best = F.least(*options) if len(options) > 1 else options[0]
    return means.select(best.alias("state_difference"))


def mean_absolute_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    both = (a.select("bin_id", F.col(column).alias("__a"))
            .join(b.select("bin_id", F.col(column).alias("__b")), "bin_id"))
    return both.agg(F.avg(F.abs(F.col("__a") - F.col("__b"))).alias("mean_difference"))


def parametric_normalised(cells: DataFrame, reference: DataFrame, value: str = "value",
                          raw: str = "value", normalised: str = "normalised") -> DataFrame:
    """Scale by another matrix's ratio of distance-normalised to raw value."""
    ratio = reference.select("bin1_id", "bin2_id",
                             (F.col(normalised) / F.nullif(F.col(raw), F.lit(0.0))).alias("__ratio"))
    return (cells.join(ratio, ["bin1_id", "bin2_id"])
            .withColumn("parametric", F.col(value) * F.col("__ratio")).drop("__ratio"))
