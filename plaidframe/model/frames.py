"""The log-likelihood and its gradient as DataFrames.

State vectors stay in a table here, so nothing that grows with the number of bins
reaches the driver.  This is the form for state tables beyond the broadcast limit and
the one checked against SQL; :mod:`objective` is the fused form for smaller ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import weighted_states
from ..functions.numerics import log_sum_exp
from ..session import cut, sized
from .generate import pixel_terms
from .mass import Model, pair_mass, pair_mass_gradient, pair_mass_sums


def _weighted_terms(model: Model, pixels: DataFrame, value: str) -> DataFrame:
    """Pixel terms with ``x`` (the count) and ``m`` (the mass they stand for)."""
    terms = pixel_terms(model, pixels.withColumn("__x", F.col(value).cast("double")))
    times = F.col("times") if "times" in pixels.columns else F.lit(1.0)
    return (terms.withColumn("x", F.col("__x"))
            .withColumn("m", F.exp("ln_p") * times)
            .withColumn("d", F.exp("ln_decay") * times))


def pixel_sums(model: Model, pixels: DataFrame, value: str = "count") -> DataFrame:
    """One row with the pixel sums of the likelihood and of all shared parameters."""
    t = _weighted_terms(model, pixels, value)
    p1, p2, x, g = F.col("probs1"), F.col("probs2"), F.col("x"), F.col("g")
    cis = F.col("cis")
    n = model.n_states

    def within(flag: Column, expr: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, expr)), F.lit(0.0))

    out = [F.sum(F.when(x != 0, x * F.col("ln_p"))).alias("x_ln_p"), F.sum("x").alias("x"),
           F.sum("m").alias("m"),
           within(cis, x * F.col("ln_d")).alias("x_alpha"), within(~cis, x).alias("x_beta"),
           within(cis, F.col("m") * F.col("ln_d")).alias("m_alpha"), within(~cis, F.col("m")).alias("m_beta")]
    for kind, flag in (("cis", cis), ("trans", ~cis)):
        for s in range(n):
            for u in range(n):
                pair = p1[s] * p2[u]
                out.append(within(flag, F.when(x != 0, x / g * pair).otherwise(0.0)).alias(f"x_{kind}_{s}_{u}"))
                out.append(within(flag, F.col("d") * pair).alias(f"m_{kind}_{s}_{u}"))
    return t.agg(*out)


def pixel_gradient(model: Model, pixels: DataFrame, value: str = "count") -> DataFrame:
    """Per bin: ``x`` = sum x/G (W lambda_other), ``m`` = the same with the mass of Z.

    Each pixel contributes to both of its bins; partial sums per bin are formed before
    the shuffle, so a bin in a third of all pixels is no hot key.
    """
    t = _weighted_terms(model, pixels, value)
    cis, n = F.col("cis"), model.n_states
    xg = F.when(F.col("x") != 0, F.col("x") / F.col("g")).otherwise(F.lit(0.0))

    def towards(weights_cis, weights_trans, p: Column) -> Column:
        a, b = weighted_states(weights_cis, p), weighted_states(weights_trans, p)
        return F.array(*[F.when(cis, u).otherwise(v) for u, v in zip(a, b)])

    ends = F.array(
        F.struct(F.col("bin1_id").alias("bin_id"), towards(model.cis, model.trans, F.col("probs2")).alias("w")),
        F.struct(F.col("bin2_id").alias("bin_id"), towards(model.cis.T, model.trans.T, F.col("probs1")).alias("w")))
    both = t.select(xg.alias("xg"), "d", F.explode(ends).alias("e"))
    sums = both.groupBy(F.col("e.bin_id").alias("bin_id")).agg(
        *[F.sum(F.col("xg") * F.col("e.w")[k]).alias(f"x{k}") for k in range(n)],
        *[F.sum(F.col("d") * F.col("e.w")[k]).alias(f"m{k}") for k in range(n)])
    return sums.select("bin_id", F.array(*[F.col(f"x{k}") for k in range(n)]).alias("x"),
                       F.array(*[F.col(f"m{k}") for k in range(n)]).alias("m"))


def dense_log_likelihood(model: Model, pixels: DataFrame, value: str = "count", scale: float = 1.0) -> DataFrame:
    """``sum x ln p - (sum x) ln Z`` with Z over every usable pair; ``scale`` multiplies
    the counts.  All usable pairs must have a value (zero cells are not stored)."""
    scaled = pixels.withColumn("__x", F.col(value).cast("double") * F.lit(float(scale)))
    sums = pixel_terms(model, scaled).agg(
        F.sum(F.when(F.col("__x") != 0, F.col("__x") * F.col("ln_p"))).alias("a"), F.sum("__x").alias("x"))
    z = pair_mass_sums(pair_mass(model), model).select("z").scalar()
    return sums.select((F.col("a") - F.col("x") * F.ln(z)).alias("log_likelihood"), F.ln(z).alias("ln_z"))


def residuals(model: Model, pixels: DataFrame, value: str = "count") -> DataFrame:
    """Derivative of the dense likelihood by ``ln p`` of every stored pixel: its count
    minus the count the model expects, ``x - X p / Z``."""
    terms = pixel_terms(model, pixels.withColumn("__x", F.col(value).cast("double")))
    total = terms.agg(F.sum("__x")).scalar()
    z = pair_mass_sums(pair_mass(model), model).select("z").scalar()
    return terms.select("bin1_id", "bin2_id", (F.col("__x") - total / z * F.exp("ln_p")).alias("residual"))


def with_zeros(pixels: DataFrame, zeros: DataFrame, total: int, sampled: int, value: str = "count") -> DataFrame:
    """Stored pixels and sampled zero cells, each zero standing for ``total/sampled``."""
    stored = pixels.select("bin1_id", "bin2_id", F.col(value).cast("double").alias(value), F.lit(1.0).alias("times"))
    empty = zeros.select("bin1_id", "bin2_id", F.lit(0.0).alias(value), F.lit(total / sampled).alias("times"))
    return stored.unionByName(empty)


def sparse_log_likelihood(model: Model, cells: DataFrame, value: str = "count") -> DataFrame:
    """Likelihood over stored pixels and weighted zeros; ``ln Z`` by stable summation."""
    t = (pixel_terms(model, cells.withColumn("__x", F.col(value).cast("double")))
         .withColumn("ln_m", F.col("ln_p") + F.ln("times")))
    ln_z = log_sum_exp(t.select("ln_m"), "ln_m", out="ln_z").scalar()
    sums = t.agg(F.sum(F.when(F.col("__x") != 0, F.col("__x") * F.col("ln_p"))).alias("a"), F.sum("__x").alias("x"))
    return sums.select((F.col("a") - F.col("x") * ln_z).alias("log_likelihood"), ln_z.alias("ln_z"))


def state_gradient(model: Model, pixels: DataFrame, value: str = "count", dense: bool = True) -> DataFrame:
    """``dLL/d lambda`` per bin, array column ``grad``."""
    parts = pixel_gradient(model, pixels, value)
    n = model.n_states
    sums = _weighted_terms(model, pixels, value).agg(F.sum("x").alias("x"), F.sum("m").alias("m"))
    if dense:
        mass = cut(pair_mass(model))  # read for Z and for the gradient
        z = pair_mass_sums(mass, model).select("z").scalar()
        joined = pair_mass_gradient(mass, model).join(
            sized(parts.select("bin_id", "x"), model.genome.n_bins, 16 * n), "bin_id", "left")
        second = F.col("z")
    else:
        z = sums.select("m").scalar()
        joined, second = parts, F.col("m")
    ratio = sums.select("x").scalar() / z
    first = [F.coalesce(F.col("x")[k], F.lit(0.0)) for k in range(n)]
    return joined.select("bin_id", F.array(*[first[k] - ratio * second[k] for k in range(n)]).alias("grad"))


def shared_gradient(model: Model, pixels: DataFrame, value: str = "count", dense: bool = True) -> DataFrame:
    """``dLL`` by the weights, ``alpha`` and ``beta`` as rows ``(param, s1, s2, grad)``."""
    n = model.n_states
    sums = pixel_sums(model, pixels, value)
    if dense:
        mass = pair_mass_sums(pair_mass(model), model)
        sums = sums.withColumn("__z", mass.select(F.struct("*").alias("__z")).scalar()).select("*", "__z.*")
        prefix = "z"
    else:
        prefix = "m"
    ratio = F.col("x") / F.col(prefix)

    def entry(param: str, s: int, t: int, name: str) -> Column:
        return F.struct(F.lit(param).alias("param"), F.lit(s).alias("s1"), F.lit(t).alias("s2"),
                        (F.col(f"x_{name}") - ratio * F.col(f"{prefix}_{name}")).alias("grad"))

    rows = [entry(kind, s, t, f"{kind}_{s}_{t}") for kind in ("cis", "trans") for s in range(n) for t in range(n)]
    rows += [entry("alpha", 0, 0, "alpha"), entry("beta", 0, 0, "beta")]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
