"""Named queries: every operator of the library run over the derived tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import int_div, rounded, safe_div, safe_log, share, share_by
from ..functions.numerics import exact_sum, limb_sums, log_sum_exp
from ..genome import Genome
from ..model import frames, generate, moments, ranks, regularise
from ..model.fit import fit_decay, fit_dense, fit_sparse
from ..model.mass import Model
from ..model.params import state_order
from ..operators import balance, clean, compare, distance, ordered, pairs, reshape, sampling, select, splitting, zeros
from ..sources.registry import best_fit, top_fits
from ..session import cut
from . import accuracy, mixing, pca
from .contact_data import ALPHA, BETA, CIS_WEIGHTS, N_STATES, RESOLUTION, TRANS_WEIGHTS, ContactData

# Fixed values of the catalogued runs.
COARSEN_BY, STRETCH_BY, MARGINAL_CUTOFF = 3, 2, 230
ZERO_SAMPLE, ZERO_SEED = 1000, 7
THIN_TO, THIN_SEED = 0.3, 3
BALANCE_PASSES = 3
REPLICATES, RATES = 2, (0.1, 0.3, 0.6)
FIT_OPTIONS = {"ftol": 1e-6}  # fits end by their stopping rule

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[ContactData], DataFrame]) -> Callable[[ContactData], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ContactData(spark, sf_dir))
    return fn


def r(x: Column | str, digits: int) -> Column:
    return F.round(x, digits)


def balanced_cells(d: ContactData) -> DataFrame:
    """Balanced values between usable bins, as ``value``."""
    return (select.balanced(d.pixels(), d.bins(), d.n_bins).where("balanced is not null")
            .select("bin1_id", "bin2_id", F.col("balanced").alias("value")))


def usable(d: ContactData) -> DataFrame:
    return d.bins().where("weight is not null").select("bin_id")


def nullable_cells(d: ContactData) -> DataFrame:
    """Counts that are NULL where a bin is unusable."""
    return (select.attach_ends(d.pixels(), d.bins(), ["weight"], d.n_bins)
            .select("bin1_id", "bin2_id", F.when(F.col("weight1").isNotNull() & F.col("weight2").isNotNull(),
                                                 F.col("count")).alias("value")))


def oriented_cells(d: ContactData) -> DataFrame:
    """A matrix whose two orientations differ (row = part bin, column = order bin)."""
    width, n, _, orders = d.sizes
    raw = (d.table("lineitem")
           .groupBy(int_div(F.col("l_partkey"), width).alias("bin1_id"),
                    int_div(F.col("l_orderkey") * F.lit(n), orders).alias("bin2_id"))
           .agg(F.count("*").alias("count")))
    return (select.attach_ends(raw, d.bins(), ["weight"], d.n_bins)
            .select("bin1_id", "bin2_id", F.when(F.col("weight1").isNotNull() & F.col("weight2").isNotNull(),
                                                 F.col("count")).alias("value")))


def model(d: ContactData, resolution: float | None = None) -> Model:
    return Model(cut(d.states()), d.genome, CIS_WEIGHTS, TRANS_WEIGHTS, ALPHA, BETA, resolution)


def cut_model(d: ContactData) -> Model:
    return model(d, RESOLUTION)


def matrix(d: ContactData, resolution: float | None = RESOLUTION) -> generate.ModelMatrix:
    return generate.ModelMatrix(model(d, resolution))


def rounded_states(states: DataFrame, digits: int = 9) -> DataFrame:
    return states.select("bin_id", *[r(F.col("probs")[k], digits).alias(f"p{k}") for k in range(N_STATES)])


# --- reading and selection -------------------------------------------------------

@query
def chrom_lengths(d):
    return select.chrom_lengths(select.extents(d.bins()), "all")


@query
def chrom_lengths_all_no_ym(d):
    return select.chrom_lengths(select.extents(d.bins()), "all_no_ym")


@query
def first_excluded_bin(d):
    return select.first_ym_bin(select.extents(d.bins()))


@query
def usable_bins_by_chrom(d):
    return select.usable_bins(d.bins(), "all")


@query
def balancing_coefficients_one_chrom(d):
    return d.bins().where("chrom = 'chr2'").select("bin_id", r("weight", 9).alias("weight"))


@query
def prefix_square_read(d):
    return select.select_chroms(d.pixels(), d.genome, "all_no_ym")


@query
def cis_block_balanced(d):
    lo, hi = d.genome.extent("chr2")
    cells = select.block(d.pixels(), (lo, hi), (lo, hi))
    out = select.balanced(cells, d.bins(), d.n_bins)
    return out.select("bin1_id", "bin2_id", "count", r("balanced", 9).alias("balanced"))


@query
def balanced_pixels(d):
    out = select.balanced(d.pixels(), d.bins(), d.n_bins)
    return out.select("bin1_id", "bin2_id", "count", r("balanced", 9).alias("balanced"))


@query
def multi_chrom_rebased(d):
    return select.select_chroms(d.pixels(), d.genome, "chr1", "chrX")


@query
def reordered_chroms_rebased(d):
    return select.select_chroms(d.pixels(), d.genome, "chrX", "chr1")


@query
def trans_only_pixels(d):
    return select.select_chroms(d.pixels(), d.genome, "chr1", "chr2", "chrX", trans_only=True)


@query
def selected_bins_rebased(d):
    return select.select_bins(d.bins(), d.genome, "chrX", "chr1").select("bin_id", "chrom_idx", "chrom")


# --- cleaning --------------------------------------------------------------------

@query
def dedup_sum(d):
    return clean.deduplicated(d.replicate_pixels(), "fix")


@query
def dedup_remove(d):
    return clean.deduplicated(d.replicate_pixels(), "remove")


@query
def dedup_first(d):
    return clean.deduplicated(d.replicate_pixels(), "ignore", order="replicate")


@query
def null_diagonal(d):
    return clean.null_diagonal(d.pixels(), "count")


@query
def symmetrise_max_no_diag(d):
    return clean.preprocessed(oriented_cells(d))


@query
def remove_unusable_bins(d):
    return clean.drop_unusable_bins(nullable_cells(d), d.n_bins)


@query
def mirror_full(d):
    return select.mirrored(d.pixels())


@query
def triangle_without_diagonal(d):
    return select.triangle(d.pixels(), -1)


@query
def merge_by_diagonal(d):
    cells = d.half_pixels().withColumnRenamed("count", "value")
    return clean.merged_by_diagonal(cells.where("replicate = 1"), cells.where("replicate = 2"))


@query
def zeros_to_null(d):
    return d.replicate_pixels().select(
        "bin1_id", "bin2_id", "replicate", F.nullif(F.col("count") - 1, F.lit(0)).alias("extra"))


@query
def marginal_filter(d):
    return clean.marginal_filter(d.pixels(), d.n_bins, MARGINAL_CUTOFF)


@query
def row_totals(d):
    return clean.row_totals(d.pixels())


@query
def expand_by_mask(d):
    return rounded_states(clean.expanded(d.states(), d.bins(), "probs"))


@query
def expand_matrix_by_mask(d):
    full = pairs.pairs_beside(d.bins(), d.n_bins, balanced_cells(d), "value")
    return full.select("bin1_id", "bin2_id", rounded("value", 9).alias("value"))


# --- reshaping -------------------------------------------------------------------

@query
def coarsen(d):
    return reshape.coarsened(d.pixels(), d.genome, COARSEN_BY)


@query
def chr_select_fit(d):
    states, _ = reshape.select_fit(d.states(), d.genome, [2, 0, 2])
    return rounded_states(states)


def fine_layout(d: ContactData) -> tuple[Genome, DataFrame]:
    """A finer genome (one bin short per chromosome) and its usable bins."""
    width = d.sizes[0]
    target = Genome(d.genome.names, tuple(STRETCH_BY * n - 1 for n in d.genome.lengths), RESOLUTION // STRETCH_BY)
    coarse = int_div(F.col("p_partkey"), width)
    lo = d.genome.start_of(coarse)
    offset = int_div(F.col("p_partkey") * F.lit(STRETCH_BY), width) - lo * STRETCH_BY
    fine = (d.table("part").select("p_size", coarse.alias("coarse"), offset.alias("offset"))
            .where(F.col("offset") < d.genome.per_chrom(F.col("coarse"), list(target.lengths)))
            .groupBy((F.col("offset") + d.genome.per_chrom(F.col("coarse"), list(target.starts))).cast("int")
                     .alias("bin_id"))
            .agg(F.max("p_size").alias("top")).where("top >= 8").select("bin_id"))
    return target, fine


@query
def stretch_fit_ffill(d):
    target, fine = fine_layout(d)
    states, _ = reshape.stretched(d.states(), d.genome, STRETCH_BY, target, fine, N_STATES)
    return rounded_states(states)


@query
def stretch_fit_plain(d):
    states, _ = reshape.stretched(d.all_states(), d.genome, STRETCH_BY)
    return rounded_states(states)


@query
def state_sort(d):
    return rounded_states(reshape.reordered(d.states(), [int(k) for k in state_order(CIS_WEIGHTS)]))


@query
def rebin_ids(d):
    return d.bins().where("weight is not null").select(int_div(F.col("bin_id"), 5).alias("bin_id")).distinct()


# --- normalisation ---------------------------------------------------------------

@query
def distance_normalised(d):
    out = distance.distance_normalised(balanced_cells(d), usable(d), d.n_bins)
    return out.select("bin1_id", "bin2_id", r("value", 9).alias("balanced"), r("normalised", 12).alias("normalised"))


@query
def usable_pairs_by_distance(d):
    return distance.usable_pairs_by_distance(usable(d), d.n_bins)


@query
def decay_only_matrix(d):
    out = distance.distance_normalised(balanced_cells(d), usable(d), d.n_bins)
    return distance.decay_only(out).select("bin1_id", "bin2_id", r("decay", 3).alias("decay"))


@query
def normalise_l1_triangle(d):
    cells = select.triangle(balanced_cells(d))
    return cells.select("bin1_id", "bin2_id", r(share(cells, "value"), 12).alias("value"))


@query
def normalise_rows(d):
    out = share_by(select.mirrored(balanced_cells(d)), "value", ["bin1_id"], "share")
    return out.select("bin1_id", "bin2_id", r("share", 9).alias("share"))


@query
def safe_log_counts(d):
    cells = balanced_cells(d)
    return cells.select("bin1_id", "bin2_id", r(safe_log(cells, "value"), 9).alias("ln_value"))


@query
def safe_divide(d):
    cells = d.half_pixels()
    parts = cells.groupBy("bin1_id", "bin2_id").agg(
        F.sum(F.when(F.col("replicate") == 1, F.col("count")).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("replicate") == 2, F.col("count")).otherwise(0)).cast("double").alias("b"))
    return parts.select("bin1_id", "bin2_id", r(safe_div(F.col("a"), F.col("b")), 9).alias("ratio"))


@query
def balance_k_passes(d):
    cells = d.pixels().select("bin1_id", "bin2_id", F.col("count").cast("double").alias("value"))
    out = balance.balance(cells, d.n_bins, fixed_passes=BALANCE_PASSES)
    return out.select("bin1_id", "bin2_id", r("balanced", 6).alias("balanced"))


@query
def balance_converged(d):
    """Row means of the balanced matrix; all are one within the tolerance."""
    cells = d.pixels().select("bin1_id", "bin2_id", F.col("count").cast("double").alias("value"))
    out = balance.balance(cells, d.n_bins, epsilon=1e-5)
    n = out.agg(F.countDistinct("bin1_id").cast("double")).scalar()
    return (out.groupBy(F.col("bin1_id").alias("bin_id"))
            .agg(F.sum("balanced").alias("total"))
            .select("bin_id", r(F.col("total") / n, 3).alias("mean")))


@query
def balance_by_coefficients(d):
    cells = d.pixels().select("bin1_id", "bin2_id", F.col("count").cast("double").alias("value"))
    out = balance.balanced_by_coefficients(cells, d.bins().withColumnRenamed("weight", "coefficient"), d.n_bins)
    return out.select("bin1_id", "bin2_id", r("value", 9).alias("value"))


# --- model terms -----------------------------------------------------------------

@query
def model_terms(d):
    t = generate.pixel_terms(model(d, RESOLUTION), d.pixels())
    return t.select("bin1_id", "bin2_id", "cis", r("g", 9).alias("compartment"), r("ln_decay", 9).alias("ln_decay"),
                    r("ln_p", 9).alias("ln_p"))


@query
def generate_matrix(d):
    return matrix(d).normalised().select("bin1_id", "bin2_id", rounded("value", 13).alias("value"))


@query
def generate_slice(d):
    n = d.n_bins
    return (matrix(d, None)[n // 5: n // 2, n // 3: n]
            .select("bin1_id", "bin2_id", rounded("value", 12).alias("value")))


@query
def generate_chromosome(d):
    return matrix(d, None).chromosome(2).select("bin1_id", "bin2_id", rounded("value", 12).alias("value"))


@query
def generate_selected_chromosomes(d):
    return (matrix(d, None).select([3, 1])[:, :]
            .select("bin1_id", "bin2_id", rounded("value", 12).alias("value")))


@query
def compartment_only_matrix(d):
    return (generate.compartment_matrix(d.states(), d.genome, CIS_WEIGHTS)
            .select("bin1_id", "bin2_id", rounded("value", 12).alias("value")))


@query
def decay_only_model(d):
    return (generate.decay_matrix(d.bins(), d.genome, ALPHA, BETA, RESOLUTION)
            .select("bin1_id", "bin2_id", rounded("value", 12).alias("value")))


@query
def logsumexp_by_area(d):
    t = generate.pixel_terms(model(d), d.pixels())
    return log_sum_exp(t, "ln_p", ["cis"]).select("cis", r("lse", 9).alias("lse"))


@query
def exact_decimal_sum(d):
    return d.table("lineitem").groupBy("l_returnflag").agg(
        exact_sum(F.col("l_extendedprice"), 6).cast("double").alias("total"))


@query
def exact_float_limbs(d):
    """Exact sums of a computed double, as integers by limb."""
    priced = d.table("lineitem").select("l_returnflag", (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
                                                         / F.col("l_quantity")).cast("double").alias("x"))
    return limb_sums(priced, "x", ["l_returnflag"]).withColumn("total", F.col("total").cast("double"))


# --- zero cells ------------------------------------------------------------------

@query
def zero_counts_both(d):
    return zeros.zero_counts(d.pixels(), d.bins(), d.genome, "both")


@query
def zero_counts_trans(d):
    return zeros.zero_counts(d.pixels(), d.bins(), d.genome, "trans")


@query
def zero_candidates_both(d):
    return zeros.zero_candidates(d.pixels(), d.bins(), d.genome, "both")


@query
def zero_candidates_trans(d):
    return zeros.zero_candidates(d.pixels(), d.bins(), d.genome, "trans")


@query
def zero_sample_keyed(d):
    return zeros.sample_zeros(d.pixels(), d.bins(), d.genome, ZERO_SAMPLE, ZERO_SEED)


@query
def zero_sample_drawn(d):
    """Zeros between chromosomes."""
    return zeros.sample_zeros(d.pixels(), d.bins(), d.genome, ZERO_SAMPLE, ZERO_SEED + 1, "trans")


# --- likelihood ------------------------------------------------------------------

@query
def dense_log_likelihood(d):
    out = frames.dense_log_likelihood(model(d, RESOLUTION), d.pixels())
    return out.select(r("log_likelihood", 3).alias("log_likelihood"), r("ln_z", 9).alias("ln_z"))


@query
def dense_gradient_states(d):
    g = frames.state_gradient(model(d, RESOLUTION), d.pixels())
    return g.select("bin_id", *[r(F.col("grad")[k], 5).alias(f"g{k}") for k in range(N_STATES)])


@query
def dense_gradient_shared(d):
    g = frames.shared_gradient(model(d, RESOLUTION), d.pixels())
    return g.select("param", "s1", "s2", r("grad", 3).alias("grad"))


def weighted_cells(d: ContactData) -> DataFrame:
    """Stored pixels plus the keyed sample of zeros with their multiplicity."""
    pixels, bins = cut(d.pixels()), cut(d.bins())
    total = zeros.total_zeros(pixels, bins, d.genome)
    sample = cut(zeros.sample_zeros(pixels, bins, d.genome, ZERO_SAMPLE, ZERO_SEED, total=total))
    return frames.with_zeros(pixels, sample, total, min(ZERO_SAMPLE, total))


@query
def sparse_log_likelihood(d):
    out = frames.sparse_log_likelihood(model(d), weighted_cells(d))
    return out.select(r("log_likelihood", 3).alias("log_likelihood"), r("ln_z", 9).alias("ln_z"))


@query
def sparse_gradient_states(d):
    g = frames.state_gradient(model(d), weighted_cells(d), dense=False)
    return g.select("bin_id", *[r(F.col("grad")[k], 5).alias(f"g{k}") for k in range(N_STATES)])


@query
def sparse_gradient_shared(d):
    g = frames.shared_gradient(model(d), weighted_cells(d), dense=False)
    return g.select("param", "s1", "s2", r("grad", 3).alias("grad"))


@query
def regulariser_terms(d):
    return regularise.terms(d.states(), N_STATES).select(
        r("l1diff", 3).alias("l1diff"), r("nonuniform", 3).alias("nonuniform"))


@query
def difference_gram(d):
    return regularise.gram(d.states(), N_STATES).select("s1", "s2", r("g", 7).alias("g"))


@query
def likelihood_residuals(d):
    out = frames.residuals(model(d, RESOLUTION), d.pixels())
    return out.select("bin1_id", "bin2_id", r("residual", 8).alias("residual"))


@query
def compact_index(d):
    return ordered.compact_index(d.bins())


# --- sampling --------------------------------------------------------------------

@query
def downsample_keyed(d):
    return sampling.downsampled(d.pixels(), THIN_TO, THIN_SEED)


@query
def resample_inverse_cdf(d):
    total = int(d.pixels().agg(F.sum("count")).first()[0])
    return sampling.multinomial_keyed(matrix(d), total, seed=THIN_SEED)


@query
def resample_multinomial(d):
    total = int(d.pixels().agg(F.sum("count")).first()[0])
    return sampling.multinomial(matrix(d).values(), total, seed=THIN_SEED)


@query
def read_totals_ratio(d):
    return (sampling.read_total(d.pixels(), d.bins(), d.n_bins, THIN_TO)
            .select("total", r("reads", 6).alias("reads")))


# --- comparison ------------------------------------------------------------------

@query
def pearson_data_model(d):
    sums = moments.moments(model(d, RESOLUTION), d.pixels())
    return sums.select(r(moments.pearson(), 9).alias("pearson"))


@query
def spearman_data_model(d):
    return ranks.spearman(model(d, RESOLUTION), d.pixels()).select(r("spearman", 9).alias("spearman"))


@query
def pearson_replicates(d):
    """Two halves of the replicates over all cells of the triangle without listing the zero cells."""
    good = select.between_usable(d.half_pixels().where("bin1_id < bin2_id"), d.bins(), d.n_bins)
    n = usable(d).agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).scalar()
    out = compare.sparse_pearson(good.where("replicate = 1"), good.where("replicate = 2"), n, "count", "count")
    return out.select(r("pearson", 9).alias("pearson"))


@query
def fit_likelihood(d):
    sums = moments.moments(model(d, RESOLUTION), d.pixels())
    return sums.select(r(moments.fit_likelihood(), 9).alias("likelihood"))


@query
def likelihood_ratio(d):
    sums = moments.moments(model(d, RESOLUTION), d.pixels())
    return sums.select(r(moments.likelihood_ratio(), 9).alias("likelihood_ratio"))


@query
def likelihood_ratio_single_cell(d):
    sums = moments.moments(model(d, RESOLUTION), d.pixels())
    return sums.select(r(moments.likelihood_ratio(), 9).alias("likelihood_ratio"))


@query
def lambda_diff_min_permutation(d):
    turned = reshape.stretched(d.states(), d.genome, 1)[0].select(
        "bin_id", F.array(F.col("probs")[2], (F.col("probs")[0] + F.col("probs")[1]) * 0.75,
                          (F.col("probs")[0] + F.col("probs")[1]) * 0.25).alias("probs"))
    return (compare.state_difference(d.states(), turned, N_STATES)
            .select(r("state_difference", 9).alias("state_difference")))


@query
def parametric_normalisation(d):
    out = moments.parametric_normalised(model(d, RESOLUTION), d.pixels())
    return out.select("bin1_id", "bin2_id", r("parametric", 6).alias("parametric"))


@query
def accuracy_table(d):
    """All matrix metrics per chromosome-independent case, as a long table."""
    table = accuracy.long_table(accuracy.compare_with_model(model(d, RESOLUTION), d.pixels()), case="data")
    return table.select("case", "metric", r("value", 7).alias("value"))


@query
def accuracy_per_chromosome(d):
    sums = moments.moments(model(d, RESOLUTION), d.pixels(), by_chrom=True)
    return sums.select(F.col("scope").alias("chrom_idx"), r(moments.pearson(), 9).alias("pearson"))


@query
def accuracy_of_thinned_data(d):
    """Agreement of the model with a thinned sample of the reads."""
    thin = sampling.downsampled(d.pixels(), THIN_TO, THIN_SEED)
    sums = cut(moments.moments(model(d, RESOLUTION), thin))
    metrics = {"pearson": sums.select(moments.pearson()), "lr": sums.select(moments.likelihood_ratio())}
    table = accuracy.long_table(metrics, rate=THIN_TO)
    return table.select("rate", "metric", r("value", 8).alias("value"))


@query
def accuracy_genome_wide(d):
    """The model against the data (run 0) and against replicates drawn from it, chromosome by chromosome."""
    reads = int(d.pixels().agg(F.sum("count")).first()[0])
    runs = splitting.draws(matrix(d).values(), "value", [(k, reads, THIN_SEED + k) for k in range(1, REPLICATES + 1)],
                           splitting.binomial).withColumnRenamed("case", "run")
    data = d.pixels().withColumn("run", F.lit(0))
    table = accuracy.by_case(model(d, RESOLUTION), cut(data.unionByName(runs)), ["run"])
    return table.select("run", "chrom_idx", "metric", r("value", 7).alias("value"))


@query
def accuracy_thinning_grid(d):
    """The model against samples of the reads at several rates, all drawn in one pass."""
    upper = d.pixels().where("bin1_id < bin2_id")
    reads = int(upper.agg(F.sum("count")).first()[0])
    cases = [(int(100 * rate), sampling.sample_size(reads, rate), THIN_SEED) for rate in RATES]
    thinned = splitting.draws(upper, "count", cases, splitting.hypergeometric).withColumnRenamed("case", "percent")
    table = accuracy.whole_by_case(model(d, RESOLUTION), cut(thinned), ["percent"])
    return table.select("percent", "metric", r("value", 7).alias("value"))


@query
def accuracy_single_cells(d):
    """The model against every single cell, over all usable pairs."""
    table = accuracy.whole_by_case(model(d, RESOLUTION), d.cell_pixels(), ["cell_id"])
    return table.select("cell_id", "metric", r("value", 7).alias("value"))


@query
def row_correlation(d):
    normalised = distance.distance_normalised(balanced_cells(d), usable(d), d.n_bins)
    out = pca.row_correlation(normalised, usable(d), d.n_bins, "normalised")
    return out.select("bin1_id", "bin2_id", rounded("correlation", 8).alias("correlation"))


@query
def pca_compartments(d):
    _, scores = pca.compartments(balanced_cells(d), usable(d), d.n_bins)
    return scores.select("bin_id", r(F.abs("score"), 5).alias("strength"))


@query
def pca_reconstruction(d):
    scores = d.states().select("bin_id", (F.col("probs")[0] - F.col("probs")[1]).alias("score"))
    return pca.outer_product(scores, d.n_bins).select("bin1_id", "bin2_id", rounded("value", 9).alias("value"))


# --- mixing experiment -----------------------------------------------------------

def groups(d: ContactData) -> dict[str, DataFrame]:
    p, states = F.col("probs"), cut(d.states())
    return {"s1": mixing.row_group(states, p[0] > 0.5),
            "s2": mixing.row_group(states, (p[1] > 0.5) & (p[0] < 0.4)),
            "mixed": mixing.row_group(states, (p[2] > 0.4) & (p[0] < 0.5))}


def profiles(d: ContactData, cells: DataFrame) -> DataFrame:
    return mixing.read_profiles(cells, mixing.labelled(groups(d)), usable(d), ["s1", "s2", "mixed"])


@query
def row_groups(d):
    return mixing.labelled(groups(d)).withColumnRenamed("profile", "row_group")


@query
def band_mask_rows(d):
    return clean.rows_without_band(d.pixels(), groups(d)["mixed"], mixing.MARGIN, "count")


@query
def bulk_profile(d):
    return profiles(d, balanced_cells(d)).select("profile", "col", r("p", 12).alias("p"))


@query
def cell_read_counts(d):
    vectors = mixing.cell_vectors(d.cell_pixels(), groups(d)["mixed"], usable(d))
    return mixing.read_counts(vectors)


@query
def profile_log_likelihood(d):
    vectors = mixing.cell_vectors(d.cell_pixels(), groups(d)["mixed"], usable(d))
    scores = mixing.profile_scores(vectors, profiles(d, balanced_cells(d)))
    return scores.select("cell_id", "profile", r("score", 5).alias("score"))


@query
def mixed_log_ratio(d):
    vectors = cut(mixing.cell_vectors(d.cell_pixels(), groups(d)["mixed"], usable(d)))
    cells = cut(balanced_cells(d))
    decay = distance.decay_only(distance.distance_normalised(cells, usable(d), d.n_bins))
    ratios = [mixing.log_ratio(mixing.profile_scores(vectors, profiles(d, frame)), ["s1", "s2"], "mixed")
              for frame in (cells, decay.select("bin1_id", "bin2_id", F.col("decay").alias("value")))]
    return mixing.mixed_log_ratio(*ratios).select("cell_id", r("mlr", 5).alias("mlr"))


@query
def simulate_mixture(d):
    vectors = mixing.cell_vectors(d.cell_pixels(), groups(d)["mixed"], usable(d))
    return mixing.simulate(mixing.read_counts(vectors), profiles(d, balanced_cells(d)), ["s1", "s2"], 0.5)


@query
def mixing_experiment(d):
    vectors = mixing.cell_vectors(d.cell_pixels(), groups(d)["mixed"], usable(d))
    return mixing.experiment(vectors, mixing.read_counts(vectors), profiles(d, balanced_cells(d)),
                             ["s1", "s2"], "mixed")


# --- fits ------------------------------------------------------------------------

@query
def top_n_fits(d):
    return top_fits(d.fits(), 5)


@query
def best_of_fits(d):
    return best_fit(d.fits())


def fit_row(d: ContactData, fit) -> DataFrame:
    rows = [(k, None if np.isnan(p).any() else [float(v) for v in p]) for k, p in enumerate(fit.state_probabilities)]
    frame = d.spark.createDataFrame(rows, "bin_id int, probs array<double>")
    return frame.withColumn("objective", F.lit(float(fit.objective)))


@query
def fit_dense_model(d):
    return fit_row(d, fit_dense(d.pixels(), d.bins(), d.genome, 2, seed=1, options=FIT_OPTIONS, resolution=RESOLUTION))


@query
def fit_sparse_model(d):
    return fit_row(d, fit_sparse(d.pixels(), d.bins(), d.genome, 2, n_zeros=20 * d.n_bins, seed=1,
                                 options=FIT_OPTIONS))


@query
def fit_decay_model(d):
    alpha, beta, result = fit_decay(d.pixels(), d.bins(), d.genome, RESOLUTION, options=FIT_OPTIONS)
    return d.spark.createDataFrame([(alpha, beta, float(result.fun))], "alpha double, beta double, objective double")
