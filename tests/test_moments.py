"""Sums over all pairs without listing them, against brute force."""

import math

import numpy as np
import pytest
from conftest import ALPHA, BETA, CIS, STATES, TRANS, model_table, pixels_frame, states_frame
from pyspark.sql import functions as F

from plaidframe.genome import Genome
from plaidframe.model import draws, generate, moments, ranks
from plaidframe.model.mass import Model
from plaidframe.operators import pairs, sampling, splitting
from plaidframe.plans import accuracy

LONG = Genome(("a", "b", "c"), (23, 9, 14))


def setting(spark, n_states, seed=0):
    rng = np.random.default_rng(seed)
    states = rng.dirichlet(np.ones(n_states), LONG.n_bins)
    usable = rng.random(LONG.n_bins) > 0.2
    table = {k: v for k, v in model_table(LONG, states, CIS[n_states], TRANS[n_states], ALPHA, BETA).items() if usable[k[0]] and usable[k[1]]}
    cells = {k: float(rng.integers(1, 6)) for k in table if rng.random() < 0.3}
    stored = {**cells, (0, 0): 9.0, **{(int(k), LONG.n_bins - 1): 4.0 for k in np.flatnonzero(~usable) if k < LONG.n_bins - 1}}
    model = Model(states_frame(spark, states, usable), LONG, CIS[n_states], TRANS[n_states], ALPHA, BETA)
    return model, pixels_frame(spark, [(i, j, v) for (i, j), v in stored.items()]), {k: g * d for k, (g, d) in table.items()}, cells


@pytest.mark.parametrize("n_states", [2, 3])
@pytest.mark.parametrize("by_chrom", [False, True])
def test_moments(spark, n_states, by_chrom):
    model, pixels, b, cells = setting(spark, n_states)
    chrom = np.repeat(np.arange(3), LONG.lengths)
    rows = {r.scope: r for r in moments.moments(model, pixels, by_chrom=by_chrom).withColumns(
        {"pearson": moments.pearson(), "l": moments.fit_likelihood(), "lr": moments.likelihood_ratio()}).collect()}
    scopes = {0: list(b)} if not by_chrom else {c: [k for k in b if chrom[k[0]] == chrom[k[1]] == c] for c in range(3)}
    assert set(rows) == set(scopes)
    for scope, keys in scopes.items():
        y = np.array([b[k] for k in keys])
        x = np.array([cells.get(k, 0.0) for k in keys])
        r = rows[scope]
        assert [r.n, r.sa, r.saa, r.sab, r.sb, r.sbb] == pytest.approx([len(y), x.sum(), x @ x, x @ y, y.sum(), y @ y], rel=1e-10)
        assert r.pearson == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.nansum(np.where(x > 0, x / x.sum() * np.log(x / x.sum()), 0))
            fit = np.nansum(np.where((x > 0) & (y > 0), x / x.sum() * np.log(y / y.sum()), 0))
        assert r.l == pytest.approx(fit, rel=1e-9)
        if (y[x > 0] > 0).all():
            assert r.lr == pytest.approx(math.exp(fit - own), rel=1e-9)


@pytest.mark.parametrize("size", [4, 16, 1024])
def test_diagonal_sums_and_parametric_form(spark, size, monkeypatch):
    model, pixels, b, cells = setting(spark, 3, seed=1)
    want = {}
    for (i, j), v in b.items():
        want.setdefault(j - i, []).append(v)
    got = {r.distance: r for r in moments.diagonal_sums(model, size).collect()}
    assert set(got) == set(want)
    for d, values in want.items():
        assert got[d].pairs == len(values) and got[d].mass == pytest.approx(sum(values), rel=1e-9, abs=1e-12)
    z, total = sum(b.values()), sum(len(v) for v in want.values())
    scaled = {(r.bin1_id, r.bin2_id): r.parametric for r in moments.parametric_normalised(model, pixels).collect()}
    assert set(scaled) == set(cells)
    for (i, j), v in cells.items():
        if b[i, j] > 0:
            assert scaled[i, j] == pytest.approx(v / (np.mean(want[j - i]) / z) / total, rel=1e-9)


def test_moments_without_data(spark):
    model = Model(states_frame(spark, STATES[2]), Genome(("chr1", "chr2"), (4, 1)), CIS[2], TRANS[2], ALPHA, BETA)
    row, = moments.moments(model, pixels_frame(spark, [(1, 1, 3.0)]).limit(1)).select(
        "n", "sa", moments.pearson().alias("p"), moments.fit_likelihood().alias("l"), moments.likelihood_ratio().alias("r")).collect()
    assert (row.n, row.sa, row.p, row.l, row.r) == (10, 0, None, None, None)


def average_ranks(v):
    order = np.sort(v)
    return (np.searchsorted(order, v, side="left") + np.searchsorted(order, v, side="right") + 1) / 2


@pytest.mark.parametrize("size,per_range,ties", [(4, 10, False), (256, 1 << 21, False), (8, 40, True)])
def test_spearman_without_pairs(spark, size, per_range, ties):
    model, pixels, b, cells = setting(spark, 2, seed=2)
    if ties:  # two kinds of bins, so very many equal values
        states = model.states.select("bin_id", F.when(F.col("bin_id") % 3 == 0, F.array(F.lit(0.25), F.lit(0.75)))
                                     .otherwise(F.array(F.lit(0.5), F.lit(0.5))).alias("probs"))
        model = Model(states, LONG, CIS[2], TRANS[2], -0.0, BETA)
        chrom = np.repeat(np.arange(3), LONG.lengths)
        p = {k: np.array([.25, .75]) if k % 3 == 0 else np.array([.5, .5]) for k in range(LONG.n_bins)}
        b = {(i, j): (p[i] @ CIS[2] @ p[j]) if chrom[i] == chrom[j] else (p[i] @ TRANS[2] @ p[j]) * math.exp(BETA) for i, j in b}
    keys = list(b)
    y = np.round([b[k] for k in keys], 14) if ties else np.array([b[k] for k in keys])
    x = np.array([cells.get(k, 0.0) for k in keys])
    want = np.corrcoef(average_ranks(x), average_ranks(y))[0, 1]
    got = ranks.spearman(model, pixels, size=size, per_range=per_range).first()[0]
    assert got == pytest.approx(want, abs=1e-9 if not ties else 1e-2)
    assert ranks.spearman(model, pixels.limit(0), size=size, per_range=per_range).first()[0] is None


@pytest.mark.parametrize("per_range,normalised", [(25, False), (1 << 22, True)])
def test_spearman_exchanges_no_model_values(spark, per_range, normalised, monkeypatch):
    """above a number of pairs only stored cells are rows; the result is that of ranking all values."""
    model, pixels, b, _ = setting(spark, 2, seed=2)
    twins = model.states.withColumn("bin_id", F.col("bin_id") - F.col("bin_id") % 2).groupBy("bin_id").agg(F.first("probs").alias("twin"))
    states = model.states.join(twins.withColumnRenamed("bin_id", "even"), F.col("bin_id") - F.col("bin_id") % 2 == F.col("even"))
    model = Model(states.select("bin_id", F.col("twin").alias("probs")).localCheckpoint(), LONG, CIS[2], TRANS[2], ALPHA, BETA)  # ties
    means = (np.linspace(1, 2, LONG.n_bins), np.linspace(3, 1, LONG.n_bins)) if normalised else None
    want = ranks.spearman(model, pixels, size=8, means=means).first()[0]

    def exchanged(*args):
        raise AssertionError("values of all pairs were exchanged")

    monkeypatch.setattr(ranks, "EXCHANGED", 0, raising=False)
    monkeypatch.setattr(ranks, "_range_sums", exchanged)
    assert ranks.spearman(model, pixels, size=8, per_range=per_range, means=means).first()[0] == pytest.approx(want, abs=1e-12)
    assert ranks.spearman(model, pixels.limit(0), size=8, per_range=per_range, means=means).first()[0] is None


def test_many_data_sets_in_one_plan(spark, tmp_path):
    model, pixels, b, cells = setting(spark, 2, seed=4)
    chrom = np.repeat(np.arange(3), LONG.lengths)
    other = {k: v for k, v in cells.items() if chrom[k[0]] == chrom[k[1]] == 0}
    both = pixels.withColumn("run", F.lit(0)).unionByName(pixels_frame(spark, [(*k, v) for k, v in other.items()]).withColumn("run", F.lit(1)))
    table = accuracy.by_case(model, both, ["run"])
    got = {(r.run, r.chrom_idx, r.metric): r.value for r in table.collect()}
    assert {k[:2] for k in got} == {(0, 0), (0, 1), (0, 2), (1, 0)} and len(got) == 12
    for (run, c, metric), value in got.items():
        keys = [k for k in b if chrom[k[0]] == chrom[k[1]] == c]
        x, y = np.array([(cells if run == 0 else other).get(k, 0.0) for k in keys]), np.array([b[k] for k in keys])
        d = np.array([j - i for i, j in keys])
        if metric == "pearson":
            assert value == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-8)
        if metric == "normalised_pearson":
            mx, my = (np.array([v[d == e].mean() for e in d]) for v in (x, y))
            assert value == pytest.approx(np.corrcoef(np.where(mx > 0, x / np.where(mx > 0, mx, 1), 0), y / my)[0, 1], rel=1e-8)
    path = str(tmp_path / "table")
    accuracy.write_table(table, path)
    accuracy.write_table(table.where("metric = 'lr'").withColumn("value", F.lit(7.0)), path)  # replaces its partition only
    back = {(r.run, r.chrom_idx, r.metric): r.value for r in accuracy.read_table(spark, path).collect()}
    assert set(back) == set(got) and all(v == (7.0 if k[2] == "lr" else got[k]) for k, v in back.items())
    grid = accuracy.as_grid(table.where("run = 0"), "chrom_idx", "run", "pearson").orderBy("chrom_idx").collect()
    assert [r["0"] for r in grid] == [got[0, c, "pearson"] for c in range(3)]


def test_draws_of_several_cases_are_the_single_ones(spark):
    _, pixels, _, cells = setting(spark, 2, seed=5)
    counts = pixels.withColumn("count", F.col("count").cast("long"))
    cases = [(3, 40, 1), (4, 40, 2), (9, 0, 1)]
    got = {}
    for r in splitting.draws(counts, "count", cases, splitting.hypergeometric, bits=3).collect():
        got.setdefault(r.case, {})[r.bin1_id, r.bin2_id] = r["count"]
    assert set(got) == {3, 4} and got[3] != got[4]
    for case, n, seed in cases[:2]:
        single = splitting.drawn(counts, "count", n, splitting.hypergeometric, seed)
        assert got[case] == {(r.bin1_id, r.bin2_id): r["count"] for r in single.collect()}


@pytest.mark.parametrize("size,reads", [(4, 700), (16, 1 << 20)])
def test_keyed_reads_of_a_model_without_pairs(spark, size, reads, monkeypatch):
    """The draw over a model matrix is the one over its listed cells, and lists none itself."""
    model, *_ = setting(spark, 3, seed=6)
    matrix = generate.ModelMatrix(model)
    want = {(r[0], r[1]): r[2] for r in sampling.multinomial_keyed(matrix.values(), 3000, seed=9).collect()}

    def listed(*args, **kwargs):
        raise AssertionError("pairs were listed")

    for module in (generate, pairs):
        monkeypatch.setattr(module, "bin_pairs", listed)
    got = draws.multinomial_keyed(model, 3000, seed=9, size=size, reads_per_piece=reads)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want
    assert {(r[0], r[1]): r[2] for r in sampling.multinomial_keyed(matrix, 3000, seed=9).collect()} == want
    none = Model(model.states.limit(0), LONG, CIS[3], TRANS[3], ALPHA, BETA)
    assert sampling.multinomial_keyed(generate.ModelMatrix(none), 10).collect() == []


def test_ranges_get_each_value_once_and_stored_cells_apart(spark):
    """What is dealt for a model value without data is eight bytes, whatever the number of cells; ties go with their number."""
    model, pixels, b, cells = setting(spark, 3, seed=7)
    tiled = ranks.with_data(model, pixels, "count", 16)
    values = ranks.tile_values(model)
    ends = ranks._ranges(tiled, values, 50)
    sums = ranks._range_sums(tiled, values, ends)
    dealt = [r for r in sums.collect()]
    order = np.sort(list(b.values()))
    low = np.searchsorted(order, ends.view(float))
    assert sum(r.n for r in dealt) == len(b) and len(ends) > 3
    assert {r.range: r.n for r in dealt if r.a == 0}.keys() <= set(range(len(ends)))
    for a in {0.0, *cells.values()}:
        got = sum(r.s + low[r.range] * r.n for r in dealt if r.a == a)
        assert got == sum(np.searchsorted(order, v) + 1 for k, v in b.items() if cells.get(k, 0.0) == a)
    some = np.sort(np.random.default_rng(0).random(100))
    assert (ranks._from_planes(ranks._planes(some)) == some).all() and len(ranks._planes(some)) == 800


def test_metrics_of_a_model_without_pairs(spark, monkeypatch):
    """The same as over listed cells; one of the diagonals has no data."""
    model, pixels, b, cells = setting(spark, 3, seed=8)
    chosen = {k: v for k, v in cells.items() if k[1] - k[0] != 2}
    pixels = pixels.where("bin2_id - bin1_id <> 2")
    listed = spark.createDataFrame([(i, j, chosen.get((i, j), 0.0), float(v)) for (i, j), v in b.items()],
                                   "bin1_id int, bin2_id int, a double, b double")
    want = {r.metric: r.value for r in accuracy.long_table(accuracy.compare_matrices(listed)).collect()}

    def pairs_listed(*args, **kwargs):
        raise AssertionError("pairs were listed")

    monkeypatch.setattr(generate, "bin_pairs", pairs_listed)
    got = {r.metric: r.value for r in accuracy.long_table(accuracy.compare_with_model(model, pixels)).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want, rel=1e-8)


def test_accuracy_table_exchanges_no_model_values(spark, monkeypatch):
    """neither rank correlation of the table sends the values of all pairs above a number of pairs."""
    model, pixels, _, _ = setting(spark, 2, seed=9)
    asked = []

    def looked_up(model, tiled, means, n, per_slice):
        asked.append((means is not None, n))
        return 0.25

    monkeypatch.setattr(ranks, "EXCHANGED", 0, raising=False)
    monkeypatch.setattr(ranks, "_without_exchange", looked_up, raising=False)
    monkeypatch.setattr(ranks, "_range_sums", lambda *args: pytest.fail("values of all pairs were exchanged"))
    table = accuracy.compare_with_model(model, pixels)
    usable = model.states.count()
    assert asked == [(False, usable * (usable - 1) // 2), (True, usable * (usable - 1) // 2)]
    assert [table[k].first()[0] for k in ("spearman", "normalised_spearman")] == [0.25, 0.25]


def test_totals_of_matrices_without_their_pairs(spark, monkeypatch):
    """F8, F10, F14: what a matrix is scaled by is no second pass over its pairs; a repeated bin counts as often as it comes."""
    model, _, b, _ = setting(spark, 3, seed=10)
    alone = Model(model.states, LONG, CIS[3], CIS[3], 0.0, 0.0)
    bins = spark.createDataFrame([(k, 1.0) for k in sorted({k for pair in b for k in pair})], "bin_id int, weight double")
    again = model.states.unionByName(model.states.where("bin_id = 3"))

    def listed(*args):
        raise AssertionError("pairs were listed for their sum")

    monkeypatch.setattr(generate, "share", listed)
    chrom = np.repeat(np.arange(3), LONG.lengths)
    decay = {(i, j): (j - i) ** ALPHA if chrom[i] == chrom[j] else math.exp(BETA) for i, j in b}
    compartment = {(r[0], r[1]): r[2] for r in generate.ModelMatrix(alone).values().collect()}
    inside = {k: v for k, v in b.items() if chrom[k[0]] == chrom[k[1]] == 0}
    for got, want in ((generate.compartment_matrix(model.states, LONG, CIS[3]), compartment),
                      (generate.decay_matrix(bins, LONG, ALPHA, BETA), decay),
                      (generate.ModelMatrix(model).chromosome(1), inside)):
        found, total = {(r[0], r[1]): r[2] for r in got.collect()}, sum(v or 0.0 for v in want.values())
        assert found.keys() == want.keys()
        assert all(found[k] == pytest.approx((v or 0.0) / total, rel=1e-9, abs=1e-15) for k, v in want.items())
    for got in (generate.compartment_matrix(again, LONG, CIS[3]), generate.decay_matrix(bins.unionByName(bins.where("bin_id = 3")), LONG, ALPHA, BETA),
                generate.ModelMatrix(Model(again, LONG, CIS[3], TRANS[3], ALPHA, BETA)).chromosome(1)):
        assert got.agg(F.sum("value")).first()[0] == pytest.approx(1.0, rel=1e-9)


def test_block_pairs_in_a_bounded_number_of_tasks(spark, monkeypatch):
    """the driver holds a record of every task."""
    many = pairs.block_pairs(spark, 720_000, 256)
    assert many.rdd.getNumPartitions() <= 4096
    monkeypatch.setattr(pairs, "MOST_TASKS", 5, raising=False)
    assert sorted(map(tuple, pairs.block_pairs(spark, 70, 4, 1).collect())) == [(i, j) for i in range(18) for j in range(i, 18)]
