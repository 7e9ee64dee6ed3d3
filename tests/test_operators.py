"""Operators against brute force on small inputs, with tiny blocks and hot keys."""

import math

import numpy as np
import pytest
from conftest import bins_frame, frame, pixels_frame
from pyspark.sql import functions as F

from plaidframe.functions.columns import int_div, rounded, safe_div
from plaidframe.functions.numerics import exact_sum, float_sum, log_sum_exp
from plaidframe.functions.parse import key_values, number
from plaidframe.genome import Genome
from plaidframe.functions.permutation import permuted
from plaidframe.operators import balance, clean, compare, distance, ordered, pairs, reshape, sampling, select, splitting, zeros

GENOME = Genome(("chr1", "chr2", "chrX"), (7, 5, 4))


def random_cells(n=16, count=60, seed=0, hot=None):
    rng = np.random.default_rng(seed)
    cells = {}
    for i, j in rng.integers(0, n, (count, 2)):
        if hot is not None and rng.random() < 0.4:
            i = hot
        cells[min(i, j), max(i, j)] = int(rng.integers(1, 30))
    return cells


def square(cells, n=16):
    m = np.zeros((n, n))
    for (i, j), v in cells.items():
        m[i, j] = m[j, i] = v
    return m


def collect(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_genome_layout():
    g = Genome(("chr1", "chr2", "chrY", "chrM"), (4, 3, 2, 1))
    assert g.extent("chr2") == (4, 7) and g.first_ym_bin() == 7 and g.pick("all_no_ym") == [0, 1]
    assert g.coarsened(3).lengths == (2, 1, 1, 1)
    with pytest.raises(KeyError):
        g.pick("chr9")


def test_many_contigs_use_the_array_lookup(spark):
    g = Genome(tuple(f"c{k}" for k in range(80)), tuple(1 + k % 3 for k in range(80)))
    got = collect(spark.range(g.n_bins).select("id", g.chrom_of(F.col("id")).alias("c")), "id", "c")
    assert [c for _, c in got] == list(np.repeat(np.arange(80), g.lengths))


@pytest.mark.parametrize("size", [1, 3, 100])
def test_forward_fill(spark, size):
    rows = [(0, k, v) for k, v in enumerate([None, 2.0, None, None, 5.0, None, None, None])] + [(1, 9, None), (1, 12, 4.0)]
    df = frame(spark, rows, "g int, k int, v double")
    got = collect(ordered.forward_fill(df, "v", "k", ["g"], F.lit(-1.0), size), "g", "k", "v")
    assert [v for *_, v in got] == [-1, 2, 2, 2, 5, 5, 5, 5, -1, 4]


@pytest.mark.parametrize("size", [1, 4, 100])
def test_previous_and_running_total(spark, size):
    keys = [0, 1, 3, 4, 9, 20, 21]
    df = frame(spark, [(k, float(k) if k != 4 else None) for k in keys], "k int, v double")
    prev = dict(collect(ordered.previous(df, "v", "k", "p", size).where("k > 0"), "k", "p")) if size == 100 else None
    rows = {r["k"]: r["p"] for r in ordered.previous(df, "v", "k", "p", size).collect()}
    assert rows[0] is None and rows[3] == 1.0 and rows[9] in (None, 4.0) and rows[21] == 20.0
    total = {r["k"]: r["t"] for r in ordered.running_total(df, F.lit(1), "k", "t", size=size).collect()}
    assert [total[k] for k in keys] == list(range(len(keys)))
    assert prev is None or len(prev) == 6


def test_average_rank_with_one_value_in_most_rows(spark):
    rng = np.random.default_rng(1)
    values = [0.0] * 200 + list(np.round(rng.normal(size=150), 1))
    df = frame(spark, [(k, float(v)) for k, v in enumerate(values)], "k int, v double")
    got = {r["k"]: r["r"] for r in ordered.average_rank(df, "v", "r", ranges=5).collect()}
    v = np.array(values)
    for k in range(0, 350, 17):
        assert got[k] == (v < v[k]).sum() + ((v == v[k]).sum() + 1) / 2


def test_smallest_by_key_is_exact_at_every_size(spark):
    df = spark.range(400).withColumn("key", F.md5(F.col("id").cast("string")))
    order = [r["id"] for r in df.orderBy("key").collect()]
    for n in (0, 1, 57, 399, 400, 999):
        got = {r["id"] for r in ordered.smallest_by_key(df, "key", n, digits=1, border_rows=5).collect()}
        assert got == set(order[:n])


def test_pairs_and_windows(spark):
    bins = frame(spark, [(k, float(k)) for k in range(16) if k != 5], "bin_id int, v double")
    got = collect(pairs.bin_pairs(bins, 16, size=4), "bin1_id", "bin2_id")
    assert got == [(i, j) for i in range(16) for j in range(i + 1, 16) if 5 not in (i, j)]
    cut = collect(pairs.bin_pairs(bins, 16, window1=(2, 7), window2=(6, 9), diagonal=True, size=4), "bin1_id", "bin2_id")
    assert cut == [(i, j) for i in (2, 3, 4, 6) for j in (6, 7, 8) if i <= j]


@pytest.mark.parametrize("diagonal", [True, False])
def test_pairs_beside_stored_cells(spark, diagonal):
    bins = frame(spark, [(k,) for k in range(16) if k != 5] + [(9,), (None,)], "bin_id int")
    cells = frame(spark, [(0, 1, 2.5), (0, 1, 3.5), (0, 1, 4.5), (3, 3, 1.0), (2, 9, 7.0), (2, 9, None), (5, 6, 9.0), (9, 2, 8.0),
                          (4, None, 1.0), (13, 15, None), (14, 15, float("nan"))], "bin1_id int, bin2_id int, value double")
    every = pairs.bin_pairs(bins, 16, diagonal=diagonal, size=4)
    told = lambda df: sorted(map(str, df.collect()))
    ends = ["bin1_id", "bin2_id"]
    assert told(pairs.pairs_beside(bins, 16, cells, "value", diagonal=diagonal, size=4)) == told(every.join(cells, ends, "left"))
    assert told(pairs.pairs_without(bins, 16, cells, diagonal=diagonal, size=4)) == told(every.join(cells, ends, "left_anti"))


def test_pairs_are_not_exchanged(spark):
    """Exchanges hold cells and bins; the pairs are made behind the last one."""
    bins, stored = bins_frame(spark, GENOME), pixels_frame(spark, [(0, 1, 2), (3, 9, 1)])
    for df in (zeros.zero_candidates(stored, bins, GENOME, "trans"), pairs.pairs_beside(bins, 16, stored, "count")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        made = plan.index("MapInArrow")
        assert "Exchange" not in plan[:made] and "Join" not in plan[:made] and "Join" in plan[made:]


@pytest.mark.parametrize("names", [("chr1", "chrX"), ("chrX", "chr1"), ("chr2",)])
def test_selection_matches_array_indexing(spark, names):
    cells = random_cells()
    index = np.concatenate([np.arange(*GENOME.extent(n)) for n in names])
    want = np.triu(square(cells)[np.ix_(index, index)])
    df = pixels_frame(spark, [(i, j, v) for (i, j), v in cells.items()])
    got = collect(select.select_chroms(df, GENOME, *names), "bin1_id", "bin2_id", "count")
    assert got == [(i, j, want[i, j]) for i, j in zip(*np.nonzero(want))]


def test_balancing_and_both_join_paths(spark):
    cells = random_cells(hot=3)
    bins = bins_frame(spark, GENOME, [k != 4 for k in range(16)], 0.5)
    df = pixels_frame(spark, [(i, j, v) for (i, j), v in cells.items()])
    want = [(int(i), int(j), None if 4 in (i, j) else v * 0.25) for (i, j), v in cells.items()]
    for limit in ("268435456", "0"):  # broadcast and shuffled gather
        spark.conf.set("spark.plaidframe.broadcastBytes", limit)
        got = [tuple(r) for r in select.balanced(df, bins, 16).select("bin1_id", "bin2_id", "balanced").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    spark.conf.unset("spark.plaidframe.broadcastBytes")


def test_duplicates(spark):
    df = frame(spark, [(0, 1, 5, 2), (0, 1, 7, 1), (0, 2, 3, 1)], "bin1_id int, bin2_id int, count long, o int")
    assert collect(clean.deduplicated(df, "fix"), "bin2_id", "count") == [(1, 12), (2, 3)]
    assert collect(clean.deduplicated(df, "ignore", order="o"), "bin2_id", "count") == [(1, 7), (2, 3)]
    assert collect(clean.deduplicated(df, "remove"), "bin2_id", "count") == [(2, 3)]
    assert clean.deduplicated(df, "keep").count() == 3
    with pytest.raises(ValueError):
        clean.deduplicated(df, "what")


def test_symmetry_null_and_marginals(spark):
    df = frame(spark, [(0, 1, 2.0), (1, 0, 5.0), (0, 2, 1.0), (2, 0, None), (1, 1, 9.0)], "bin1_id int, bin2_id int, value double")
    assert {(r[0], r[1]): r[2] for r in clean.preprocessed(df).collect()} == {(0, 1): 5.0, (0, 2): None, (1, 1): None}
    cells = random_cells(hot=3)
    m = square(cells)
    weak = set(np.flatnonzero(m.sum(axis=1) < 60))
    got = clean.marginal_filter(pixels_frame(spark, [(i, j, v) for (i, j), v in cells.items()]), 16, 60)
    for i, j, v in (tuple(r) for r in got.select("bin1_id", "bin2_id", "count").collect()):
        assert v == (None if weak & {i, j} else cells[i, j])


def test_unusable_bins_and_band(spark):
    df = frame(spark, [(0, 1, None), (0, 0, None), (1, 2, 4.0)], "bin1_id int, bin2_id int, value double")
    assert collect(clean.drop_unusable_bins(df, 3), "bin1_id", "bin2_id") == [(1, 2)]
    cells = random_cells()
    m = square(cells)
    rows = frame(spark, [(3,), (9,)], "bin_id int")
    got = clean.rows_without_band(pixels_frame(spark, [(i, j, v) for (i, j), v in cells.items()]), rows, 2, "count")
    for i, j, v in (tuple(r) for r in got.select("bin1_id", "bin2_id", "count").collect()):
        assert i in (3, 9) and v == (0 if abs(i - j) <= 2 else m[i, j])


def test_coarsen(spark):
    cells = random_cells()
    member = np.concatenate([np.arange(n) // 3 + lo for n, lo in zip(GENOME.lengths, (0, 3, 5))])
    want = {}
    for (i, j), v in cells.items():
        key = int(member[i]), int(member[j])
        want[key] = want.get(key, 0) + v
    got = reshape.coarsened(pixels_frame(spark, [(i, j, v) for (i, j), v in cells.items()]), GENOME, 3)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want


@pytest.mark.parametrize("block", [2, 1000])
def test_stretch_fills_from_the_left(spark, block):
    g = Genome(("a", "b"), (3, 2))
    states = frame(spark, [(0, None), (1, [.2, .8]), (2, None), (3, [.5, .5]), (4, [.9, .1])], "bin_id int, probs array<double>")
    target = Genome(("a", "b"), (5, 4))
    good = frame(spark, [(k,) for k in (0, 2, 3, 4, 5, 8)], "bin_id int")
    out, _ = reshape.stretched(states, g, 2, target, good, 2, block)
    assert dict(collect(out, "bin_id", "probs")) == {0: [1, 0], 2: [.2, .8], 3: [.2, .8], 4: [.2, .8], 5: [.5, .5], 8: [.9, .1]}
    plain, genome = reshape.stretched(states, g, 2)
    assert genome.lengths == (6, 4) and plain.count() == 10


def test_select_fit_keeps_order_and_repeats(spark):
    states = frame(spark, [(k, [float(k)]) for k in range(16)], "bin_id int, probs array<double>")
    out, genome = reshape.select_fit(states, GENOME, [2, 0, 2])
    assert [p[0] for _, p in collect(out, "bin_id", "probs")] == [*range(12, 16), *range(7), *range(12, 16)]
    assert genome.lengths == (4, 7, 4)


@pytest.mark.parametrize("size", [3, 8, 2048])
def test_distance_normalisation(spark, size):
    cells = random_cells(hot=3)
    usable = np.array([k not in (4, 9) for k in range(16)])
    m = square(cells)
    m[~usable] = m[:, ~usable] = np.nan
    want = np.full((16, 16), np.nan)
    for d in range(1, 16):
        diag = np.diagonal(m, d)
        if np.isnan(diag).all():
            continue
        mean = np.nanmean(diag)
        for i, v in enumerate(diag):
            want[i, i + d] = 0 if mean == 0 else v / mean
    want /= np.nansum(want)
    df = frame(spark, [(int(i), int(j), float(v)) for (i, j), v in cells.items() if usable[i] and usable[j]],
               "bin1_id int, bin2_id int, value double")
    good = frame(spark, [(int(k),) for k in np.flatnonzero(usable)], "bin_id int")
    got = distance.distance_normalised(df, good, 16, size=size)
    for r in got.collect():
        assert r["normalised"] == pytest.approx(want[r["bin1_id"], r["bin2_id"]], rel=1e-12)
    assert got.agg(F.sum("normalised")).first()[0] == pytest.approx(1)


def test_balance_converges_and_follows_alternating_scaling(spark):
    cells = random_cells(count=200, seed=2)
    m = square(cells)
    df = frame(spark, [(int(i), int(j), float(v)) for (i, j), v in cells.items()], "bin1_id int, bin2_id int, value double")
    keep = np.flatnonzero(m.sum(axis=0))
    work = m[np.ix_(keep, keep)]
    for _ in range(3):
        work = (work / work.mean(axis=0)).T
    got = {(r[0], r[1]): r[2] for r in balance.balance(df, 16, fixed_passes=3).collect()}
    for a, i in enumerate(keep):
        for b, j in enumerate(keep):
            if work[a, b]:
                assert got[i, j] == pytest.approx(work[a, b], rel=1e-12)
    done = balance.balancing_factors(df, 16, epsilon=1e-6)
    assert done.deviation <= 1e-6
    with_limit = balance.balancing_factors(df, 16, epsilon=0.0, max_passes=2)
    assert with_limit.passes == 2


# Sampler cases with their known answers.
def test_zero_cases(spark):
    none = spark.createDataFrame([], "bin1_id int, bin2_id int, count double")
    first = pixels_frame(spark, [(0, 0, 1), (0, 1, 1), (0, 2, 1)])
    three, thirty = Genome.single(3), Genome(("a", "b", "c"), (10, 10, 10))
    assert zeros.total_zeros(none, bins_frame(spark, thirty), thirty, "trans") == 300
    two = Genome(("a", "b"), (2, 1))
    assert zeros.total_zeros(none, bins_frame(spark, two, [False, True, True]), two, "trans") == 1
    got = zeros.sample_zeros(none, bins_frame(spark, two, [False, True, True]), two, 1, area="trans")
    assert collect(got, "bin1_id", "bin2_id") == [(1, 2)]
    for n in (30, 20_000_000_000):
        got = zeros.sample_zeros(first, bins_frame(spark, three), three, n)
        assert collect(got, "bin1_id", "bin2_id") == [(1, 1), (1, 2), (2, 2)]
    got = zeros.sample_zeros(none, bins_frame(spark, three, [True, True, False]), three, 3)
    assert collect(got, "bin1_id", "bin2_id") == [(0, 0), (0, 1), (1, 1)]
    with pytest.raises(ValueError):
        zeros.zero_counts(none, bins_frame(spark, three), three, "cis")
    five = Genome(("a", "b", "c"), (2, 2, 1))
    row0 = pixels_frame(spark, [(0, j, 1) for j in range(5)])
    got = zeros.zero_candidates(row0, bins_frame(spark, five), five, "trans")
    assert collect(got, "bin1_id", "bin2_id") == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)]


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("area", ["both", "trans"])
def test_zero_sample_is_distinct_and_unbiased(spark, area, diagonal):
    cells = random_cells(count=80, hot=3)
    stored = pixels_frame(spark, [(i, j, v) for (i, j), v in cells.items()])
    bins = bins_frame(spark, GENOME, [k != 6 for k in range(16)])
    every = collect(zeros.zero_candidates(stored, bins, GENOME, area, diagonal), "bin1_id", "bin2_id")
    counts = zeros.zero_counts(stored, bins, GENOME, area, diagonal)
    assert counts.agg(F.sum("zeros")).first()[0] == len(every)
    seen = {}
    n = len(every) // 4
    for seed in range(4):
        got = collect(zeros.sample_zeros(stored, bins, GENOME, n, seed, area, diagonal), "bin1_id", "bin2_id")
        assert len(got) == len(set(got)) == n and set(got) <= set(every)
        for cell in got:
            seen[cell] = seen.get(cell, 0) + 1
    assert len(seen) > n  # different seeds give different cells
    # every number leads to its cell, in blocks and ranges of any size
    numbers = spark.range(len(every)).withColumnRenamed("id", "number")
    for block, width in ((3, 5), (4096, None)):
        found = zeros.zeros_by_number(numbers, stored, bins, GENOME, len(every), area, diagonal, block, width)
        assert [(r.bin1_id, r.bin2_id) for r in found.orderBy("number").collect()] == sorted(every)


def test_zeros_among_full_rows(spark):
    """Rows without zeros, and runs of stored cells, share their number with what follows."""
    n = 12
    full = {(i, j) for i in range(n) for j in range(i, n) if i in (0, 3, 4, 11) or 5 <= j < 9}
    stored, bins, genome = pixels_frame(spark, [(i, j, 1) for i, j in full]), bins_frame(spark, Genome.single(n)), Genome.single(n)
    every = [(i, j) for i in range(n) for j in range(i, n) if (i, j) not in full]
    got = zeros.sample_zeros(stored, bins, genome, len(every), block=4)
    assert collect(got, "bin1_id", "bin2_id") == every
    assert zeros.sample_zeros(stored, bins, genome, 0).count() == 0
    whole = pixels_frame(spark, [(i, j, 1) for i in range(n) for j in range(i, n)])
    assert zeros.sample_zeros(whole, bins, genome, 5).count() == 0
    smaller = set(collect(zeros.sample_zeros(stored, bins, genome, 9, seed=2), "bin1_id", "bin2_id"))
    assert smaller < set(collect(zeros.sample_zeros(stored, bins, genome, 20, seed=2), "bin1_id", "bin2_id"))


@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 1000, 1023])
def test_permutation_is_one_to_one(spark, size):
    made = [spark.range(size).select(permuted(F.col("id"), size, seed).alias("v")).toPandas().v.tolist() for seed in (1, 2)]
    assert sorted(made[0]) == sorted(made[1]) == list(range(size))
    if size >= 1000:
        assert made[0] != made[1] and abs(np.corrcoef(made[0], range(size))[0, 1]) < 0.1
        ends = np.bincount(np.array(made[0][:size // 2]) * 10 // size, minlength=10)
        assert ends.min() > size // 20 * 0.6  # a part of the numbers is spread over all places


def test_thinning_is_exact_and_repeatable(spark):
    cells = random_cells(hot=3)
    cells[2, 3] = 25_000  # one pixel holds nearly all reads
    df = pixels_frame(spark, [(i, j, v) for (i, j), v in cells.items()]).withColumn("count", F.col("count").cast("long"))
    total = sum(v for (i, j), v in cells.items() if i < j)
    for size in (0.25, 500):
        out = sampling.downsampled(df, size, seed=1)
        got = {(r[0], r[1]): r[2] for r in out.collect()}
        assert sum(got.values()) == (int(total * size) if isinstance(size, float) else size)
        assert all(v <= cells[k] for k, v in got.items())
        again = {(r[0], r[1]): r[2] for r in sampling.downsampled(df.repartition(7), size, seed=1).collect()}
        assert got == again
    for bad in (1.5, "3", True):
        with pytest.raises(TypeError):
            sampling.sample_size(10, bad)
    with pytest.raises(ValueError):
        sampling.downsampled(df, total + 1)


def test_multinomial_draws(spark):
    cells = random_cells()
    df = frame(spark, [(int(i), int(j), float(v)) for (i, j), v in cells.items()] + [(0, 15, 0.0)],
               "bin1_id int, bin2_id int, value double")
    n = 20_000
    mass = sum(cells.values())
    for out in (sampling.multinomial(df, n, seed=1),
                sampling.multinomial_keyed(df, n, seed=1, block=5, reads_per_piece=1500)):
        got = {(r[0], r[1]): r[2] for r in out.collect()}
        assert sum(got.values()) == n and (0, 15) not in got
        chi2 = sum((got.get(c, 0) - n * v / mass) ** 2 / (n * v / mass) for c, v in cells.items())
        assert chi2 < len(cells) + 6 * math.sqrt(2 * len(cells))


@pytest.mark.parametrize("law,amounts,n", [
    ("hypergeometric", [3, 0, 1, 7, 2, 2, 900, 4, 1, 1, 1], 300), ("hypergeometric", [2, 5], 7), ("hypergeometric", [4], 2),
    ("hypergeometric", [6_000_000, 1, 4_000_000, 3], 5_000_000), ("binomial", [0.5, 0.0, 1e-9, 3.0, 2.5], 1000), ("binomial", [1.0, 2.0], 0)])
def test_splitting_against_plain_recursion(spark, law, amounts, n):
    """One node after the other, probabilities from log factorials; cut into tasks in several ways."""
    import hashlib

    def pick(a, b, q, u):
        if law == "hypergeometric":
            ks = range(max(0, q - b), min(q, a) + 1)
            lg = math.lgamma
            logs = [lg(a + 1) - lg(k + 1) - lg(a - k + 1) + lg(b + 1) - lg(q - k + 1) - lg(b - q + k + 1) for k in ks]
        else:
            ks = range(q + 1)
            logs = [-math.lgamma(k + 1) - math.lgamma(q - k + 1) + k * math.log(a) + (q - k) * math.log(b) for k in ks]
        weights = np.exp(np.array(logs) - max(logs))
        return ks[int(np.searchsorted(np.cumsum(weights), u * weights.sum(), side="right"))]

    def walk(part, q, h, i):
        if h == 0 or q == 0:
            return {i << h: q} if q else {}
        half = 1 << (h - 1)
        a, b = sum(part[:half]), sum(part[half:])
        u = int(hashlib.md5(f"5:{h}:{i}".encode()).hexdigest()[:13], 16) / 16 ** 13
        left = q if not b else 0 if not a else pick(a, b, q, u)
        return {**walk(part[:half], left, h - 1, 2 * i), **walk(part[half:], q - left, h - 1, 2 * i + 1)}

    used = [(k, v) for k, v in enumerate(amounts) if v > 0]
    want = walk([v for _, v in used] + [0] * (16 - len(used)), n, 4, 0)
    df = frame(spark, [(k // 4, 5 + k % 4, v) for k, v in enumerate(amounts)],
               f"bin1_id int, bin2_id int, amount {'long' if law == 'hypergeometric' else 'double'}")
    for bits in (1, 2, 16):
        out = splitting.drawn(df.repartition(3), "amount", n, getattr(splitting, law), 5, bits=bits)
        assert {(r[0], r[1]): r[2] for r in out.collect()} == {(used[k][0] // 4, 5 + used[k][0] % 4): q for k, q in want.items()}


def test_quantiles_have_the_law(spark):
    u = (np.arange(4000) + 0.5) / 4000
    full = lambda x, kind=np.int64: np.full(4000, x, kind)
    for a, b, n in ((40, 60, 30), (5_000_000, 7_000_000, 6_000_000), (1, 9, 3)):
        k = splitting.quantiles(splitting.hypergeometric, full(a), full(b), full(n), u)
        assert abs(k.mean() - n * a / (a + b)) < 0.02 + 1e-5 * n
        spread = math.sqrt(n * a / (a + b) * b / (a + b) * (a + b - n) / (a + b - 1))
        assert k.std() == pytest.approx(spread, rel=0.02, abs=0.05) and (np.diff(k) >= 0).all()
    k = splitting.quantiles(splitting.binomial, full(1.0, float), full(3.0, float), full(10_000), u)
    assert abs(k.mean() - 2500) < 0.5 and k.std() == pytest.approx(math.sqrt(1875), rel=0.01)


def test_keyed_multinomial_equals_plain_inversion(spark):
    import hashlib
    cells = sorted(random_cells().items())
    df = frame(spark, [(int(i), int(j), float(v)) for (i, j), v in cells], "bin1_id int, bin2_id int, value double")
    ends = np.cumsum([v for _, v in cells])
    want = {}
    for r in range(3000):
        u = int(hashlib.md5(f"9:{r}".encode()).hexdigest()[:13], 16) / 16 ** 13 * ends[-1]
        cell = cells[int(np.searchsorted(ends, u, side="right"))][0]
        want[cell] = want.get(cell, 0) + 1
    out = sampling.multinomial_keyed(df, 3000, seed=9, block=4, reads_per_piece=700)
    assert {(r[0], r[1]): r[2] for r in out.collect()} == want


def test_simulated_mixture(spark):
    cells = frame(spark, [(k, 50) for k in range(40)], "cell_id long, reads int")
    table = [[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]
    out = sampling.simulate_mixture(cells, table, 0.5, seed=3)
    per = {r["cell_id"]: (r["n"], r["k"]) for r in out.groupBy("cell_id").agg(
        F.sum("count").alias("n"), F.countDistinct("profile").alias("k")).collect()}
    assert len(per) == 40 and all(v == (50, 1) for v in per.values())
    assert collect(out, "cell_id", "col", "count") == collect(
        sampling.simulate_mixture(cells.repartition(5), table, 0.5, seed=3), "cell_id", "col", "count")
    for probs in ([0.2, 0.3, 0.5], 1.5):
        with pytest.raises(ValueError):
            sampling.simulate_mixture(cells, table, probs)


def test_mixture_draws_reads_not_columns():
    class Counted:
        """A generator that counts the numbers asked for; a multinomial draw asks one for each column."""
        def __init__(self):
            self.rng, self.asked = np.random.default_rng(5), 0

        def random(self, n):
            self.asked += n
            return self.rng.random(n)

        def multinomial(self, n, p):
            self.asked += len(p)
            return self.rng.multinomial(n, p)

    shares = np.r_[0.0, np.full(997, 0.5 / 997), 0.0, 0.5]
    edges, total, cells = np.cumsum(shares[:-1]), np.zeros(1000), 4000
    rng = Counted()
    for _ in range(cells):
        cols, counts = sampling.drawn_columns(rng, 3, shares, edges)
        assert counts.sum() == 3 and (np.diff(cols) > 0).all()
        total[cols] += counts
    assert rng.asked == 3 * cells
    assert total[0] == total[998] == 0
    assert total[999] / (3 * cells) == pytest.approx(0.5, abs=0.03)
    assert total[1:998].std() == pytest.approx(np.sqrt(1.5 * cells / 997), rel=0.2)
    cols, counts = sampling.drawn_columns(rng, 5000, shares, edges)
    assert counts.sum() == 5000 and rng.asked == 3 * cells + 1000 and counts.min() > 0


def test_mixture_is_dealt_over_tasks(spark):
    cells = frame(spark, [(k, 5) for k in range(400)], "cell_id long, reads int").coalesce(1)
    out = sampling.simulate_mixture(cells, np.full((2, 100), 0.01), 0.5)
    assert out.select("cell_id", F.spark_partition_id().alias("part")).distinct().select("part").distinct().count() > 1


def test_correlations_and_likelihood(spark):
    rng = np.random.default_rng(0)
    a, b = np.r_[np.zeros(40), rng.integers(1, 5, 60)].astype(float), rng.random(100)
    cells = frame(spark, [(0, k + 1, float(x), float(y)) for k, (x, y) in enumerate(zip(a, b))], "bin1_id int, bin2_id int, a double, b double")
    assert compare.pearson(cells).first()[0] == pytest.approx(np.corrcoef(a, b)[0, 1])

    def rank(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    assert compare.spearman(cells, ranges=4).first()[0] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    sparse = compare.sparse_pearson(cells.where("a > 0"), cells, 100, "a", "b").first()[0]
    assert sparse == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert compare.pearson(cells.withColumn("a", F.lit(1.0))).first()[0] is None
    p, q = a / a.sum(), b / b.sum()
    assert compare.fit_likelihood(cells).first()[0] == pytest.approx((p * np.log(q)).sum())
    keep = a > 0
    want = np.exp((p[keep] * np.log(q[keep])).sum() - (p[keep] * np.log(p[keep])).sum())
    assert compare.likelihood_ratio(cells).first()[0] == pytest.approx(want)


def test_state_difference_ignores_state_order(spark):
    rng = np.random.default_rng(3)
    s = rng.dirichlet(np.ones(3), 10)
    a = frame(spark, [(k, p.tolist()) for k, p in enumerate(s)], "bin_id int, probs array<double>")
    b = frame(spark, [(k, p[[2, 0, 1]].tolist()) for k, p in enumerate(s)], "bin_id int, probs array<double>")
    assert compare.state_difference(a, b, 3).first()[0] == pytest.approx(0)


def test_numerics(spark):
    vec = frame(spark, [(x,) for x in [1.0, 2e-9, 3e-9] * 20_000], "x double")
    want = math.fsum([1.0, 2e-9, 3e-9] * 20_000)
    assert float_sum(vec, "x") == want
    assert float(vec.agg(exact_sum(F.col("x"))).first()[0]) == pytest.approx(want, abs=1e-10)
    values = [-1000.0, 3.0, 700.0, 699.5]
    lse = log_sum_exp(frame(spark, [(v,) for v in values], "x double"), "x").first()[0]
    assert lse == pytest.approx(700 + math.log(sum(math.exp(v - 700) for v in values)))
    df = frame(spark, [(1.0, 0.0), (0.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div(F.col("a"), F.col("b"))).collect()] == [None, None, 1.5]
    assert spark.range(1).select(int_div(F.lit(2 ** 60), 2 ** 40)).first()[0] == 2 ** 20


def test_option_strings():
    assert key_values("a=1,b=2.5,c=x") == {"a": 1, "b": 2.5, "c": "x"}
    assert isinstance(number("3"), int) and isinstance(number("3.0"), float)
    with pytest.raises(ValueError):
        key_values("a")


def test_exact_sums_of_awkward_doubles(spark):
    rng = np.random.default_rng(8)
    big = [1e308, -1e308, 5e-324, -5e-324, 2.0 ** 32, -(2.0 ** 32), 2.0 ** 64 - 2.0 ** 11, 0.1, 1e-300, 3.0 ** 40, -0.0, 2.0 ** -1040]
    for values in (big, (rng.standard_normal(500) * 10.0 ** rng.integers(-200, 200, 500)).tolist(), [0.1] * 10, [1e16, 1.0, -1e16], []):
        df = frame(spark, [(v,) for v in values] + [(None,)], "x double")
        assert float_sum(df, "x") == math.fsum(values)
        assert float_sum(df.repartition(3), "x") == math.fsum(values)
    assert math.isnan(float_sum(frame(spark, [(1.0,), (float("inf"),)], "x double"), "x"))


def test_rounded_is_round(spark):
    """F8, F10, F14: the same doubles as ``round``, for halves, negative, very large and no numbers too."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-14, 14, 3000), (rng.integers(-5000, 5000, 2000) + .5) / 1e9,
                        np.round(rng.random(1000), 12), [0.0, -0.0, -1e-20, 1e300, -1e300, np.nan, np.inf, -np.inf, 0.5, 2.5, -0.5]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    for digits in (8, 9, 12, 13):
        got = df.select(rounded("x", digits).alias("got"), F.round("x", digits).alias("want"))
        assert got.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == [] and dict(got.dtypes)["got"] == "double"
