"""Fits, regularisers, checkpoints, several starts and stored fits."""

import numpy as np
import pytest
from conftest import ALPHA, BETA, CIS, TRANS, bins_frame, model_table, pixels_frame, states_frame
from pyspark.sql import functions as F

from plaidframe.genome import Genome
from plaidframe.model import regularise
from plaidframe.model.checkpoint import OptimiserCheckpoint
from plaidframe.model.fit import best_of, fit_decay, fit_dense, fit_sparse, seeds_for
from plaidframe.model.minimise import State
from plaidframe.model.params import permuted, state_order
from plaidframe.sources import fits
from plaidframe.sources.registry import best_fit, top_fits

GENOME = Genome(("a", "b"), (12, 8))


@pytest.fixture(scope="module")
def truth():
    states = np.random.default_rng(4).dirichlet(np.ones(2), 20)
    table = model_table(GENOME, states, CIS[2], TRANS[2], ALPHA, BETA)
    total = sum(g * d for g, d in table.values())
    return states, {p: 1000 * g * d / total for p, (g, d) in table.items()}


def negative_ll(counts, table):
    z = sum(g * d for g, d in table.values())
    return -sum(x * np.log(table[p][0] * table[p][1]) for p, x in counts.items()) + sum(counts.values()) * np.log(z)


def test_dense_fit_reaches_the_generating_objective(spark, truth):
    states, counts = truth
    fit = fit_dense(pixels_frame(spark, [(i, j, x) for (i, j), x in counts.items()]), bins_frame(spark, GENOME),
                    GENOME, 2, seed=1, options={"maxiter": 60})
    best = negative_ll(counts, model_table(GENOME, states, CIS[2], TRANS[2], ALPHA, BETA))
    assert fit.objective <= best + 0.5
    got = negative_ll(counts, model_table(GENOME, fit.state_probabilities, fit.cis_weights, fit.trans_weights,
                                          fit.cis_dd_power, fit.trans_dd))
    assert got == pytest.approx(fit.objective, rel=1e-9)
    np.testing.assert_allclose(fit.state_probabilities.sum(axis=1), 1)
    assert fit.cis_weights.sum() == pytest.approx(1) and np.all(np.diff(np.diag(fit.cis_weights)) >= 0)


def test_sparse_fit_with_all_zeros_equals_the_dense_one(spark, truth):
    _, counts = truth
    some = {p: round(x) for p, x in counts.items()}
    stored = pixels_frame(spark, [(i, j, x) for (i, j), x in some.items() if x])
    usable = [k != 5 for k in range(20)]
    bins = bins_frame(spark, GENOME, usable)
    options = {"maxiter": 4}
    dense = fit_dense(stored, bins, GENOME, 2, seed=2, options=options)
    zeros = [(i, j) for (i, j), x in some.items() if not x and usable[i] and usable[j]]
    sparse = fit_sparse(stored, bins, GENOME, 2, zeros=spark.createDataFrame(zeros, "bin1_id int, bin2_id int"),
                        zero_total=len(zeros), seed=2, options=options)
    assert sparse.objective == pytest.approx(dense.objective, rel=1e-9)
    assert np.isnan(dense.state_probabilities[5]).all()
    sampled = fit_sparse(stored, bins, GENOME, 2, n_zeros=10, seed=2, options={"maxiter": 2}, trans_shape="none")
    np.testing.assert_allclose(sampled.cis_weights, sampled.trans_weights)


def test_decay_fit_recovers_power(spark):
    table = model_table(GENOME, np.ones((20, 1)), np.ones((1, 1)), np.ones((1, 1)), -0.9, -2.2)
    total = sum(d for _, d in table.values())
    cells = [(i, j, 500 * d / total) for (i, j), (_, d) in table.items()]
    alpha, beta, result = fit_decay(pixels_frame(spark, cells), bins_frame(spark, GENOME), GENOME, options={"ftol": 1e-14})
    assert alpha == pytest.approx(-0.9, abs=1e-3) and beta == pytest.approx(-2.2, abs=1e-3)


def test_regularisers(spark):
    states = np.random.default_rng(0).dirichlet(np.ones(3), 9)
    for fn in (regularise.l1diff, regularise.l2diff, regularise.nonuniform, regularise.none):
        value, grad = fn(states)
        for k in range(0, states.size, 5):
            hi, lo = states.copy(), states.copy()
            hi.flat[k] += 1e-6
            lo.flat[k] -= 1e-6
            assert grad.flat[k] == pytest.approx((fn(hi)[0] - fn(lo)[0]) / 2e-6, abs=1e-4)
    frame = states_frame(spark, states)
    row = regularise.terms(frame, 3).first()
    assert row["l1diff"] == pytest.approx(regularise.l1diff(states)[0])
    assert row["nonuniform"] == pytest.approx(regularise.nonuniform(states)[0])
    assert regularise.l2diff_frame(frame, 3) == pytest.approx(regularise.l2diff(states)[0])
    with pytest.raises(ValueError):
        regularise.resolve("l9")


def test_checkpoint_throttles_and_resumes(spark, tmp_path, truth):
    now = [0.0]
    ckpt = OptimiserCheckpoint(spark, str(tmp_path / "c"), interval=100.0, clock=lambda: now[0])
    state = State(3, np.ones(2), 1.5, np.zeros(2), [np.ones(2)], [np.ones(2)])
    assert ckpt.restore() is None
    assert ckpt.save(state)
    now[0] = 50.0
    assert not ckpt.save(State(4, np.ones(2), 1.0, np.zeros(2)))
    assert ckpt.save(State(5, np.ones(2) * 2, 0.5, np.zeros(2)), force=True)
    assert ckpt.restore().iteration == 5 and ckpt.restore().f == 0.5
    ckpt.remove()
    assert not ckpt.exists()
    pixels = pixels_frame(spark, [(i, j, x) for (i, j), x in truth[1].items()])
    bins = bins_frame(spark, GENOME)
    path = OptimiserCheckpoint(spark, str(tmp_path / "fit"), interval=0.0)
    fit_dense(pixels, bins, GENOME, 2, seed=3, options={"maxiter": 3}, checkpoint=path)
    resumed = fit_dense(pixels, bins, GENOME, 2, seed=99, options={"maxiter": 6}, checkpoint=path)
    straight = fit_dense(pixels, bins, GENOME, 2, seed=3, options={"maxiter": 6})
    assert resumed.result.nit == 6 and resumed.objective == pytest.approx(straight.objective, rel=1e-9)


def test_several_starts(spark):
    class Stub:
        def __init__(self, objective):
            self.objective, self.metadata = objective, {}

    scores = iter([3.0, 1.0, 1.0])
    import dataclasses
    from plaidframe.model.fit import Fit
    base = Fit(np.ones((1, 1)), np.ones((1, 1)), np.ones((1, 1)), -1.0, -2.0, Genome.single(1))
    seen = []

    def run(seed, zero_seed, number):
        seen.append((seed, zero_seed))
        return dataclasses.replace(base, metadata={"optimize_value": next(scores), "n": number})

    best = best_of(run, 3, [7, 8])
    assert best.metadata["n"] == 2 and len(best.metadata["durations"]) == 3
    assert seen == [(7, 7), (8, 8), (None, None)]
    assert seeds_for(2, [1], [5]) == [(1, 5), (None, None)]
    with pytest.raises(ValueError):
        seeds_for(1, [1, 2])


def test_state_order():
    weights = np.array([[.5, .1, .2], [.1, .05, .3], [.2, .3, .2]])
    order = state_order(weights)
    assert list(order) == [1, 2, 0] and list(np.diag(permuted(weights, order))) == [.05, .2, .5]


def test_stored_fits(spark, tmp_path):
    params = {"state_probabilities": [[.2, .8], [np.nan, np.nan], [.5, .5]], "state_weights": np.eye(2) / 2,
              "cis_dd_power": -1.0, "trans_dd": -2.0}
    for k, score in enumerate([5.0, 2.0, 2.0]):
        fits.save(spark, str(tmp_path / f"dir/f{k}"), fits.from_parameters(params, {"optimize_value": score}))
    back = fits.load(spark, str(tmp_path / "dir/f1"))
    np.testing.assert_array_equal(back.state_probabilities, np.array(params["state_probabilities"]))
    np.testing.assert_array_equal(back.trans_weights, np.eye(2) / 2)
    assert back.genome.lengths == (3,)
    listed = fits.registry(spark, [str(tmp_path / "dir")])
    assert [r["fit_id"] for r in top_fits(listed, 2).collect()] == [1, 2]
    assert best_fit(listed).first()["fit_id"] == 1
    assert fits.registry(spark, [str(tmp_path / "dir")], recursive=False).count() == 0
    assert fits.update_metadata(spark, str(tmp_path / "dir/f0"), {"optimize_value": 1.0, "note": "x"}, dry_run=True)["note"] == "x"
    assert fits.metadata(spark, str(tmp_path / "dir/f0"))["optimize_value"] == 5.0
    fits.update_metadata(spark, str(tmp_path / "dir/f0"), {"optimize_value": 1.0})
    assert fits.metadata(spark, str(tmp_path / "dir/f0"))["optimize_value"] == 1.0
    fits.save(spark, str(tmp_path / "dir/f0"), back, mode="ignore")
    assert fits.metadata(spark, str(tmp_path / "dir/f0"))["optimize_value"] == 1.0
    for bad in ({k: v for k, v in params.items() if k != "trans_dd"}, {**params, "extra": 1}):
        with pytest.raises(ValueError):
            fits.checked(bad)


@pytest.mark.parametrize("dense", [True, False])
def test_distributed_fit_follows_the_broadcast_one(spark, truth, dense):
    from plaidframe.model.large import fit_distributed
    _, counts = truth
    some = {p: round(x) for p, x in counts.items()}
    stored = pixels_frame(spark, [(i, j, x) for (i, j), x in some.items() if x])
    bins = bins_frame(spark, GENOME, [k != 5 for k in range(20)])
    start = np.random.default_rng(6).uniform(0.3, 0.7, (20, 2))
    start /= start.sum(axis=1, keepdims=True)
    options = {"maxiter": 3, "memory": 5}
    kwargs = {}
    if not dense:
        empty = [(i, j) for (i, j), x in some.items() if not x and 5 not in (i, j)]
        kwargs = {"zeros": spark.createDataFrame(empty, "bin1_id int, bin2_id int"), "zero_total": 2 * len(empty)}
    init = {"cis_weights": CIS[2], "trans_weights": TRANS[2]}
    fit = fit_dense if dense else fit_sparse
    small = fit(stored, bins, GENOME, 2, init={**init, "state_probabilities": start}, options=options, **kwargs)
    large = fit_distributed(stored, bins, GENOME, 2, dense=dense, init=init, options=options,
                            start=states_frame(spark, start, [k != 5 for k in range(20)]), **kwargs)
    assert large.iterations == small.result.nit == 3
    assert large.objective == pytest.approx(small.objective, rel=1e-9)
    got = {r["bin_id"]: r["probs"] for r in large.states.collect()}
    assert 5 not in got
    for b, p in got.items():
        np.testing.assert_allclose(p, small.state_probabilities[b], atol=1e-7)


def test_repeated_cells_in_a_sparse_fit(spark, truth):
    """Cells stored in parts fit as their sums do; dropping them or taking the first part changes the data."""
    cells = [(i, j, float(round(x))) for (i, j), x in truth[1].items() if round(x) > 1]
    whole, bins = pixels_frame(spark, cells), bins_frame(spark, GENOME)
    parts = (whole.withColumn("part", F.explode(F.array(F.lit(1), F.lit(2))))
             .withColumn("count", F.when(F.col("part") == 1, F.lit(1.0)).otherwise(F.col("count") - 1)))
    run = lambda p, **more: fit_sparse(p, bins, GENOME, 2, n_zeros=15, seed=3, options={"maxiter": 3}, **more).objective
    assert run(parts, dups="fix") == pytest.approx(run(whole), rel=1e-9)
    first = whole.withColumn("count", F.lit(1.0))
    assert run(parts, dups="ignore", dups_order="part") == pytest.approx(run(first), rel=1e-9)
    assert run(parts.unionByName(parts.where("part = 1 and bin1_id > 0")).where("bin1_id > 0 or part = 1"), dups="remove") \
        == pytest.approx(run(first.where("bin1_id = 0")), rel=1e-9)
    with pytest.raises(ValueError):
        run(parts, dups="other")
