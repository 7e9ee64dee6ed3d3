"""Likelihood and gradients against brute force and finite differences."""

import numpy as np
import pytest
from conftest import ALPHA, BETA, CIS, STATES, TRANS, bins_frame, model_table, pixels_frame, states_frame

from plaidframe.genome import Genome
from plaidframe.model import frames
from plaidframe.model.mass import Model, pair_mass, pair_mass_gradient, pair_mass_sums
from plaidframe.model.objective import PixelObjective
from plaidframe.model.params import Layout, ModelValues
from plaidframe.operators.zeros import total_zeros

MASKS = [np.ones(5, bool), np.array([1, 1, 0, 1, 1], bool), np.array([0, 1, 1, 1, 0], bool)]


def counts(usable, zero_share, seed=0):
    rng = np.random.default_rng(seed)
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    values = {p: 0.1 + rng.random() for p in pairs}
    for k in rng.permutation(10)[: int(10 * zero_share)]:
        values[pairs[k]] = 0.0
    return values


def brute(values, usable, table):
    x = {p: v for p, v in values.items() if usable[p[0]] and usable[p[1]]}
    z = sum(table[p][0] * table[p][1] for p in x)
    return sum(v * np.log(table[p][0] * table[p][1]) for p, v in x.items() if v) - sum(x.values()) * np.log(z)


def numeric(fun, x, eps=1e-6):
    out = np.empty_like(x)
    for k in range(x.size):
        hi, lo = x.copy(), x.copy()
        hi.flat[k] += eps
        lo.flat[k] -= eps
        out.flat[k] = (fun(hi) - fun(lo)) / (2 * eps)
    return out


@pytest.mark.parametrize("n_states,mask,zero_share,dense", [
    (2, 0, 0.0, True), (2, 1, 0.7, True), (3, 0, 0.1, True), (3, 2, 0.7, True),
    (2, 0, 0.1, False), (2, 2, 0.7, False), (3, 1, 0.1, False), (3, 0, 0.7, False)])
def test_value_and_gradient(spark, five, n_states, mask, zero_share, dense):
    usable, values = MASKS[mask], counts(MASKS[mask], zero_share)
    states, cis, trans = STATES[n_states] + 0.02, CIS[n_states] + 0.01, TRANS[n_states] + 0.01
    stored = pixels_frame(spark, [(i, j, v) for (i, j), v in values.items() if v])
    kwargs = {"dense": True}
    if not dense:
        empty = [(i, j) for (i, j), v in values.items() if not v and usable[i] and usable[j]]
        zeros = spark.createDataFrame(empty, "bin1_id int, bin2_id int") if empty else None
        kwargs = {"zeros": zeros, "total_zeros": len(empty)}
    objective = PixelObjective(stored, usable, five, n_states, block=2, **kwargs)
    ll, grad = objective.evaluate(ModelValues(states[usable], cis, trans, ALPHA, BETA))
    objective.close()

    def at(s=states, c=cis, t=trans, a=ALPHA, b=BETA):
        return brute(values, usable, model_table(five, s, c, t, a, b))

    assert ll == pytest.approx(at(), abs=1e-10)
    np.testing.assert_allclose(grad.states, numeric(lambda s: at(s=s), states)[usable], atol=1e-6)
    # the model keeps weights symmetric, so only the symmetric part of a gradient counts
    for got, want in ((grad.cis, numeric(lambda c: at(c=c), cis)), (grad.trans, numeric(lambda t: at(t=t), trans))):
        np.testing.assert_allclose(got + got.T, want + want.T, atol=1e-6)
    assert grad.alpha == pytest.approx(numeric(lambda a: at(a=a[0]), np.array([ALPHA]))[0], abs=1e-6)
    assert grad.beta == pytest.approx(numeric(lambda b: at(b=b[0]), np.array([BETA]))[0], abs=1e-6)


@pytest.mark.parametrize("dense", [True, False])
def test_frames_agree_with_fused_kernel(spark, dense):
    """A larger case with several blocks: both forms give the same numbers."""
    rng = np.random.default_rng(5)
    genome = Genome(("a", "b", "c"), (23, 9, 14), 1)
    usable = rng.random(46) > 0.1
    states = rng.dirichlet(np.ones(3), 46)
    cells = {(int(i), int(j)): float(rng.integers(1, 9)) for i, j in
             (sorted(rng.integers(0, 46, 2)) for _ in range(300)) if i < j}
    stored = pixels_frame(spark, [(i, j, v) for (i, j), v in cells.items()])
    zeros = [(i, j) for i in range(46) for j in range(i + 1, 46)
             if usable[i] and usable[j] and (i, j) not in cells][::7]
    zframe = spark.createDataFrame(zeros, "bin1_id int, bin2_id int")
    kwargs = {"dense": True, "resolution": 10.0} if dense else {"zeros": zframe, "total_zeros": 500}
    objective = PixelObjective(stored, usable, genome, 3, block=5, **kwargs)
    ll, grad = objective.evaluate(ModelValues(states[usable], CIS[3], TRANS[3], -0.8, BETA))
    model = Model(states_frame(spark, states, usable), genome, CIS[3], TRANS[3], -0.8, BETA, 10.0 if dense else None)
    cells_frame = stored if dense else frames.with_zeros(stored, zframe, 500, len(zeros))
    value = frames.dense_log_likelihood(model, stored) if dense else frames.sparse_log_likelihood(model, cells_frame)
    assert value.first()["log_likelihood"] == pytest.approx(ll, rel=1e-12)
    rows = {r["bin_id"]: r["grad"] for r in frames.state_gradient(model, cells_frame, dense=dense).collect()}
    full = np.zeros((46, 3))
    full[usable] = grad.states
    for b, g in rows.items():
        np.testing.assert_allclose(g, full[b], atol=1e-8)
    shared = {(r["param"], r["s1"], r["s2"]): r["grad"]
              for r in frames.shared_gradient(model, cells_frame, dense=dense).collect()}
    assert shared["alpha", 0, 0] == pytest.approx(grad.alpha, abs=1e-7)
    assert shared["beta", 0, 0] == pytest.approx(grad.beta, abs=1e-7)
    for s in range(3):
        for t in range(3):
            assert shared["cis", s, t] + shared["cis", t, s] == pytest.approx(grad.cis[s, t] + grad.cis[t, s], abs=1e-7)
            assert shared["trans", s, t] == pytest.approx(grad.trans[s, t], abs=1e-7)


def test_cells_without_value_leave_the_dense_total(spark, five):
    usable = np.ones(5, bool)
    values = counts(usable, 0.0)
    rows = [(i, j, float(v)) for (i, j), v in values.items()]
    rows[2] = (rows[2][0], rows[2][1], None)
    frame = spark.createDataFrame(rows, "bin1_id int, bin2_id int, count double")
    objective = PixelObjective(frame, usable, five, 2, dense=True)
    ll, _ = objective.evaluate(ModelValues(STATES[2], CIS[2], TRANS[2], ALPHA, BETA))
    objective.close()
    known = {p: v for k, (p, v) in enumerate(values.items()) if k != 2}
    assert ll == pytest.approx(brute(known, usable, model_table(five, STATES[2], CIS[2], TRANS[2], ALPHA, BETA)), abs=1e-10)


def test_pair_mass_block_size_does_not_matter(spark):
    genome = Genome(("a", "b"), (17, 6))
    states = np.random.default_rng(1).dirichlet(np.ones(2), 23)
    model = Model(states_frame(spark, states), genome, CIS[2], TRANS[2], ALPHA, BETA)
    table = model_table(genome, states, CIS[2], TRANS[2], ALPHA, BETA)
    want = sum(g * d for g, d in table.values())
    for size in (3, 64):
        mass = pair_mass(model, size)
        assert pair_mass_sums(mass, model).first()["z"] == pytest.approx(want, rel=1e-12)
    assert pair_mass_gradient(mass, model).count() == 23


def test_gathering_through_a_shuffle(spark, five, monkeypatch):
    """Partial vectors too large for the driver are added up by block first."""
    values = counts(MASKS[0], 0.1)
    stored = pixels_frame(spark, [(i, j, v) for (i, j), v in values.items() if v])
    point = ModelValues(STATES[2], CIS[2], TRANS[2], ALPHA, BETA)
    direct = PixelObjective(stored, MASKS[0], five, 2, dense=True, block=2)
    want = direct.evaluate(point)
    monkeypatch.setattr("plaidframe.model.objective.may_broadcast", lambda *a: False)
    got = direct.evaluate(point)
    direct.close()
    assert got[0] == pytest.approx(want[0], abs=1e-12)
    np.testing.assert_allclose(got[1].states, want[1].states, atol=1e-12)


@pytest.mark.parametrize("cis,trans", [("symmetric", "symmetric"), ("diag", "none"), ("eye", "diag"),
                                       ("symmetric", "eye_with_empty"), ("binary", "symmetric")])
def test_chain_rule(cis, trans):
    rng = np.random.default_rng(2)
    layout = Layout(np.array([1, 1, 0, 1], bool), 3, cis, trans, seed=1)
    x = layout.x0 + rng.uniform(0.01, 0.05, layout.size)
    target = ModelValues(rng.normal(size=(3, 3)), rng.normal(size=(3, 3)), rng.normal(size=(3, 3)), 0.7, -0.4)

    def value(v):
        m = layout.unpack(v)
        return ((m.states * target.states).sum() + (m.cis * target.cis).sum() + (m.trans * target.trans).sum()
                + target.alpha * m.alpha + target.beta * m.beta)

    np.testing.assert_allclose(layout.gradient(x, target), numeric(value, x), atol=1e-7)


def test_layout_start_fixed_and_errors():
    usable = np.ones(4, bool)
    layout = Layout(usable, 2, seed=0, init={"cis_dd_power": -1.2}, fixed={"cis_weights": [None, 0.0, None], "trans_dd": -3.0})
    values = layout.unpack(layout.x0)
    assert values.alpha == -1.2 and values.beta == -3.0
    np.testing.assert_allclose(values.states.sum(axis=1), 1)
    assert values.cis.sum() == pytest.approx(1)
    assert (layout.bounds[layout.parts[1]][1] == 0.0).all()
    with pytest.raises(ValueError):
        Layout(usable, 2, init={"cis_weights": [1.0]})
    with pytest.raises(ValueError):
        Layout(usable, 2, "square")
    with pytest.raises(ValueError):
        Layout(usable, 2, states=lambda mask, n: {"param_function": lambda v: v})
    zero = Layout(usable, 2, "diag", init={"cis_weights": [0.0, 0.0]})
    np.testing.assert_allclose(zero.unpack(zero.x0).cis, np.eye(2) / 2)


def test_total_zeros_counts_every_unstored_cell(spark, five):
    stored = pixels_frame(spark, [(0, 1, 2.0), (1, 4, 1.0)])
    bins = bins_frame(spark, five)
    assert total_zeros(stored, bins, five) == 13
    assert total_zeros(stored, bins, five, diagonal=False) == 8
    assert total_zeros(stored, bins, five, "trans") == 3


def test_partial_vectors_follow_the_cores_not_the_partitions(spark):
    genome = Genome(("chr1", "chr2"), (40, 24))
    cells = [(i, j, 1.0 + (i * j) % 5) for i in range(64) for j in range(i + 1, 64)]
    cores = spark.sparkContext.defaultParallelism
    values = ModelValues(np.full((64, 2), .5), CIS[2], TRANS[2], ALPHA, BETA)
    got = []
    spark.conf.set("spark.plaidframe.broadcastBytes", "4096")  # the vectors of two tasks
    for partitions in (1, 16 * cores):
        objective = PixelObjective(pixels_frame(spark, cells).repartition(partitions), np.ones(64, bool), genome, 2)
        assert objective._parts(spark.sparkContext.broadcast(None)).rdd.getNumPartitions() <= cores
        got.append(objective.evaluate(values))
        objective.close()
    spark.conf.unset("spark.plaidframe.broadcastBytes")
    assert got[0][0] == pytest.approx(got[1][0], rel=1e-12)
    np.testing.assert_allclose(got[0][1].states, got[1][1].states, rtol=1e-9)
