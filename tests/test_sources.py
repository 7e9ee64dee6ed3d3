"""Stores, importers, the command line, components and the mixing experiment."""

import gzip
from contextlib import contextmanager

import numpy as np
import pytest
from conftest import bins_frame, frame, pixels_frame
from pyspark.sql import functions as F

from plaidframe.genome import Genome
from plaidframe.plans import cli, mixing, pca
from plaidframe.sources import fits, single_cell
from plaidframe.sources.cool import read_cool
from plaidframe.sources.dense import model_input, read_npy
from plaidframe.sources.store import ContactStore, detect_kind

GENOME = Genome(("chr1", "chr2", "chrY"), (8, 6, 2), 100)


def store(spark, path):
    rng = np.random.default_rng(0)
    cells = {tuple(sorted(map(int, p))): int(rng.integers(5, 40)) for p in rng.integers(0, 16, (150, 2))}
    out = ContactStore(spark, str(path))
    out.write(pixels_frame(spark, [(i, j, v) for (i, j), v in cells.items()]),
              bins_frame(spark, GENOME, [k != 3 for k in range(16)], 0.5), GENOME)
    return out, cells


def test_store_reads_selections(spark, tmp_path):
    out, cells = store(spark, tmp_path / "a.store")
    assert out.resolutions() == [100] and out.genome(100) == GENOME
    pixels, bins, genome = out.read("chr2", resolution=100, balance=False)
    assert {(r[0], r[1]): r[2] for r in pixels.collect()} == {
        (i - 8, j - 8): v for (i, j), v in cells.items() if 8 <= i and j < 14}
    assert bins.count() == 6 and genome.lengths == (6,)
    pixels, _, genome = out.read("all_no_ym", resolution=100)
    assert genome.names == ("chr1", "chr2")
    for i, j, v in (tuple(r) for r in pixels.select("bin1_id", "bin2_id", "count").collect()):
        assert v == (None if 3 in (i, j) else cells[i, j] * 0.25)
    plan = out.pixels(100).where("bin1_id < 5 and bin2_id < 5")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(resolution" in plan and "LessThan(bin1_id,5)" in plan
    assert detect_kind("x.mcool") == "mcool" and detect_kind("y.npy") == "numpy"
    with pytest.raises(ValueError):
        detect_kind("z.txt")


def test_dense_file(spark, tmp_path):
    m = np.arange(49, dtype=float).reshape(7, 7)
    m[2] = m[:, 2] = np.nan
    m[0, 1] = m[1, 0] = 0
    np.save(tmp_path / "m.npy", m)
    cells, n = read_npy(spark, str(tmp_path / "m.npy"), rows_per_task=3)
    assert n == 7 and cells.count() == 49 and cells.where("value is null").count() == 13
    pixels, bins = model_input(cells, n)
    got = {(r[0], r[1]): r[2] for r in pixels.where("count is not null").collect()}
    assert got == {(i, j): max(m[i, j], m[j, i]) for i in range(7) for j in range(i + 1, 7)
                   if 2 not in (i, j) and (i, j) != (0, 1)}
    assert [r["bin_id"] for r in bins.where("weight is null").collect()] == [2]


def test_single_cell_files(spark, tmp_path):
    for name, rows in (("c1", [(0, 1, 2), (1, 0, 5), (2, 2, 1)]), ("c2", [(0, 2, 4)])):
        with gzip.open(tmp_path / f"{name}.matrix.gz", "wt") as f:
            f.writelines(f"{i}\t{j}\t{v}\t0.0\tchr1\tchr1\n" for i, j, v in rows)
    (tmp_path / "lab.labeled").write_text("c1.matrix\tGM\nc2.matrix\tK\n")
    cells = single_cell.read_cells(spark, str(tmp_path / "*.matrix.gz"))
    assert sorted(tuple(r) for r in cells.select("cell", "bin1_id", "bin2_id", "count").collect()) == [
        ("c1.matrix", 0, 1, 5.0), ("c1.matrix", 2, 2, 1.0), ("c2.matrix", 0, 2, 4.0)]
    labels = single_cell.read_labels(spark, str(tmp_path / "*.labeled"))
    assert single_cell.of_line(cells, labels, "K").count() == 1 and single_cell.of_line(cells, labels).count() == 3
    assert single_cell.numbered(cells).where("cell_id < 0").count() == 0


def test_cooler_layout_with_a_stand_in_file(spark):
    # defined here so that tasks receive them by value
    class Group(dict):
        def __getitem__(self, key):
            if key in self:
                return dict.__getitem__(self, key)
            return Group({k[len(key) + 1:]: v for k, v in self.items() if k.startswith(key + "/")})

    @contextmanager
    def fake_opener(path):
        base = {"chroms/name": np.array([b"chr1", b"chr2"]), "indexes/chrom_offset": np.array([0, 2, 3]),
                "bins/start": np.array([0, 10, 0]), "bins/end": np.array([10, 20, 10]),
                "bins/weight": np.array([0.5, np.nan, 2.0]), "pixels/bin1_id": np.array([0, 0, 2]),
                "pixels/bin2_id": np.array([0, 2, 2]), "pixels/count": np.array([3, 4, 5])}
        yield Group({f"/resolutions/10/{k}": v for k, v in base.items()})

    pixels, bins, genome = read_cool(spark, "x.mcool", 10, opener=fake_opener)
    assert genome == Genome(("chr1", "chr2"), (2, 1), 10)
    assert sorted(tuple(r) for r in pixels.collect()) == [(0, 0, 3.0), (0, 2, 4.0), (2, 2, 5.0)]
    assert [r["weight"] for r in bins.orderBy("bin_id").collect()] == [0.5, None, 2.0]


def test_command_line(spark, tmp_path, capsys):
    out, cells = store(spark, tmp_path / "a.store")
    src = ["-m", str(tmp_path / "a.store")]
    base = ["fit", *src, "-ch", "chr1,chr2", "-kb", "100", "-n", "2", "--iterations", "2", "--seed", "1", "2",
            "--optimize-args", "maxiter=2"]
    cli.main([*base, "-o", str(tmp_path / "fits/dense")], spark)
    cli.main([*base, "-o", str(tmp_path / "fits/sparse"), "--sparse", "--zero-sample", "10", "-s", "symmetric,none"], spark)
    assert cli.main([*base, "-o", str(tmp_path / "fits/dense"), "--no-overwrite"], spark) is None
    best = cli.main(["best", str(tmp_path / "fits"), "-n", "1", "-t", str(tmp_path / "top{n}")], spark)
    assert len(best) == 1 and fits.load(spark, str(tmp_path / "top1")).n_states == 2
    cli.main(["stretch", "-f", str(tmp_path / "top1"), "-r", "2", "-o", str(tmp_path / "fine")], spark)
    assert fits.load(spark, str(tmp_path / "fine")).genome.lengths == (16, 12)
    cli.main(["resample", "-f", str(tmp_path / "top1"), "--reads", "500", "-o", str(tmp_path / "r.store"), "--balance", "no"], spark)
    assert ContactStore(spark, str(tmp_path / "r.store")).pixels().agg(F.sum("count")).first()[0] == 500
    cli.main(["downsample", *src, "-s", "0.5", "-r", "100", "-o", str(tmp_path / "d.store"), "--balance", "no"], spark)
    total = sum(v for (i, j), v in cells.items() if i < j)
    assert ContactStore(spark, str(tmp_path / "d.store")).pixels().agg(F.sum("count")).first()[0] == total // 2
    thinned = ContactStore(spark, str(tmp_path / "d.store"))
    assert {r.weight for r in thinned.bins().collect()} <= {1.0, None}
    raw = {(r[0], r[1]): r[2] for r in thinned.pixels().collect()}
    for r in thinned.read("all", balance="weight")[0].collect():  # what is stored is what a later fit reads
        assert r["count"] is None or r["count"] == raw[r[0], r[1]]
    meta = cli.main(["datafile", str(tmp_path / "top1"), "--set", "a=1,b=x", "--parameters"], spark)
    assert meta["a"] == 1 and meta["b"] == "x"


@pytest.mark.parametrize("limit", ["268435456", "64"])
def test_first_component(spark, limit):
    rng = np.random.default_rng(1)
    c = np.corrcoef(rng.normal(size=(12, 20)))
    df = frame(spark, [(i, j, float(c[i, j])) for i in range(12) for j in range(i, 12)], "bin1_id int, bin2_id int, correlation double")
    spark.conf.set("spark.plaidframe.broadcastBytes", limit)
    got = np.array([r["score"] for r in pca.first_component(df).orderBy("bin_id").collect()])
    spark.conf.unset("spark.plaidframe.broadcastBytes")
    centred = c - c.mean(axis=0)
    u, s, _ = np.linalg.svd(centred)
    want = u[:, 0] * s[0]
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert abs(abs(got @ want) - want @ want) < 1e-8


def test_row_correlation(spark):
    rng = np.random.default_rng(2)
    m = np.triu(rng.integers(0, 3, (14, 14)).astype(float), 1)
    m += m.T
    df = frame(spark, [(i, j, float(m[i, j])) for i in range(14) for j in range(i + 1, 14) if m[i, j]], "bin1_id int, bin2_id int, value double")
    usable = frame(spark, [(k,) for k in range(14)], "bin_id int")
    for rows, cols in ((4, 5), (256, 4096)):
        products = {(r[0], r[1]): r[2] for r in pca.row_products(df, 14, rows=rows, cols=cols).collect()}
        want = m @ m.T
        assert all(products.get((i, j), 0) == want[i, j] for i in range(14) for j in range(i, 14))
    got = pca.row_correlation(df, usable, 14).collect()
    want = np.corrcoef(m)
    assert len(got) == 14 * 15 // 2
    assert all(r["correlation"] == pytest.approx(want[r["bin1_id"], r["bin2_id"]]) for r in got)


def test_row_correlation_exchanges_cells_only(spark):
    rng = np.random.default_rng(4)
    m = np.triu((rng.random((60, 60)) < .1) * rng.normal(3, 1, (60, 60)), 1)
    i, j = np.nonzero(m)
    df = frame(spark, [(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], "bin1_id int, bin2_id int, value double")
    out = pca.row_correlation(df, spark.range(60).select(F.col("id").cast("int").alias("bin_id")), 60)
    assert "Join" not in out._jdf.queryExecution().toString()
    full = m + m.T
    held = np.flatnonzero(full.any(axis=1))
    got = {(r["bin1_id"], r["bin2_id"]): r["correlation"] for r in out.collect()}
    want = np.corrcoef(full)
    assert set(got) == {(a, b) for a in held for b in held if a <= b}
    assert all(v == pytest.approx(want[k], abs=1e-12) for k, v in got.items())


def test_compartments_make_no_square_matrix(spark, monkeypatch):
    from pyspark.mllib.linalg.distributed import RowMatrix

    def refuse(*_):
        raise AssertionError("square matrix or long vectors")
    monkeypatch.setattr(RowMatrix, "computeGramianMatrix", refuse)
    monkeypatch.setattr(RowMatrix, "computeSVD", refuse)
    rng = np.random.default_rng(5)
    m = np.triu(rng.integers(0, 4, (40, 40)).astype(float), 1)
    df = frame(spark, [(i, j, float(m[i, j])) for i in range(40) for j in range(i + 1, 40) if m[i, j]], "bin1_id int, bin2_id int, value double")
    usable = spark.range(40).select(F.col("id").cast("int").alias("bin_id"))
    correlation, scores = pca.compartments(df, usable, 40)
    c = np.zeros((40, 40))
    for r in correlation.collect():
        c[r["bin1_id"], r["bin2_id"]] = c[r["bin2_id"], r["bin1_id"]] = r["correlation"]
    u, s, _ = np.linalg.svd(c - c.mean(axis=0))
    got = np.array([r["score"] for r in scores.orderBy("bin_id").collect()])
    np.testing.assert_allclose(np.abs(got), np.abs(u[:, 0] * s[0]), atol=1e-6)


@pytest.mark.parametrize("most", [24, 512])
def test_leading_vector(most):
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(300, 300)))
    values = np.sort(rng.random(300))
    values[-1] += .05
    a = (q * values) @ q.T
    got = pca.leading_vector(lambda v: a @ v, 300, most)
    assert abs(got @ q[:, -1]) == pytest.approx(1, abs=1e-12)
    assert abs(pca.leading_vector(lambda v: 0 * v, 5, most) @ np.ones(5)) <= 3


def test_component_takes_one_pass_a_step(spark, monkeypatch):
    """a step is one pass over the stored cells with two vectors, not four with eight."""
    rng = np.random.default_rng(8)
    m = np.triu((rng.random((50, 50)) < .3) * rng.normal(3, 1, (50, 50)), 1)
    i, j = np.nonzero(m)
    df = frame(spark, [(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], "bin1_id int, bin2_id int, value double")
    packed = pca.packed_rows(df, "value").localCheckpoint()
    rows, v = pca._Rows(packed), rng.normal(size=(50, 3))
    np.testing.assert_allclose(rows.square_times(v), (m + m.T) @ ((m + m.T) @ v), atol=1e-9)
    passes, run = [], pca._Rows._run
    monkeypatch.setattr(pca._Rows, "_run", lambda self, vectors, multiply: passes.append(vectors.shape[1]) or run(self, vectors, multiply))
    got = np.array([r["score"] for r in pca._first_of_rows(packed, 50.0).orderBy("bin_id").collect()])
    c = np.corrcoef(m + m.T)
    u, s, _ = np.linalg.svd(c - c.mean(axis=0))
    np.testing.assert_allclose(np.abs(got), np.abs(u[:, 0] * s[0]), atol=1e-6)
    assert max(passes) <= 2 and len(passes) <= 26


@pytest.mark.parametrize("most", [48, 1024])
def test_leading_of_centred(most):
    m = np.corrcoef(np.random.default_rng(9).normal(size=(300, 300)))
    u, s, _ = np.linalg.svd(m - m.mean(axis=0))
    got = m @ pca.leading_of_centred(lambda v: m @ v, 300, most)
    np.testing.assert_allclose(np.abs(got - got.mean()), np.abs(u[:, 0] * s[0]), atol=1e-7)
    assert abs(pca.leading_of_centred(lambda v: 0 * v, 5, most) @ np.ones(5)) <= 3


def test_component_accuracy_of_the_data_with_itself(spark):
    rng = np.random.default_rng(3)
    cells = frame(spark, [(i, j, float(rng.integers(1, 20))) for i in range(12) for j in range(i, 12)], "bin1_id int, bin2_id int, value double")
    usable = frame(spark, [(k,) for k in range(12)], "bin_id int")
    row = pca.accuracy(cells, usable, cells, 12).first()
    assert row["mean_diff"] == pytest.approx(0, abs=1e-9) and -1 <= row["gc_spearman"] <= 1


def test_mixing_scores(spark):
    states = frame(spark, [(k, [0.6 if k < 5 else 0.1, 0.4 if k < 5 else 0.9]) for k in range(10)], "bin_id int, probs array<double>")
    a = mixing.row_group(states, F.col("probs")[0] > 0.5)
    assert sorted(r[0] for r in mixing.row_group(states, F.col("probs")[0] > 0.5, 2, [1]).collect()) == [0, 2]
    rng = np.random.default_rng(0)
    m = np.triu(rng.integers(1, 9, (10, 10)))
    cells = frame(spark, [(i, j, float(m[i, j])) for i in range(10) for j in range(i, 10)], "bin1_id int, bin2_id int, value double")
    columns = frame(spark, [(k,) for k in range(10) if k != 7], "bin_id int")
    groups = mixing.labelled({"a": a, "b": mixing.row_group(states, F.col("probs")[0] < 0.5)})
    profiles = mixing.read_profiles(cells, groups, columns, ["a", "b"], margin=1)
    full = m + np.triu(m, 1).T
    rows = full[:5].astype(float)
    for i in range(5):
        rows[i, max(0, i - 1):i + 2] = 0
    want = rows.sum(axis=0)[[k for k in range(10) if k != 7]]
    want = want / want.sum() + 1e-10
    got = [r["p"] for r in profiles.where("profile = 'a'").orderBy("col").collect()]
    np.testing.assert_allclose(got, want / want.sum(), rtol=1e-12)
    reads = frame(spark, [(1, 0, 3), (1, 8, 200)], "cell_id long, col int, count long")
    import math
    p = {r["col"]: r["p"] for r in profiles.where("profile = 'a'").collect()}
    score = mixing.profile_scores(reads, profiles).where("profile = 'a'").first()["score"]
    exact = math.lgamma(204) - math.lgamma(4) - math.lgamma(201) + 3 * math.log(p[0]) + 200 * math.log(p[8])
    assert score == pytest.approx(exact, rel=1e-12)


def test_bins_of_a_thinned_and_balanced_matrix(spark):
    bins = spark.createDataFrame([(0, "c", 0.5), (1, "c", 2.0), (2, "c", None), (3, "c", 3.0)], "bin_id int, chrom string, weight double")
    thin = spark.createDataFrame([(0, 1, 1.25), (1, 1, 0.5), (3, 3, None)], "bin1_id int, bin2_id int, count double")
    told = lambda flag: {r.bin_id: r.weight for r in cli.thinned_bins(thin, bins, flag).collect()}
    assert told(True) == {0: 1.0, 1: 1.0, 2: None, 3: None}
    assert told(False) == {0: 1.0, 1: 1.0, 2: None, 3: 1.0}


def test_missing_cells_survive_balancing(spark):
    from plaidframe.operators.balance import balance
    cells = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0), (1, 2, 5.0), (0, 0, None), (2, 3, None), (3, 3, 0.0)],
                                  "bin1_id int, bin2_id int, value double")
    got = {(r[0], r[1]): r[2] for r in balance(cells, 4).collect()}
    assert {k for k, v in got.items() if v is None} == {(0, 0), (2, 3), (3, 2)}
    assert len(got) == 9 and all(v > 0 for k, v in got.items() if v is not None)
