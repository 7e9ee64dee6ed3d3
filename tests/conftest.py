import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plaidframe.genome import Genome  # noqa: E402
from plaidframe.session import build_session  # noqa: E402

SMOKE = "/root/testdata/sf0.001"

# Five bins on two chromosomes with two and three states; a state that is certain and one that is excluded among them.
STATES = {
    2: np.array([[.35, .65], [.6, .4], [.92, .08], [.27, .73], [.45, .55]]),
    3: np.array([[.2, .3, .5], [.55, .15, .3], [.05, .6, .35], [0, 1, 0], [.7, 0, .3]]),
}
CIS = {2: np.array([[.55, .07], [.07, .31]]), 3: np.array([[.34, .07, 0], [.07, .26, .04], [0, .04, .18]])}
TRANS = {2: np.array([[.02, .06], [.06, .86]]), 3: np.array([[.15, .06, 0], [.06, .31, .08], [0, .08, .26]])}
ALPHA, BETA = -1.0, -1.5


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4, partitions=4)
    yield session
    session.stop()


@pytest.fixture
def five():
    return Genome(("chr1", "chr2"), (4, 1))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bins_frame(spark, genome, usable=None, weight=1.0):
    usable = [True] * genome.n_bins if usable is None else usable
    rows = []
    for k, (name, lo, n) in enumerate(zip(genome.names, genome.starts, genome.lengths)):
        rows += [(b, k, name, weight if usable[b] else None) for b in range(lo, lo + n)]
    return spark.createDataFrame(rows, "bin_id int, chrom_idx int, chrom string, weight double")


def pixels_frame(spark, cells):
    return spark.createDataFrame([(int(i), int(j), float(x)) for i, j, x in cells],
                                 "bin1_id int, bin2_id int, count double")


def states_frame(spark, states, usable=None):
    rows = [(k, [float(v) for v in p]) for k, p in enumerate(states) if usable is None or usable[k]]
    return spark.createDataFrame(rows, "bin_id int, probs array<double>")


def model_table(genome, states, cis, trans, alpha, beta, resolution=1.0):
    """Brute force: {(i, j): (G, D)} for all pairs."""
    chrom = np.repeat(np.arange(len(genome.lengths)), genome.lengths)
    out = {}
    for i in range(genome.n_bins):
        for j in range(i + 1, genome.n_bins):
            same = chrom[i] == chrom[j]
            g = states[i] @ (cis if same else trans) @ states[j]
            d = np.exp(alpha * (np.log(j - i) + np.log(resolution))) if same else np.exp(beta)
            out[i, j] = (g, d)
    return out
