"""Catalogued queries against SQL on the smallest tables.

A part of the catalogue runs by default; ``PLAIDFRAME_ALL=1`` runs all of it.
"""

import os

import pytest
from conftest import SMOKE
from oracle import compare, connect

import __spark_entry__ as entry

SOME = ["reordered_chroms_rebased", "dedup_first", "symmetrise_max_no_diag", "coarsen", "stretch_fit_ffill",
        "distance_normalised", "balance_k_passes", "generate_slice", "zero_counts_both", "zero_sample_keyed",
        "sparse_log_likelihood", "downsample_keyed", "likelihood_ratio", "mixed_log_ratio", "top_n_fits"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SMOKE):
        pytest.skip("no test tables")
    return connect(SMOKE)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("PLAIDFRAME_ALL") else SOME)
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SMOKE) == ""


def test_every_statement_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["bin1_id", "bin2_id", "balanced", "normalised"]
