"""Derived tables at sizes beyond the small test tables."""

from plaidframe.plans.contact_data import RESOLUTION, ContactData


def test_starts_of_bins_far_down_a_chromosome(spark, tmp_path):
    top = 119_999  # 120,000 bins, 48,000 of them on the first chromosome: starts beyond 32 bits
    rows = {"part": ([(0, 30, 900.0), (47_999, 30, 900.0), (top, 30, 900.0)], "p_partkey long, p_size int, p_retailprice double"),
            "embeddings": ([(0, [0.5]), (top, [0.5])], "vec_id long, embedding array<float>"),
            "lineitem": ([(0, 0, 0, 1), (top, top, 0, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    bins = ContactData(spark, str(tmp_path)).bins()
    got = {r["bin_id"]: (r["bin_start"], r["bin_end"]) for r in bins.collect()}
    assert got == {0: (0, RESOLUTION), 47_999: (47_999 * RESOLUTION, 48_000 * RESOLUTION),
                   top: ((top - 108_000) * RESOLUTION, (top - 107_999) * RESOLUTION)}
    assert dict(bins.dtypes)["bin_start"] == dict(bins.dtypes)["bin_end"] == "bigint"
