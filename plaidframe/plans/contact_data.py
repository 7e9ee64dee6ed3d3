"""Contact-matrix tables derived from the star-schema tables.

Loci are parts in key order, cut into as many bins as there are embedding vectors;
every order line is one read between the bin of its part and a bin on the scaled
order axis.  Bins, pixels, state vectors, single cells and fit scores therefore all
grow with the tables, and each table is used whole.
"""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import int_div
from ..genome import Genome

# Free choices: chromosome borders in tenths of the genome and the model parameters.
CHROMS = (("chr1", 0), ("chr2", 4), ("chrX", 7), ("chrY", 9))
RESOLUTION = 50_000
CIS_WEIGHTS = np.array([[0.36, 0.08, 0.02], [0.08, 0.24, 0.06], [0.02, 0.06, 0.3]])
TRANS_WEIGHTS = np.array([[0.12, 0.04, 0.1], [0.04, 0.28, 0.05], [0.1, 0.05, 0.33]])
ALPHA, BETA = -0.8, -2.1
N_STATES = 3


class ContactData:
    """Derived tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sizes(self) -> tuple[int, int, int, int]:
        """(bin width in parts, bins, vectors, orders): four numbers from three tables."""
        highest = [self.table(table).agg(F.lit(k).alias("k"), F.max(column).alias("top")) for k, (table, column)
                   in enumerate((("part", "p_partkey"), ("embeddings", "vec_id"), ("lineitem", "l_orderkey")))]
        rows = reduce(DataFrame.unionByName, highest).collect()  # three rows, one job
        parts, vectors, orders = (r["top"] + 1 for r in sorted(rows))
        width = max(1, -(-parts // vectors))
        return width, (parts - 1) // width + 1, vectors, orders

    @cached_property
    def genome(self) -> Genome:
        n = self.sizes[1]
        lows = [n * tenth // 10 for _, tenth in CHROMS] + [n]
        return Genome(tuple(name for name, _ in CHROMS),
                      tuple(b - a for a, b in zip(lows[:-1], lows[1:])), RESOLUTION)

    @property
    def n_bins(self) -> int:
        return self.genome.n_bins

    def chroms(self) -> DataFrame:
        return self.genome.frame(self.spark)

    def bins(self) -> DataFrame:
        """Bin table; bins whose parts are unusually small in size are unusable."""
        width = self.sizes[0]
        size_score = (F.avg("p_size") - 25.5) * F.sqrt(F.count("*"))
        per_bin = (self.table("part")
                   .groupBy(int_div(F.col("p_partkey"), width).alias("bin_id"))
                   .agg(F.when(size_score >= -23.0, F.lit(1000.0) / F.avg("p_retailprice")).alias("weight")))
        b = F.col("bin_id")
        start = (b - self.genome.start_of(b)).cast("long") * RESOLUTION
        return per_bin.select(
            "bin_id", self.genome.chrom_of(b).alias("chrom_idx"),
            self.genome.per_chrom(b, list(self.genome.names)).alias("chrom"),
            start.alias("bin_start"), (start + RESOLUTION).alias("bin_end"), "weight")

    def contacts(self) -> DataFrame:
        """One row per read with the columns that name its replicate and cell."""
        width, n, _, orders = self.sizes
        a = int_div(F.col("l_partkey"), width)
        b = int_div(F.col("l_orderkey") * F.lit(n), orders)
        return self.table("lineitem").select(
            F.least(a, b).alias("bin1_id"), F.greatest(a, b).alias("bin2_id"),
            F.col("l_linenumber").alias("replicate"), F.col("l_suppkey").alias("cell_id"))

    def pixels(self) -> DataFrame:
        return self.contacts().groupBy("bin1_id", "bin2_id").agg(F.count("*").alias("count"))

    def replicate_pixels(self) -> DataFrame:
        """Pixels per replicate, so that a cell repeats once per replicate."""
        return (self.contacts().groupBy("bin1_id", "bin2_id", "replicate")
                .agg(F.count("*").alias("count")))

    def half_pixels(self) -> DataFrame:
        """All replicates in two halves: 1 for the odd ones, 2 for the even ones."""
        half = F.when(F.col("replicate") % 2 == 1, 1).otherwise(2)
        return (self.replicate_pixels().groupBy("bin1_id", "bin2_id", half.alias("replicate"))
                .agg(F.sum("count").alias("count")))

    def cell_pixels(self) -> DataFrame:
        return (self.contacts().groupBy("cell_id", "bin1_id", "bin2_id")
                .agg(F.count("*").alias("count")))

    def all_states(self) -> DataFrame:
        """State vector of every bin from the embeddings that fall into it; component k counts for state k modulo N_STATES."""
        _, n, vectors, _ = self.sizes
        e = F.col("embedding")

        def folded(s: int) -> Column:
            places = F.sequence(F.lit(s + 1), F.size(e), F.lit(N_STATES))
            return F.abs(F.aggregate(places, F.lit(0.0), lambda total, k: total + F.element_at(e, k).cast("double")))

        level = [F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.avg(folded(s)))) for s in range(N_STATES)]
        per_bin = (self.table("embeddings")
                   .groupBy(int_div(F.col("vec_id") * F.lit(n), vectors).alias("bin_id"))
                   .agg(*[c.alias(f"e{k}") for k, c in enumerate(level)]))
        total = sum((F.col(f"e{k}") for k in range(1, N_STATES)), F.col("e0"))
        return per_bin.select("bin_id", F.array(*[F.col(f"e{k}") / total for k in range(N_STATES)]).alias("probs"))

    def states(self) -> DataFrame:
        """State vectors of the usable bins."""
        good = self.bins().where("weight is not null").select("bin_id")
        return self.all_states().join(good, "bin_id", "left_semi")

    def fits(self) -> DataFrame:
        """A registry of scored fits."""
        return self.table("supplier").select(F.col("s_suppkey").alias("fit_id"),
                                             F.col("s_acctbal").alias("optimize_value"))
