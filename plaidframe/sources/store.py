"""Contact matrices as Parquet: bins, pixels and chromosomes, split by resolution.

Pixels are range-partitioned and sorted by their two bins, so row-group statistics
let prefix and chromosome reads skip most files, and a heavily used bin spans
several files instead of making one huge one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..genome import Genome
from ..operators.select import balanced, select_bins, select_chroms
from ..schema import require


class ContactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, pixels: DataFrame, bins: DataFrame, genome: Genome, resolution: int | None = None,
              mode: str = "append", files: int | None = None) -> None:
        """Add one resolution (``None``: the genome's own)."""
        res = F.lit(int(resolution or genome.resolution))
        require(pixels, "bin1_id", "bin2_id", "count")
        require(bins, "bin_id", "chrom_idx", "chrom", "weight")
        order = ["bin1_id", "bin2_id"]
        spread = pixels.repartitionByRange(files, *order) if files else pixels.repartitionByRange(*order)
        for name, frame in (("pixels", spread.sortWithinPartitions(*order)), ("bins", bins),
                            ("chroms", genome.frame(self.spark))):
            frame.withColumn("resolution", res).write.mode(mode).partitionBy("resolution").parquet(
                f"{self.root}/{name}")

    def _read(self, name: str, resolution: int | None) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.root}/{name}")
        if resolution is None:
            return frame.drop("resolution")
        return frame.where(F.col("resolution") == resolution).drop("resolution")

    def resolutions(self) -> list[int]:
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.root}/chroms").select("resolution").distinct().collect())

    def genome(self, resolution: int | None = None) -> Genome:
        chroms = self._read("chroms", resolution)
        return Genome.from_frame(chroms, resolution or self.resolutions()[0])

    def pixels(self, resolution: int | None = None) -> DataFrame:
        return self._read("pixels", resolution)

    def bins(self, resolution: int | None = None) -> DataFrame:
        return self._read("bins", resolution)

    def read(self, *spec: str, resolution: int | None = None, balance: str | bool = "weight",
             trans_only: bool = False) -> tuple[DataFrame, DataFrame, Genome]:
        """Pixels, bins and layout of a chromosome selection.

        ``balance`` names the weight column; the pixel value is then the balanced
        count.  ``False`` keeps raw counts.
        """
        genome = self.genome(resolution)
        pixels, bins = self.pixels(resolution), self.bins(resolution)
        column = "weight" if balance is True else balance
        if column and column != "weight":
            bins = bins.drop("weight").withColumnRenamed(column, "weight")
        if column:
            pixels = (balanced(pixels, bins, genome.n_bins)
                      .select("bin1_id", "bin2_id", F.col("balanced").alias("count")))
        positions = genome.pick(*spec)
        chosen = select_chroms(pixels, genome, *spec, trans_only=trans_only)
        kept = select_bins(bins, genome, *[genome.names[k] for k in positions])
        return chosen, kept, genome.subset(positions)


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; built and written there first if it does not exist."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location):
        build().write.parquet(path)
    return spark.read.parquet(path)


def detect_kind(path: str) -> str:
    """Source type from the suffix of a file or folder name."""
    for suffix, kind in ((".mcool", "mcool"), (".cool", "mcool"), (".npy", "numpy"), (".parquet", "store"),
                         (".store", "store")):
        if path.rstrip("/").endswith(suffix):
            return kind
    raise ValueError(f"cannot tell the type of {path!r}")
