"""Single-cell contact lists (tab-separated, one file per cell)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_SCHEMA = "bin1_id int, bin2_id int, count double, balanced double, chr1_name string, chr2_name string"
LABEL_SCHEMA = "filename string, line string"


def read_cells(spark: SparkSession, pattern: str) -> DataFrame:
    """Contacts of every matching file with the file name as ``cell``.

    A cell listed twice in a file takes the later value, as in repeated assignment.
    """
    raw = (spark.read.schema(CELL_SCHEMA).csv(pattern, sep="\t")
           .select("*", F.col("_metadata.file_path").alias("path"),
                   F.col("_metadata.file_block_start").alias("__start"),
                   F.monotonically_increasing_id().alias("__row")))
    a, b = F.col("bin1_id"), F.col("bin2_id")
    later = F.struct("__start", "__row")
    return (raw.groupBy("path", F.least(a, b).alias("bin1_id"), F.greatest(a, b).alias("bin2_id"))
            .agg(F.max_by("count", later).alias("count"))
            .withColumn("cell", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.gz$", "")))


def read_labels(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).csv(pattern, sep="\t")


def of_line(cells: DataFrame, labels: DataFrame, line: str | None = None) -> DataFrame:
    """Cells listed in the label file, of one cell line if given."""
    chosen = labels if line is None else labels.where(F.col("line") == line)
    return cells.join(chosen.select(F.col("filename").alias("cell")), "cell", "left_semi")


def numbered(cells: DataFrame) -> DataFrame:
    """Add ``cell_id``, a non-negative number made from the cell's name."""
    return cells.withColumn("cell_id", F.shiftrightunsigned(F.xxhash64("cell"), 1))
