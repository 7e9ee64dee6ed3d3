"""Dense ``.npy`` matrices as long tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import bins_with_values, preprocessed

CELL_SCHEMA = "bin1_id int, bin2_id int, value double"


def read_npy(spark: SparkSession, path: str, rows_per_task: int = 256) -> tuple[DataFrame, int]:
    """Every cell of a square matrix, NaN as NULL.

    The file is memory-mapped by the tasks, each of which reads its own rows; the path
    must be visible to all executors.
    """
    n = int(np.load(path, mmap_mode="r", allow_pickle=False).shape[0])

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = np.load(path, mmap_mode="r", allow_pickle=False)
        for frame in frames:
            for lo in frame["id"] * rows_per_task:
                part = np.asarray(matrix[lo:lo + rows_per_task], dtype=float)
                i, j = np.indices(part.shape)
                yield pd.DataFrame({"bin1_id": (i.ravel() + lo).astype(np.int32),
                                    "bin2_id": j.ravel().astype(np.int32), "value": part.ravel()})

    tasks = -(-n // rows_per_task)
    raw = spark.range(0, tasks, 1, tasks).mapInPandas(cells, CELL_SCHEMA)
    return raw.withColumn("value", F.when(~F.isnan("value"), F.col("value"))), n


def model_input(cells: DataFrame, n_bins: int) -> tuple[DataFrame, DataFrame]:
    """Pixels and bin table for a fit: symmetrised, diagonal and zero cells dropped,
    missing cells kept as NULL.  A bin is usable when it has a value off the diagonal."""
    clean = preprocessed(cells).where("bin1_id < bin2_id")
    good = bins_with_values(clean).select("bin_id", F.lit(1.0).alias("weight"))
    bins = (cells.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin_id"))
            .join(good, "bin_id", "left"))
    pixels = clean.where("value is null or value <> 0").withColumnRenamed("value", "count")
    return pixels, bins
