"""Import of multi-resolution cooler files (HDF5); needs the optional h5py package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..genome import Genome

PIXELS_PER_TASK = 5_000_000


def _open(path: str):
    try:
        import h5py
    except ImportError as exc:
        raise RuntimeError("reading cooler files needs h5py") from exc
    return h5py.File(path, "r")


def group_name(resolution: int | None) -> str:
    return "/" if resolution is None else f"/resolutions/{resolution}"


def read_cool(spark: SparkSession, path: str, resolution: int | None = None, weight: str = "weight",
              opener=_open) -> tuple[DataFrame, DataFrame, Genome]:
    """Pixels, bins and layout.  The driver reads the chromosome table; every task
    opens the file itself and reads its own range of pixels."""
    group = group_name(resolution)
    with opener(path) as f:
        root = f[group]
        names = tuple(n.decode() if isinstance(n, bytes) else str(n) for n in root["chroms/name"][:])
        offsets = np.asarray(root["indexes/chrom_offset"][:])
        n_bins, n_pixels = len(root["bins/start"]), len(root["pixels/bin1_id"])
        has_weight = weight in root["bins"]
    genome = Genome(names, tuple(int(n) for n in np.diff(offsets)), resolution or 1)

    def reader(table: str, columns: dict[str, str], step: int):
        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with opener(path) as f:
                part = f[group][table]
                for frame in frames:
                    for lo in frame["id"] * step:
                        yield pd.DataFrame({out: np.asarray(part[name][lo:lo + step])
                                            for out, name in columns.items()})
        return read

    tasks = max(1, -(-n_pixels // PIXELS_PER_TASK))
    pixels = spark.range(0, tasks, 1, tasks).mapInPandas(
        reader("pixels", {"bin1_id": "bin1_id", "bin2_id": "bin2_id", "count": "count"}, PIXELS_PER_TASK),
        "bin1_id int, bin2_id int, count double")

    def read_bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opener(path) as f:
            part = f[group]["bins"]
            for frame in frames:
                for lo in frame["id"] * PIXELS_PER_TASK:
                    hi = min(lo + PIXELS_PER_TASK, n_bins)
                    ids = np.arange(lo, hi)
                    chrom = np.searchsorted(offsets, ids, side="right") - 1
                    w = np.asarray(part[weight][lo:hi], float) if has_weight else np.ones(hi - lo)
                    yield pd.DataFrame({
                        "bin_id": ids.astype(np.int32), "chrom_idx": chrom.astype(np.int32),
                        "chrom": [names[k] for k in chrom], "bin_start": np.asarray(part["start"][lo:hi], np.int64),
                        "bin_end": np.asarray(part["end"][lo:hi], np.int64),
                        "weight": pd.Series(w).astype(object).where(~np.isnan(w), None)})

    bin_tasks = max(1, -(-n_bins // PIXELS_PER_TASK))
    bins = spark.range(0, bin_tasks, 1, bin_tasks).mapInPandas(
        read_bins, "bin_id int, chrom_idx int, chrom string, bin_start long, bin_end long, weight double")
    return pixels, bins, genome
