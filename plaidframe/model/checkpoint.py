"""Optimiser checkpoints as small Parquet rows on shared storage."""

from __future__ import annotations

import math
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .minimise import State

SCHEMA = ("iteration int, f double, x array<double>, g array<double>, "
          "steps array<array<double>>, changes array<array<double>>, saved_at double")
DEFAULT_INTERVAL = 3600.0


class OptimiserCheckpoint:
    """Appends the optimiser state at most once per ``interval`` seconds.

    The first save always writes.  Restoring takes the latest iteration; a missing
    folder means a fresh start.
    """

    def __init__(self, spark: SparkSession, path: str, interval: float = DEFAULT_INTERVAL,
                 clock=time.time):
        self.spark, self.path, self.interval, self.clock = spark, path, interval, clock
        self.last_saved = math.nan

    def save(self, state: State, force: bool = False) -> bool:
        now = self.clock()
        if not force and now - self.last_saved < self.interval:
            return False
        row = (state.iteration, state.f, state.x.tolist(), state.g.tolist(),
               [s.tolist() for s in state.steps], [y.tolist() for y in state.changes], now)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.last_saved = now
        return True

    def _location(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._location()
        return fs.exists(path)

    def remove(self) -> None:
        fs, path = self._location()
        fs.delete(path, True)

    def restore(self) -> State | None:
        if not self.exists():
            return None
        saved = self.spark.read.schema(SCHEMA).parquet(self.path)
        row = saved.orderBy(F.desc("iteration"), F.desc("saved_at")).limit(1).collect()
        if not row:
            return None
        r = row[0]
        return State(r["iteration"], np.array(r["x"]), r["f"], np.array(r["g"]),
                     [np.array(s) for s in r["steps"]], [np.array(y) for y in r["changes"]])
