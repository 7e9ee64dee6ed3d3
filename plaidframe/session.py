"""Session defaults, checkpoint location and size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_KEY = "spark.plaidframe.broadcastBytes"
BROADCAST_DEFAULT = 256 * 1024 * 1024


def build_session(app: str = "plaidframe", cpus: int | str = "*", partitions: int = 8,
                  **conf: str) -> SparkSession:
    """Local session with the settings the operators are tuned for.

    On a cluster the session comes from spark-submit; nothing here is required
    there except adaptive execution, which is on by default.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a fresh temporary folder; a
    cluster must name a folder every executor can reach.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        configured = tempfile.mkdtemp(prefix="plaidframe-ckpt-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the checkpoint directory for a written intermediate table."""
    return os.path.join(checkpoint_dir(spark), name)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_KEY, str(BROADCAST_DEFAULT)))


def may_broadcast(spark: SparkSession, rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= broadcast_limit(spark)


def sized(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast when ``rows`` rows fit the limit; otherwise leave the
    choice to Catalyst, which shuffles and lets AQE split skewed partitions."""
    if may_broadcast(df.sparkSession, rows, row_bytes):
        return F.broadcast(df)
    return df
