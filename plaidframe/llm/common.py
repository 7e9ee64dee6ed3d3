"""Shared parts of the text operators: reading, column helpers, Arrow maps, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column | str) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def running_sum(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column],
                amounts: dict[str, Column]) -> DataFrame:
    """Sums of ``amounts`` (by name of the new column) over the earlier rows of the same ``keys``.

    ``block`` must not decrease along ``order``.  Rows are windowed within a block
    only; the sums of the blocks before are added from a table with one row a block,
    so a key that holds a third of all rows is spread over as many tasks as blocks.
    Keys and blocks must not be null.
    """
    parts = {f"__amount_{name}": amount for name, amount in amounts.items()}
    tagged = df.withColumn("__block", block).withColumns(parts)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = (tagged.groupBy(*keys, "__block").agg(*[F.sum(c).alias(c) for c in parts])
            .select(*keys, "__block", *[F.coalesce(F.sum(f"__amount_{n}").over(before), F.lit(0)).alias(f"__before_{n}")
                                        for n in amounts]))
    inside = (Window.partitionBy(*keys, "__block").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    joined = tagged.join(sums, [*keys, "__block"]).withColumns(
        {n: F.col(f"__before_{n}") + F.coalesce(F.sum(f"__amount_{n}").over(inside), F.lit(0)) for n in amounts})
    return joined.drop("__block", *parts, *[f"__before_{n}" for n in amounts])


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def append(df: DataFrame, ddl: str, inputs: Sequence[str],
           function: Callable[[list[pa.Array]], list[pa.Array]]) -> DataFrame:
    """``df`` with columns that ``function`` makes from the ``inputs`` of each Arrow batch.

    No shuffle: rows keep their place.  A column of ``df`` with the name of a new one
    is replaced.
    """
    new = fields(ddl)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType(kept + new)
    positions = [df.columns.index(c) for c in inputs]
    through = [k for k, f in enumerate(df.schema.fields) if f.name.lower() not in names]
    labels = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function([batch.column(k) for k in positions])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in through], *made], names=labels)

    return df.mapInArrow(run, schema)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column as ``(first, end, offsets, bytes)``, about ``limit`` bytes each.

    A single longer text is a run of its own.  Nulls count as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, at[first:end + 1] - at[first], raw[at[first]:at[end]]
        first = end


_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RANDOM.integers(0, 1 << 63, (64, 256), dtype=np.uint64).ravel()
_ODD = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs ``raw[starts:ends]``, which must not be empty or overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] = 1
    np.add.at(inside, ends, -1)
    member = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    lengths = ends - starts
    position = np.arange(int(lengths.sum()), dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    position -= np.repeat(first, lengths)
    value = _TABLE[((position & 63) << 8) | raw[member]]
    if lengths.max() > 64:
        value = value * (((position >> 6) << 1) | 1).astype(np.uint64)
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _ODD[0])


def spaced_words(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every white-space word (A-Z lower-cased) and, per row, the first word's index.

    The second array has one entry more than there are rows.
    """
    folded = FOLD[raw]
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = ~_SPACE[folded]
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | border))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | border))
    return hash_runs(folded, starts, ends), np.searchsorted(starts, offsets)
