"""Ordered operators that never sort a whole table in one task.

Bins are cut into blocks of consecutive ids.  Work inside a block is a window
partitioned by block; only the one-row-per-block summaries are combined across
blocks.  Value ranks and "n smallest" use the same idea on value ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import int_div
from ..session import cut

BLOCK = 4096


def _block(order: str, size: int) -> Column:
    return int_div(F.col(order), size)


def _carry(df: DataFrame, keys: Sequence[str], order: str, size: int, value: Column,
           ignore_nulls: bool) -> DataFrame:
    """Last value of the blocks before each block, one row per (keys, block)."""
    last = F.max_by(F.struct(value.alias("v")), F.when(value.isNotNull(), F.col(order))) \
        if ignore_nulls else F.max_by(F.struct(value.alias("v")), F.col(order))
    ends = (df.withColumn("__block", _block(order, size))
            .groupBy(*keys, "__block").agg(last["v"].alias("__end")))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "__block",
                       F.last("__end", ignorenulls=ignore_nulls).over(before).alias("__before"))


def forward_fill(df: DataFrame, column: str, order: str, keys: Sequence[str],
                 default: Column, size: int = BLOCK) -> DataFrame:
    """Replace NULL by the closest earlier non-NULL value within ``keys``."""
    carried = _carry(df, keys, order, size, F.col(column), True)
    upto = (Window.partitionBy(*keys, "__block").orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.withColumn("__block", _block(order, size))
            .join(carried, [*keys, "__block"])
            .withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(upto),
                                           F.col("__before"), default))
            .drop("__block", "__before"))


def previous(df: DataFrame, column: str, order: str, out: str, size: int = BLOCK) -> DataFrame:
    """Value of the preceding row in the order of ``order`` (a global ``lag``)."""
    carried = _carry(df, [], order, size, F.col(column), False)
    inside = Window.partitionBy("__block").orderBy(order)
    return (df.withColumn("__block", _block(order, size))
            .join(carried, "__block")
            .withColumn(out, F.coalesce(F.lag(column).over(inside), F.col("__before")))
            .drop("__block", "__before"))


def running_total(df: DataFrame, amount: Column, order: str, out: str, keys: Sequence[str] = (),
                  size: int = BLOCK) -> DataFrame:
    """Sum of ``amount`` over all earlier rows within ``keys`` (current row excluded)."""
    tagged = df.withColumn("__block", _block(order, size)).withColumn("__amount", amount)
    sums = tagged.groupBy(*keys, "__block").agg(F.sum("__amount").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "__block",
                          F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = (Window.partitionBy(*keys, "__block").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (tagged.join(carried, [*keys, "__block"])
            .withColumn(out, F.col("__before") + F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
            .drop("__block", "__amount", "__before"))


def compact_index(bins: DataFrame, size: int = BLOCK) -> DataFrame:
    """Consecutive index of the usable bins, ``(bin_id, index)``."""
    used = bins.where(F.col("weight").isNotNull()).select("bin_id")
    return running_total(used, F.lit(1), "bin_id", "index", size=size)


def average_rank(df: DataFrame, column: str, out: str, ranges: int = 64) -> DataFrame:
    """Rank with ties sharing their mean rank.

    Equal values are counted first, so a value held by a third of all rows is one
    row afterwards.  The distinct values are cut into ranges at approximate
    quantiles; ranks are cumulative counts inside a range plus the total below it.
    """
    counts = cut(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n")))
    cuts = counts.approxQuantile(column, [k / ranges for k in range(1, ranges)], 0.5 / ranges)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=column, outputCol="__range").transform(counts)
    ranked = running_ranges(ranged, "__range", column, F.col("__n"), "__below")
    ranks = ranked.select(column, (F.col("__below") + (F.col("__n") + 1) / 2.0).alias(out))
    return df.join(ranks, column, "left")


def running_ranges(df: DataFrame, group: str, order: str, amount: Column, out: str) -> DataFrame:
    """Running total over rows already cut into ordered ``group`` ranges."""
    tagged = df.withColumn("__amount", amount)
    sums = tagged.groupBy(group).agg(F.sum("__amount").alias("__sum"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(group, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.join(F.broadcast(carried), group)  # one row per range
            .withColumn(out, F.col("__before") + F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
            .drop("__amount", "__before"))


def last_before(marks: DataFrame, wanted: DataFrame, position: str, piece: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``wanted`` with the ``state`` of the last of ``marks`` at or before each row's ``position``, as ``last``.

    A merge instead of a range join.  States must not fall along the positions, so the largest is the last.
    ``piece`` is an expression over ``position`` that does not fall either; it cuts each of the ``keys`` into
    pieces that are merged apart.  A piece gets the last state of the pieces before it from a table with one
    row a piece.
    """
    rest = [c for c in wanted.columns if c != position and c not in keys]
    rows = wanted.select(*keys, position, F.struct(*rest, F.lit(True).alias("__wanted")).alias("__row"))
    kind = rows.schema["__row"].dataType
    both = (marks.select(*keys, position, "state", F.lit(None).cast(kind).alias("__row"))
            .unionByName(rows.withColumn("state", F.lit(None).cast(marks.schema["state"].dataType)))
            .withColumn("__piece", piece))
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (both.groupBy(*keys, "__piece").agg(F.max("state").alias("__end"))
               .select(*keys, "__piece", F.max("__end").over(earlier).alias("__carried")))
    upto = (Window.partitionBy(*keys, "__piece").orderBy(position, F.col("__row").isNotNull())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = both.join(carried, [*keys, "__piece"]).withColumn(
        "last", F.coalesce(F.max("state").over(upto), F.col("__carried")))
    return (merged.where(F.col("__row").isNotNull())
            .select(*keys, position, *[F.col("__row")[c].alias(c) for c in rest], "last"))


def smallest_by_key(df: DataFrame, key: str, n: int, total: int | None = None, digits: int = 3,
                    border_rows: int = 1_000_000) -> DataFrame:
    """Exactly the ``n`` rows with the smallest hexadecimal ``key``.

    Keys are hashes, so with the ``total`` number of rows known a filter on the key
    leaves little more than ``n`` rows; these are written once and the rest works on
    them.  Should the filter ever leave too few, the whole input is used instead.

    Counts per key prefix (4096 rows per pass) narrow down the prefix in which the
    n-th row lies until few rows share it.  Rows below that prefix are kept by a
    plain filter and only the border prefix is ordered, so no task ever sorts or
    holds the whole sample.
    """
    if n <= 0:
        return df.limit(0)
    limit = (n + 8.0 * n ** 0.5 + 64.0) / total if total else 1.0
    if limit < 0.5:
        few = cut(df.where(F.col(key) < format(int(limit * 16 ** 13), "013x")))
        if few.count() >= n:
            df = few
    taken, border = 0, ""
    while True:
        width = len(border) + digits
        inside = df.where(F.col(key).startswith(border)) if border else df
        histogram = sorted((r["p"], r["n"]) for r in inside
                           .groupBy(F.substring(key, 1, width).alias("p"))
                           .agg(F.count("*").alias("n")).collect())
        for prefix, rows in histogram:
            if taken + rows >= n:
                border = prefix
                break
            taken += rows
        else:
            return df
        if rows <= border_rows or width >= 30:
            last = df.where(F.col(key).startswith(border)).orderBy(key).limit(n - taken)
            return df.where(F.col(key) < border).unionByName(last)
