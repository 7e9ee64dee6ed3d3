"""Reading and cutting a contact matrix: chromosome selection, prefix squares, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..genome import NO_YM, Genome
from ..session import sized


def chrom_lengths(chroms: DataFrame, *spec: str) -> DataFrame:
    """Chromosome lengths in bins."""
    if spec == ("all_no_ym",):
        chroms = chroms.where(~F.col("chrom").isin(*NO_YM))
    elif spec != ("all",):
        chroms = chroms.where(F.col("chrom").isin(*spec))
    return chroms.select("chrom", (F.col("hi") - F.col("lo")).alias("n_bins"))


def first_ym_bin(chroms: DataFrame) -> DataFrame:
    return chroms.where(F.col("chrom").isin(*NO_YM)).agg(F.min("lo").alias("first_bin"))


def usable_bins(bins: DataFrame, *spec: str, weight: str = "weight") -> DataFrame:
    """Usability flag of every bin of the chosen chromosomes."""
    if spec == ("all_no_ym",):
        bins = bins.where(~F.col("chrom").isin(*NO_YM))
    elif spec and spec != ("all",):
        bins = bins.where(F.col("chrom").isin(*spec))
    return bins.select("chrom", "bin_id", F.col(weight).isNotNull().alias("usable"))


def prefix_square(pixels: DataFrame, end: int) -> DataFrame:
    """Pixels with both ends below ``end``; both predicates reach the Parquet scan."""
    return pixels.where((F.col("bin1_id") < end) & (F.col("bin2_id") < end))


def block(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Rectangle of half-open bin ranges."""
    return pixels.where(F.col("bin1_id").between(rows[0], rows[1] - 1)
                        & F.col("bin2_id").between(cols[0], cols[1] - 1))


def select_chroms(pixels: DataFrame, genome: Genome, *spec: str, trans_only: bool = False) -> DataFrame:
    """Pixels among the chosen chromosomes with ids re-based to the selection.

    ``all`` and ``all_no_ym`` keep the original ids and ignore ``trans_only``.
    Offsets are cumulative lengths of the chosen chromosomes in the given order, so
    chromosomes that are not neighbours in the file stay correct.
    """
    if spec == ("all",):
        return pixels
    if spec == ("all_no_ym",):
        end = genome.first_ym_bin()
        return pixels if end is None else prefix_square(pixels, end)
    positions = genome.pick(*spec)
    chosen = genome.subset(positions)
    shift: list[int | None] = [None] * len(genome.names)
    for pos, start in zip(positions, chosen.starts):
        shift[pos] = start - genome.starts[pos]
    b1, b2 = F.col("bin1_id"), F.col("bin2_id")
    spans = [(genome.starts[p], genome.starts[p] + genome.lengths[p]) for p in positions]

    def inside(b: Column) -> Column:
        expr = F.lit(False)
        for lo, hi in spans:
            expr = expr | ((b >= lo) & (b < hi))
        return expr

    kept = pixels.where(inside(b1) & inside(b2))
    if trans_only:
        kept = kept.where(~genome.same_chrom(b1, b2))
    moved1 = b1 + genome.per_chrom(b1, shift)
    moved2 = b2 + genome.per_chrom(b2, shift)
    return (kept.withColumn("__m1", moved1).withColumn("__m2", moved2)
            .withColumn("bin1_id", F.least("__m1", "__m2").cast("int"))
            .withColumn("bin2_id", F.greatest("__m1", "__m2").cast("int"))
            .drop("__m1", "__m2"))


def select_bins(bins: DataFrame, genome: Genome, *spec: str) -> DataFrame:
    """Bin table of a selection, re-based the same way as :func:`select_chroms`."""
    positions = genome.pick(*spec)
    chosen = genome.subset(positions)
    shift: list[int | None] = [None] * len(genome.names)
    order: list[int | None] = [None] * len(genome.names)
    for k, (pos, start) in enumerate(zip(positions, chosen.starts)):
        shift[pos], order[pos] = start - genome.starts[pos], k
    b = F.col("bin_id")
    return (bins.withColumn("__shift", genome.per_chrom(b, shift))
            .where(F.col("__shift").isNotNull())
            .withColumn("chrom_idx", genome.per_chrom(b, order).cast("int"))
            .withColumn("bin_id", (b + F.col("__shift")).cast("int"))
            .drop("__shift"))


def attach_ends(pixels: DataFrame, table: DataFrame, columns: list[str], n_bins: int,
                how: str = "inner", row_bytes: int = 64) -> DataFrame:
    """Gather per-bin ``columns`` for both ends of each pixel as ``<c>1`` and ``<c>2``.

    The bin side is broadcast only while ``n_bins`` rows fit the broadcast limit;
    above it both joins shuffle and adaptive execution splits hot bins.
    """
    out = pixels
    for k in (1, 2):
        side = table.select(F.col("bin_id").alias(f"bin{k}_id"),
                            *[F.col(c).alias(f"{c}{k}") for c in columns])
        out = out.join(sized(side, n_bins, row_bytes), f"bin{k}_id", how)
    return out


def between_usable(pixels: DataFrame, bins: DataFrame, n_bins: int, weight: str = "weight") -> DataFrame:
    """Pixels whose two bins are usable."""
    good = bins.where(F.col(weight).isNotNull()).select("bin_id")
    return attach_ends(pixels, good, [], n_bins)


def balanced(pixels: DataFrame, bins: DataFrame, n_bins: int, value: str = "count",
             weight: str = "weight", out: str = "balanced") -> DataFrame:
    """``count * w1 * w2``; NULL when either bin is unusable."""
    return (attach_ends(pixels, bins, [weight], n_bins)
            .withColumn(out, F.col(value) * F.col(f"{weight}1") * F.col(f"{weight}2"))
            .drop(f"{weight}1", f"{weight}2"))


def mirrored(cells: DataFrame) -> DataFrame:
    """Both orientations of every off-diagonal cell."""
    rest = [c for c in cells.columns if c not in ("bin1_id", "bin2_id")]
    ends = F.when(F.col("bin1_id") == F.col("bin2_id"),
                  F.array(F.struct(F.col("bin1_id").alias("a"), F.col("bin2_id").alias("b")))) \
        .otherwise(F.array(F.struct(F.col("bin1_id").alias("a"), F.col("bin2_id").alias("b")),
                           F.struct(F.col("bin2_id").alias("a"), F.col("bin1_id").alias("b"))))
    return (cells.withColumn("__ends", F.explode(ends))
            .select(F.col("__ends.a").alias("bin1_id"), F.col("__ends.b").alias("bin2_id"), *rest))


def triangle(cells: DataFrame, k: int = -1) -> DataFrame:
    """Unordered cells starting at the ``k``-th diagonal (0 keeps the main one)."""
    if k > 0:
        raise ValueError("only diagonals up to the main one can be kept")
    return cells.where(F.col("bin2_id") - F.col("bin1_id") >= -k)


def extents(bins: DataFrame) -> DataFrame:
    """Chromosome extents ``(chrom_idx, chrom, lo, hi)`` from the bin table."""
    return (bins.groupBy("chrom_idx", "chrom")
            .agg(F.min("bin_id").alias("lo"), (F.max("bin_id") + 1).alias("hi")))
