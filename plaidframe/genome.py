"""Chromosome layout: a small driver-side dimension (one entry per chromosome).

Everything per bin or per pixel is a DataFrame; only the handful of chromosome
names and lengths lives here, so that chromosome tests on pixels become plain
column expressions and need no join.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHROM_SCHEMA = "chrom_idx int, chrom string, lo int, hi int"
# Spellings of the sex/mitochondrial chromosomes left out by "all_no_ym".
NO_YM = ("chrY", "chrM", "Y", "M")


@dataclass(frozen=True)
class Genome:
    names: tuple[str, ...]
    lengths: tuple[int, ...]
    resolution: int = 1

    def __post_init__(self):
        if len(self.names) != len(self.lengths):
            raise ValueError("one length per chromosome is required")

    @classmethod
    def from_frame(cls, chroms: DataFrame, resolution: int = 1) -> "Genome":
        rows = sorted(chroms.select("chrom_idx", "chrom", "lo", "hi").collect())
        return cls(tuple(r.chrom for r in rows), tuple(r.hi - r.lo for r in rows), resolution)

    @classmethod
    def single(cls, n_bins: int, resolution: int = 1) -> "Genome":
        return cls(("chr1",), (n_bins,), resolution)

    @property
    def starts(self) -> tuple[int, ...]:
        return tuple(accumulate(self.lengths, initial=0))[:-1]

    @property
    def n_bins(self) -> int:
        return sum(self.lengths)

    def extent(self, name: str) -> tuple[int, int]:
        pos = self.index(name)
        return self.starts[pos], self.starts[pos] + self.lengths[pos]

    def index(self, name: str) -> int:
        if name not in self.names:
            raise KeyError(f"unknown chromosome {name!r}")
        return self.names.index(name)

    def pick(self, *spec: str) -> list[int]:
        """Positions named by ``all``, ``all_no_ym`` or a list of names."""
        if spec == ("all",):
            return list(range(len(self.names)))
        if spec == ("all_no_ym",):
            return [k for k, name in enumerate(self.names) if name not in NO_YM]
        return [self.index(name) for name in spec]

    def first_ym_bin(self) -> int | None:
        """First bin of the excluded chromosomes, where a prefix read stops."""
        found = [self.extent(name)[0] for name in self.names if name in NO_YM]
        return min(found) if found else None

    def subset(self, positions: list[int]) -> "Genome":
        return Genome(tuple(self.names[k] for k in positions),
                      tuple(self.lengths[k] for k in positions), self.resolution)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, name, lo, lo + size) for k, (name, lo, size)
                in enumerate(zip(self.names, self.starts, self.lengths))]
        return spark.createDataFrame(rows, CHROM_SCHEMA)

    def chrom_of(self, bin_col: Column) -> Column:
        """Chromosome index of a bin, as an expression (no range join)."""
        return self._by_chrom(bin_col, list(range(len(self.names))))

    def start_of(self, bin_col: Column) -> Column:
        return self._by_chrom(bin_col, list(self.starts))

    def end_of(self, bin_col: Column) -> Column:
        return self._by_chrom(bin_col, [a + b for a, b in zip(self.starts, self.lengths)])

    def per_chrom(self, bin_col: Column, values: list) -> Column:
        """Look a per-chromosome constant up by bin; ``None`` gives NULL."""
        return self._by_chrom(bin_col, values)

    def _by_chrom(self, bin_col: Column, values: list) -> Column:
        if len(values) > 64:  # many contigs: one array lookup instead of a long CASE
            starts = F.array(*[F.lit(s) for s in self.starts])
            pos = F.size(F.filter(starts, lambda s: s <= bin_col))
            return F.element_at(F.array(*[F.lit(v) for v in values]), pos)
        expr = F.lit(values[-1])
        for start, value in reversed(list(zip(self.starts[1:], values[:-1]))):
            expr = F.when(bin_col < start, F.lit(value)).otherwise(expr)
        return expr

    def same_chrom(self, a: Column, b: Column) -> Column:
        return self.chrom_of(a) == self.chrom_of(b)

    def coarsened(self, factor: int) -> "Genome":
        return Genome(self.names, tuple(-(-size // factor) for size in self.lengths),
                      self.resolution * factor)
