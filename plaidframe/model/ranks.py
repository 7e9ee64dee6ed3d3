"""Rank correlation of a sparse matrix with a model whose cells are never rows.

A tile, a pair of blocks of state vectors with the data stored there, makes its model values in memory.
A first pass counts them by leading bits of the number; classes with too many are counted again by more
bits.  Classes in a row make ranges of about equal numbers of values.  A second pass sends each range its
values, packed, equal ones of a batch once with their number, and stored cells apart; a range sorts what it gets and
returns sums of ranks within the range: in all, and for each data value.  Offsets of ranges and ranks of data values are
then running totals over one row a range and one row a distinct data value.  Zero cells of the data are one
value with a weight.

Above ``EXCHANGED`` pairs no value is exchanged.  What the stored cells need of the others is how many lie below each, so
the cells' values and the weights of their data go to all tasks, a slice at a time, and a tile adds up in memory the
weight above each of its values.  Ranks of all pairs are needed for their variance only, which is known but for ties:
values that a share ``RARE`` of the pairs or more have are counted to the last bit, fewer ties than that change the
variance by less than RARE ** 2, so the correlation by less than one in 10 ** 11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_ranges
from ..operators.select import between_usable
from ..session import cut, sized
from .mass import Model
from .moments import block_of, by_distance, tile_matrix, tiles

TILE = 1024
RANGE = 1 << 22  # values of a range
FIRST, MORE, LAST = 24, 6, 64  # leading bits of a first count, further bits of each count after it, all bits
PIECES = 1 << 20  # rows of a count on the driver
EXCHANGED = 1 << 27  # pairs whose values are exchanged, eight bytes each
RARE = 2.0 ** -18  # share of the pairs
TIED_FIRST, TIED_HELD = 28, 1 << 23  # leading bits of a first count of ties, classes that a task counts at a time


def with_data(model: Model, pixels: DataFrame, value: str, size: int = TILE) -> DataFrame:
    """Tiles with the data stored in them: places of both ends and values."""
    genome = model.genome
    usable = model.states.select("bin_id", F.lit(1.0).alias("weight"))
    stored = between_usable(pixels.where("bin1_id < bin2_id").select("bin1_id", "bin2_id", F.col(value).cast("double").alias("a")),
                            usable, genome.n_bins)
    end = lambda k: F.pmod(F.col(f"bin{k}_id") - genome.start_of(F.col(f"bin{k}_id")), F.lit(size)).cast("int")
    held = (stored.where("a is not null and a <> 0")
            .groupBy(*[block_of(genome, F.col(f"bin{k}_id"), size).alias(f"block{k}") for k in (1, 2)])
            .agg(F.collect_list(F.struct(end(1).alias("i"), end(2).alias("j"), "a")).alias("data"))
            .select("block1", "block2", F.col("data.i").alias("i"), F.col("data.j").alias("j"), F.col("data.a").alias("a")))
    return tiles(model, size).join(held, ["block1", "block2"], "left")


def tile_values(model: Model, means=None, data: bool = True):
    """A function from a row of :func:`with_data` to its model values and the data beside them.

    ``means``, a broadcast pair of arrays by distance, are the data's and the model's means that their cells are
    divided by; where one is zero the cells are zero.  Without ``data`` the model values come alone.
    """
    matrix = tile_matrix(model)

    def values(r) -> tuple[np.ndarray, np.ndarray | None]:
        rows, columns, b = matrix(r)
        a = np.zeros_like(b) if data else None
        if data and r.i is not None and len(r.i):
            a[np.searchsorted(rows - int(r.first1), np.asarray(r.i)), np.searchsorted(columns - int(r.first2), np.asarray(r.j))] = r.a
        if means is not None:
            for x, mean in zip((a, b), means.value):
                if x is not None:
                    by = by_distance(lambda lags, mean=mean: mean[np.maximum(lags, 0)], rows, columns)
                    np.divide(x, by, out=x, where=by != 0)
                    x[by == 0] = 0.0
        if rows[-1] < columns[0]:
            return b.ravel(), a.ravel() if data else None
        upper = columns[None, :] > rows[:, None]
        return b[upper], a[upper] if data else None

    return values


def _bits(b: np.ndarray) -> np.ndarray:
    """Non-negative doubles as integers in the same order."""
    return (b + 0.0).view(np.uint64)


def _tally(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs; a count by place while the keys lie close."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = key.min()
    if int(key.max() - low) < 4 * len(key):
        held = np.bincount((key - low).astype(np.int64))
        some = np.flatnonzero(held)
        return some + int(low), held[some]
    found, n = np.unique(key, return_counts=True)
    return found.astype(np.int64), n


def _ranges(tiled: DataFrame, values, size: int) -> np.ndarray:
    """Lower ends of the ranges, as integers that order like the values."""

    def counted(bits: int, crowded: np.ndarray) -> dict[int, int]:
        """Values by their first ``bits`` bits; from the second pass on only of ``crowded`` classes before."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, int] = {}
            for frame in frames:
                for r in frame.itertuples():
                    key = _bits(values(r)[0])
                    if len(crowded):
                        before = key >> np.uint64(LAST - bits + MORE)
                        at = np.minimum(np.searchsorted(crowded, before), len(crowded) - 1)
                        key = key[crowded[at] == before]
                    for k, m in zip(*(x.tolist() for x in _tally(key >> np.uint64(LAST - bits)))):
                        total[k] = total.get(k, 0) + m
            yield pd.DataFrame({"k": np.array(list(total), np.int64), "n": np.array(list(total.values()), np.int64)})

        rows = tiled.mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
        return {r.k: r.n for r in rows.collect()}

    classes, bits, crowded = [], FIRST, np.zeros(0, np.uint64)
    while True:
        found = counted(bits, crowded)
        heavy = sorted((k for k, m in found.items() if m > size), key=lambda k: -found[k])[:PIECES >> MORE]
        shift = LAST - bits
        if shift < MORE or not heavy:
            heavy = []
        dense = set(heavy)
        classes += [(k << shift, m) for k, m in found.items() if k not in dense]
        if not heavy:
            break
        crowded, bits = np.array(sorted(heavy), np.uint64), bits + MORE
    ends, held = [0], 0
    for low, m in sorted(classes):
        if held and held + m > size:
            ends.append(low)
            held = 0
        held += m
    return np.array(ends, np.uint64)


def _planes(b: np.ndarray) -> bytes:
    """Doubles as bytes, first those of one place of all numbers: in sorted numbers the leading ones hardly differ, which packs well."""
    return b.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(float).ravel()


def _range_sums(tiled: DataFrame, values, ends: np.ndarray) -> DataFrame:
    """Sums of ranks within each range: ``(range, a, n, s, q)``, number, sum and sum of squares by data value.

    A range gets every model value, how often a tile holds it where that is more than once, and the stored cells apart.
    """

    def cuts(b: np.ndarray) -> np.ndarray:
        return np.searchsorted(_bits(b), ends[1:], side="left")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                b, a = values(r)
                stored = np.flatnonzero(a != 0)
                order = stored[np.argsort(b[stored], kind="stable")]
                held, data = b[order] + 0.0, a[order]
                b = np.sort(b + 0.0)
                first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
                many = np.diff(np.r_[first, len(b)])
                b = b[first]
                at, of = np.r_[0, cuts(b), len(b)], np.r_[0, cuts(held), len(held)]
                yield pd.DataFrame([(int(k), _planes(b[at[k]:at[k + 1]]),
                                     many[at[k]:at[k + 1]].tobytes() if (many[at[k]:at[k + 1]] > 1).any() else b"",
                                     _planes(held[of[k]:of[k + 1]]), data[of[k]:of[k + 1]].tobytes())
                                    for k in np.flatnonzero(at[1:] > at[:-1])], columns=["range", "b", "m", "held", "data"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_from_planes(x) for x in frame["b"]]
        b = np.concatenate(parts)
        if any(frame["m"].map(len)):
            m = np.concatenate([np.frombuffer(x, np.int64) if x else np.ones(len(p), np.int64) for x, p in zip(frame["m"], parts)])
            order = np.argsort(b, kind="stable")
            b, m = b[order], m[order]
        else:
            b.sort()
            m = np.ones(len(b), np.int64)
        del parts
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        b, n = b[first], np.add.reduceat(m, first)
        rank = np.cumsum(n) - n + (n + 1) / 2.0
        whole = n.sum(), (n * rank).sum(), (n * rank * rank).sum()
        stored = rank[np.searchsorted(b, np.concatenate([_from_planes(x) for x in frame["held"]]))]
        kinds, at = np.unique(np.frombuffer(b"".join(frame["data"]), float), return_inverse=True)
        sums = [np.bincount(at, w, len(kinds)) for w in (np.ones(len(at)), stored, stored * stored)]
        rest = [[w - x.sum()] if w - x.sum() > 0 else [0.0] for w, x in zip(whole, sums)]
        keep = slice(None) if whole[0] > len(at) else slice(1, None)  # the zero cells first, if there are any
        return pd.DataFrame({"range": np.full(len(kinds) + 1, frame["range"].iloc[0], np.int32), "a": np.r_[0.0, kinds],
                             "n": np.r_[rest[0], sums[0]], "s": np.r_[rest[1], sums[1]], "q": np.r_[rest[2], sums[2]]})[keep]

    return (tiled.mapInPandas(deal, "range int, b binary, m binary, held binary, data binary").groupBy("range")
            .applyInPandas(merge, "range int, a double, n double, s double, q double"))


def _centred_ranks(values: DataFrame, whole: Column, per_range: int) -> DataFrame:
    """Rank of each distinct data value less the mean rank, ``(a, n, ra, ...)``; ties share their mean rank."""
    distinct = values.count()
    pieces = max(1, distinct // per_range)
    cuts = values.approxQuantile("a", [k / pieces for k in range(1, pieces)], 0.1 / pieces) if pieces > 1 else []
    below = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("a"))) if cuts else F.lit(0)
    ranked = running_ranges(values.withColumn("__range", below), "__range", "a", F.col("n"), "__below")
    return ranked.withColumn("ra", F.col("__below") + (F.col("n") + 1) / 2.0 - (whole + 1) / 2.0).drop("__below", "__range")


def _stored(tiled: DataFrame, values) -> DataFrame:
    """Model value and data of every stored cell, ``(b, a)``."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                b, a = values(r)
                held = np.flatnonzero(a)
                yield pd.DataFrame({"b": b[held] + 0.0, "a": a[held]})

    return tiled.where("i is not null").mapInPandas(run, "b double, a double")


def _tied(tiles: DataFrame, values, least: int) -> list[int]:
    """How often each model value occurs that more than ``least`` pairs have, as in :func:`_ranges` by leading bits first."""

    def counted(shift: int, crowded: np.ndarray, width: int) -> dict[int, int]:
        """Classes of more than ``least`` values by what is left of ``shift`` bits; later only of ``crowded`` classes before."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, low = np.zeros(0, np.int64), 0

            def rows(keys: np.ndarray, n: np.ndarray) -> pd.DataFrame:
                return pd.DataFrame({"k": keys, "n": n})

            for frame in frames:
                for r in frame.itertuples():
                    key = (_bits(values(r)[0]) >> np.uint64(shift)).astype(np.int64)
                    if len(crowded):  # numbered by their class and the bits behind it
                        key.sort()
                        at = np.minimum(np.searchsorted(crowded, key >> width), len(crowded) - 1)
                        key = (at * (1 << width) + (key & ((1 << width) - 1)))[crowded[at] == key >> width]
                    if not len(key):
                        continue
                    first, last = int(key.min()), int(key.max())
                    if last - first >= TIED_HELD:
                        yield rows(*_tally(key))
                        continue
                    bottom, top = (min(low, first), max(low + len(held), last + 1)) if len(held) else (first, last + 1)
                    if top - bottom > TIED_HELD:
                        some = np.flatnonzero(held)
                        yield rows(some + low, held[some])
                        held, bottom, top = held[:0], first, last + 1
                    if (bottom, top) != (low, low + len(held)):
                        wider = np.zeros(top - bottom, np.int64)
                        if len(held):
                            wider[low - bottom:low - bottom + len(held)] = held
                        held, low = wider, bottom
                    held[first - low:last + 1 - low] += np.bincount(key - first)
            some = np.flatnonzero(held)
            yield rows(some + low, held[some])

        found = tiles.mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > least).toArrow()
        keys, n = (found.column(c).to_numpy() for c in ("k", "n"))
        if len(crowded):
            keys = crowded[keys >> width] * (1 << width) + (keys & ((1 << width) - 1))
        return dict(zip(keys.tolist(), n.tolist()))

    shift = LAST - TIED_FIRST
    found = counted(shift, np.zeros(0, np.int64), 0)
    while found and shift:
        width = min(shift, max(1, (TIED_HELD // len(found)).bit_length() - 1))
        shift -= width
        found = counted(shift, np.array(sorted(found), np.int64), width)
    return list(found.values())


def _weight_above(tiles: DataFrame, values, cells: DataFrame) -> float:
    """Sum over all model values of the weight of the ``cells``, ``(b, w)``, above each, less half of the weight of all.

    A cell of the same value counts half.  Values of ``cells`` are distinct; they go to all tasks.
    """
    table = cells.toArrow()
    keys, weight = (table.column(c).to_numpy() for c in ("b", "w"))
    if not len(keys):
        return 0.0
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    sent = tiles.sparkSession.sparkContext.broadcast((keys, np.cumsum(weight[::-1])[::-1] - weight / 2 - weight.sum() / 2, weight / 2))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, above, half = sent.value  # at the key itself, and what is added just below it
        ends, total = float(above[0] + half[0]), 0.0
        for frame in frames:
            for r in frame.itertuples():
                b = values(r)[0]
                low, high = b < keys[0], b > keys[-1]
                inside = np.sort(b[~(low | high)])
                at = np.searchsorted(keys, inside)
                total += ends * (int(low.sum()) - int(high.sum())) + above[at].sum() + half[at][keys[at] != inside].sum()
        yield pd.DataFrame({"total": [total]})

    try:
        return float(sum(x.total for x in tiles.mapInPandas(run, "total double").collect()))
    finally:
        sent.destroy()


def _without_exchange(model: Model, tiled: DataFrame, means, n: int, per_slice: int) -> float | None:
    """Spearman correlation over ``n`` pairs of which only stored cells are rows."""
    spark = model.states.sparkSession
    stored = cut(_stored(tiled, tile_values(model, means)))
    kinds = stored.groupBy("a").agg(F.count("*").cast("double").alias("n"))
    rest = n - stored.count()
    if rest:
        kinds = kinds.unionByName(spark.createDataFrame([(0.0, float(rest))], "a double, n double"))
    ranked = cut(_centred_ranks(cut(kinds), F.lit(float(n)), per_slice))
    zero = (ranked.where("a = 0").select("ra").first() or [0.0])[0]
    aa = ranked.agg(F.sum(F.col("n") * F.col("ra") * F.col("ra"))).first()[0] or 0.0
    weights = ranked.where("a <> 0").select("a", (F.col("ra") - zero).alias("w"))
    cells = cut(stored.join(sized(weights, ranked.count(), 32), "a").groupBy("b").agg(F.sum("w").alias("w")))
    pieces = max(1, -(-cells.count() // per_slice))
    cuts = sorted(set(cells.approxQuantile("b", [k / pieces for k in range(1, pieces)], 0.1 / pieces))) if pieces > 1 else []
    tiles = tiled.drop("i", "j", "a").coalesce(2 * spark.sparkContext.defaultParallelism)
    values = tile_values(model, means, data=False)
    b, ab = F.col("b"), 0.0
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = cells if low is None else cells.where(b >= low)
        ab += _weight_above(tiles, values, part if high is None else part.where(b < high))
    twelve = n ** 3 - n - sum(t ** 3 - t for t in _tied(tiles, values, int(n * RARE)))
    return ab / np.sqrt(aa) / np.sqrt(twelve / 12) if aa > 0 and twelve > 0 else None


def spearman(model: Model, pixels: DataFrame, value: str = "count", size: int = TILE, per_range: int = RANGE,
             means: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Spearman correlation of the data with the model over all usable pairs, one row ``spearman``.

    Stored values must be positive or negative numbers; NULL ones count as zero.  NULL where either side
    does not vary.  With ``means`` by distance, of data and model, either side is divided by its own.
    """
    spark = model.states.sparkSession
    tiled = cut(with_data(model, pixels, value, size))
    means = None if means is None else spark.sparkContext.broadcast(means)
    usable = model.states.count()
    if usable * (usable - 1) // 2 > EXCHANGED:
        found = _without_exchange(model, tiled, means, usable * (usable - 1) // 2, per_range)
        return spark.createDataFrame([(None if found is None else float(found),)], "spearman double")
    values = tile_values(model, means)
    sums = cut(_range_sums(tiled, values, _ranges(tiled, values, per_range)))
    totals = sums.groupBy("range").agg(F.sum("n").alias("__n"))  # one row a range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = totals.agg(F.sum("__n")).scalar()
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0.0)) - (whole + 1) / 2.0
    offsets = totals.select("range", shift.alias("off"))
    centred = sums.join(F.broadcast(offsets), "range").groupBy("a").agg(
        F.sum("n").alias("n"), F.sum(F.col("off") * F.col("n") + F.col("s")).alias("s"),
        F.sum(F.col("off") * F.col("off") * F.col("n") + 2 * F.col("off") * F.col("s") + F.col("q")).alias("q"))
    ranked = _centred_ranks(cut(centred), whole, per_range)
    out = ranked.agg(F.sum(F.col("ra") * F.col("s")).alias("ab"), F.sum(F.col("n") * F.col("ra") * F.col("ra")).alias("aa"),
                     F.sum("q").alias("bb"))
    return out.select(F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt("aa") / F.sqrt("bb")).alias("spearman"))
