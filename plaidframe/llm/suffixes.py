"""Removal of byte strings of a minimum length that occur more than once.

A window is a run of ``length`` bytes of one text.  The decision which windows occur elsewhere is made by
threshold-bounded interval expansion: over a collection of strings the Burrows-Wheeler transform is formed
and, breadth first, intervals of strings are extended to the left by one byte; each new right border of an
interval gets the length of the string extended as its common-prefix value, so values arise in increasing
order, and expansion stops at ``length``: suffixes whose border to a neighbour is still open share at least
``length`` bytes with it.

One transform of all texts would be one task, so windows are first dealt to small collections in which all
their equals must lie.  Of the ``ANCHOR``-byte strings in a window the one with the smallest hash is its key:
equal windows have equal keys, and neighbouring windows mostly share one, so a run of windows with one key
is kept as one segment.  Keys that occur once in all texts cannot have a repeated window and are dropped by a
join; the segments of other keys are brought together by key, equal ones once with their number.  Hashes
only bring windows together or leave out keys that occur once; equality is decided on the bytes.

A key with more than ``CROWD`` segments (a passage that very many texts share, each with other text beside
it) is dealt anew: its windows choose among the strings that a sample of the key's segments does not hold
often, so windows that reach into a text's own part go to keys of their own, and windows inside the passage
become equal segments.  Every choice is the same for equal windows, whatever the sample, so this only
changes how work is spread.

Texts cross the network once, dealt by a hash of the text; equal texts have equal results.

Defined cases: a null text is an empty one; texts shorter than ``length`` keep all; null and repeated ids
stay rows of their own; equal texts count as often as they occur; matches never cross texts; a long text is
worked through in pieces and cut nowhere; an empty table gives no rows; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch_path
from .common import mix, slices

LENGTH, ANCHOR = 200, 64
PIECE = 1 << 17  # window starts hashed at a time
PLACE = np.uint64((1 << 18) - 1)  # low bits of a choice: the place in the piece
RUN = 1024  # windows in a segment at most
TWICE = 1 << 15  # mark of a segment that holds its key at more than one place
BATCH = 3 << 19  # bytes of a collection, if the next key begins; so few that places take 21 bits
HELD = 16 << 20  # bytes of segments a task holds back to find equal ones
CROWD, CROWDS = 500, 4096  # segments that make a key crowded, but no more than so many keys are
SAMPLE, SHARE = 256, 26  # segments of a crowded key that are looked at, and how many of them hold a common string
END = np.uint8(255)  # between strings; no byte of UTF-8

_RANDOM = np.random.Generator(np.random.PCG64(20240912))
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(0, 1 << 62)) * 2 + 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if n not in _POWERS:
        _POWERS.clear()
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[n]


def string_hashes(raw: np.ndarray, anchor: int) -> np.ndarray:
    """Hash of the ``anchor`` bytes at every place of ``raw`` that has so many."""
    up, down = powers(PIECE + 4 * LENGTH if len(raw) <= PIECE + 4 * LENGTH else len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[:len(raw)], out=sums[1:])
    return mix((sums[anchor:] - sums[:-anchor]) * down[:len(raw) - anchor + 1])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def segments(offsets: np.ndarray, raw: np.ndarray, length: int, anchor: int, later: np.ndarray | None = None
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first place in ``raw`` and number of windows of every segment of the texts between ``offsets``.

    A window chooses by the upper bits of the hashes, of equal ones the first.  Neighbouring windows whose
    chosen strings are equal are one segment, also if these are at several places (a text that repeats itself
    closely); TWICE is then added to the number.  Hashes in the sorted array ``later`` are chosen only where a
    window holds no others.
    """
    n, width = len(raw), length - anchor + 1
    open_ = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    has = sizes >= length
    np.add.at(open_, offsets[:-1][has], 1)
    np.add.at(open_, offsets[1:][has] - length + 1, -1)
    valid = np.cumsum(open_[:-1]).astype(bool)
    keys, firsts, counts = [], [], []
    for a in range(0, n - length + 1, PIECE):
        b = min(a + PIECE, n - length + 1)
        inside = valid[a:b]
        if not inside.any():
            continue
        hashes = string_hashes(raw[a:b + length - 1], anchor) >> np.uint64(1)
        if later is not None:
            found = later[np.minimum(np.searchsorted(later, hashes), len(later) - 1)] == hashes
            hashes |= found.astype(np.uint64) << np.uint64(63)
        places = np.arange(len(hashes), dtype=np.uint64)
        chosen = (smallest((hashes & ~PLACE) | places, width) & PLACE).astype(np.int32)
        moved = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
        new = ~inside
        new[1:] |= new[:-1]
        new[0] = True
        new[moved[hashes[chosen[moved]] != hashes[chosen[moved - 1]]]] = True
        new &= inside
        first = np.flatnonzero(new)
        stop = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True]) + 1
        many = stop - first
        twice = chosen[first] != chosen[stop - 1]
        if many.max(initial=0) > RUN:
            pieces = -(-many // RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = np.repeat(first, pieces) + nth * RUN
            many = np.minimum(np.repeat(stop, pieces) - first, RUN)
            twice = np.repeat(twice, pieces)
        keys.append((hashes[chosen[first]] & np.uint64((1 << 63) - 1)).astype(np.int64))
        firsts.append(first + a)
        counts.append(many + TWICE * twice)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts)


# the transform and its intervals

def by_value(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``value`` sorted, with the place each came from; small values are sorted with their place in one word."""
    places = max(1, int(len(value)).bit_length())
    if bits + places <= 64:
        packed = np.sort((value << np.uint64(places)) | np.arange(len(value), dtype=np.uint64))
        return packed >> np.uint64(places), (packed & np.uint64((1 << places) - 1)).astype(np.int32)
    place = np.argsort(value)
    return value[place], place.astype(np.int32)


def sorted_suffixes(text: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of the ``depth`` bytes there; ``left`` counts the bytes before the next END.

    Prefix doubling from words of five bytes; only places that share their rank are ordered again.
    """
    n, h = len(text), 5
    word, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
    padded = np.r_[text, np.full(h, END)]
    for k in range(h):
        byte = padded[k:k + n]
        word = (word << np.uint64(8)) | np.where(ended, END, byte)
        ended |= byte == END
    ranked, order = by_value(word, 8 * h)
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    del word, ranked, padded
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    slots, bits = np.arange(n, dtype=np.int32), n.bit_length()
    while h < depth:
        shared = ~(new[slots] & np.r_[new, True][slots + 1])
        slots = slots[shared]
        slots = slots[left[order[slots]] >= h]
        if not len(slots):
            break
        at = order[slots]
        pair = (rank[at].astype(np.uint64) << np.uint64(bits)) | rank[at + h].astype(np.uint64)
        pair, again = by_value(pair, 2 * bits)
        at = at[again]
        order[slots] = at
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        new[slots] |= fresh
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots), dtype=np.int32), 0))]
        h *= 2
    return order


def open_borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``order`` whether its suffix and the one before share ``length`` bytes or more.

    Breadth-first backward extension.  A queue holds the intervals of strings of one length whose right
    border was new; each byte before a suffix of an interval leads to the interval of the string extended by
    it.  The first and the last suffix of an interval with that byte are those that have no such byte before
    them, or behind them, within the interval.
    """
    n = len(text)
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable").astype(np.int32)
    target = np.empty(n, np.int32)
    target[by_byte] = np.arange(n, dtype=np.int32)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    previous, following = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    previous[by_byte[1:][same]] = by_byte[:-1][same]
    following[by_byte[:-1][same]] = by_byte[1:][same]
    previous[before == END], following[before == END] = n, -1  # no string is extended across an end
    undone = np.ones(n + 1, bool)
    undone[0] = undone[n] = False
    size = np.bincount(text, minlength=256)
    stop = np.cumsum(size)
    low, high = (stop - size)[size > 0].astype(np.int32), stop[size > 0].astype(np.int32)
    undone[high] = False  # value 0
    for _ in range(1, length):
        many = high - low
        if not len(many):
            break
        end = np.cumsum(many, dtype=np.int64)
        at = np.arange(end[-1], dtype=np.int32) + np.repeat((low - end + many).astype(np.int32), many)
        first = at[previous[at] < np.repeat(low, many)]
        last = at[following[at] >= np.repeat(high, many)]
        low, high = np.sort(target[first]), np.sort(target[last]) + np.int32(1)  # intervals do not overlap
        fresh = undone[high]
        low, high = low[fresh], high[fresh]
        undone[high] = False
    return undone


def repeated_windows(strings: Sequence[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """Places in each string at which a window starts that occurs more than once in all; ``copies`` of each string."""
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    stops = np.cumsum(sizes + 1) - 1
    left = np.repeat(stops, sizes + 1) - np.arange(len(text))
    order = sorted_suffixes(text, left, length)
    undone = open_borders(text, order, length)
    found = np.zeros(len(text), bool)
    found[order] = undone[:-1] | undone[1:]
    found |= np.repeat(copies > 1, sizes + 1)
    found &= left >= length
    return [np.flatnonzero(found[e - n:e]) for e, n in zip(stops, sizes)]


# the cluster's part

def identified(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    own = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), own.alias("text"), F.xxhash64(own).alias("t1"),
                       F.xxhash64(F.lit(1), own).alias("t2"))


def keyed(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Keys of all segments with where they are: (key, t1, span), written once.

    ``span`` packs the segment's first byte, its number of windows and some bits of ``t2``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2).to_numpy() & 0xFFFF
            for first, end, offsets, raw in slices(batch.column(0)):
                keys, at, many = segments(offsets, raw, length, anchor)
                row = np.searchsorted(offsets, at, side="right") - 1
                span = ((at - offsets[row]) << 32) | (many << 16) | marks[first + row]
                cuts = pa.array(np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(first, end - first), pa.ListArray.from_arrays(cuts, pa.array(keys)),
                    pa.ListArray.from_arrays(cuts, pa.array(span))], names=["t1", "keys", "spans"])

    path = scratch_path(texts.sparkSession, f"segments-{uuid.uuid4().hex}")
    (texts.select("text", "t1", "t2").mapInArrow(run, "t1 long, keys array<long>, spans array<long>")
     .where(F.size("keys") > 0).write.parquet(path))
    pair = F.explode(F.arrays_zip("keys", "spans")).alias("pair")
    return texts.sparkSession.read.parquet(path).select("t1", pair).select("pair.keys", "t1", "pair.spans").toDF("key", "t1", "span")


@dataclass(frozen=True)
class Crowded:
    """Keys with very many segments and the strings common among these, both bounded by CROWDS."""

    keys: frozenset[int] = frozenset()
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def cut_out(batch: pa.RecordBatch, length: int, anchor: int, crowded: Crowded) -> Iterator[tuple[int, int, int, bytes]]:
    """Row, key, first byte and bytes of the segments listed for the texts of a batch (text, t2, listed).

    The segments of crowded keys are cut anew, under keys made from both choices.
    """
    texts, marks, lists = batch.column(0), batch.column(1).to_numpy() & 0xFFFF, batch.column(2)
    flat = lists.flatten()
    keys, spans = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    cuts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    again = []
    for row in range(len(texts)):
        view = memoryview(texts[row].as_buffer())
        for k in range(cuts[row], cuts[row + 1]):
            span, key = int(spans[k]), int(keys[k])
            if span & 0xFFFF == marks[row]:
                at = span >> 32
                one = row, key, at, bytes(view[at:at + ((span >> 16) & (TWICE - 1)) + length - 1])
                if key in crowded.keys and len(crowded.common):
                    again.append(one)
                else:
                    yield one
    if again:
        offsets = np.r_[0, np.cumsum([len(one[3]) for one in again])]
        raw = np.frombuffer(b"".join(one[3] for one in again), np.uint8)
        chosen, firsts, counts = segments(offsets, raw, length, anchor, crowded.common)
        of = np.searchsorted(offsets, firsts, side="right") - 1
        first_keys = np.array([one[1] for one in again])[of].astype(np.uint64)
        both = (mix(chosen.astype(np.uint64) + mix(first_keys)) >> np.uint64(1)).astype(np.int64)
        for k, key, at, many in zip(of, both.tolist(), (firsts - offsets[of]).tolist(), (counts & (TWICE - 1)).tolist()):
            row, _, first, content = again[k]
            yield row, key, first + at, content[at:at + many + length - 1]


def listed_texts(texts: DataFrame, places: DataFrame, few: bool = False) -> DataFrame:
    """Texts with their segments among ``places``.

    All columns of ``texts`` stay, so that every join by ``t1`` takes the same exchange of the texts;
    ``few`` places (CROWDS * SAMPLE about) go to the texts instead.
    """
    lists = places.groupBy("t1").agg(F.collect_set(F.struct("key", "span")).alias("listed"))
    lists = F.broadcast(lists) if few else lists
    return texts.join(lists, "t1").select(F.encode("text", "utf-8").alias("text"), "t2", "listed", "t1", "id")


def crowds(texts: DataFrame, places: DataFrame, repeated: DataFrame, length: int, anchor: int, crowd: int) -> Crowded:
    """The keys of ``repeated`` with more than ``crowd`` segments, and what a sample of these has in common."""
    total = repeated.agg(F.sum("n")).first()[0] or 0
    keys = repeated.where(F.col("n") > max(crowd, total // CROWDS))
    held = {r.key: r.n for r in keys.collect()}  # CROWDS rows at most
    if not held:
        return Crowded()
    some = places.join(F.broadcast(keys), "key").where(F.pmod(F.xxhash64("t1", "span"), F.col("n")) < SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, key, _, content in cut_out(batch, length, anchor, Crowded()):
                hashes = np.unique(string_hashes(np.frombuffer(content, np.uint8), anchor) >> np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), key)), pa.array(hashes)], names=["key", "string"])

    common = (listed_texts(texts, some, few=True).select("text", "t2", "listed").mapInArrow(run, "key long, string long")
              .groupBy("key", "string").agg(F.count("*").alias("n")).where(F.col("n") >= SHARE).select("string").distinct())
    return Crowded(frozenset(held), np.sort(np.array([r.string for r in common.collect()], np.uint64)))


def collections(listed: DataFrame, length: int, anchor: int, crowded: Crowded) -> DataFrame:
    """Segments of each key with their number: (key, content, copies); a task sends equal ones once."""
    def flush(held: dict) -> pa.RecordBatch:
        keys, contents = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.binary()),
                                           pa.array(list(held.values()), pa.int64())], names=["key", "content", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for _, key, _, content in cut_out(batch, length, anchor, crowded):
                one = (key, content)
                known = held.get(one, 0)
                held[one] = known + 1
                size += 0 if known else len(content) + 100
                if size > HELD:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return listed.mapInArrow(run, "key long, content binary, copies long")


def occurrences(listed: DataFrame, length: int, anchor: int, crowded: Crowded) -> DataFrame:
    """Where the segments are: (key, content_hash, t1, t2, first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(row, key, xxhash.xxh3_64_intdigest(content) - (1 << 63), at)
                   for row, key, at, content in cut_out(batch, length, anchor, crowded)]
            rows, keys, hashes, at = zip(*got) if got else ((), (), (), ())
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), batch.column(3).take(rows), batch.column(1).take(rows),
                pa.array(at, pa.int64())], names=["key", "content_hash", "t1", "t2", "first"])

    return listed.mapInArrow(run, "key long, content_hash long, t1 long, t2 long, first long")


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Borders of the maximal runs of bytes that windows at the sorted ``starts`` cover, flat."""
    gap = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + length], 1).ravel()


def judged(gathered: DataFrame, length: int) -> DataFrame:
    """Runs of bytes of each segment that repeated windows cover: (key, content_hash, runs)."""
    def decide(contents: dict) -> pa.RecordBatch:
        alone = Counter(key for key, _ in contents)
        # the only segment of its key, held more than once, has nothing to be compared with: all its windows repeat
        whole = [one for one, copies in contents.items() if copies > 1 and alone[one[0]] == 1]
        rest = [one for one, copies in contents.items() if copies == 1 or alone[one[0]] > 1]
        found = repeated_windows([c for _, c in rest], np.array([contents[one] for one in rest]), length) if rest else []
        hit = [(one, covered(at, length).tolist()) for one, at in zip(rest, found) if len(at)]
        hit += [(one, [0, len(one[1])]) for one in whole]
        return pa.RecordBatch.from_arrays([
            pa.array([one[0] for one, _ in hit], pa.int64()),
            pa.array([xxhash.xxh3_64_intdigest(one[1]) - (1 << 63) for one, _ in hit], pa.int64()),
            pa.array([runs for _, runs in hit], pa.list_(pa.int64()))], names=["key", "content_hash", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = {}, 0, None
        for batch in batches:
            for key, content, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now and size > BATCH:
                    yield decide(held)
                    held, size = {}, 0
                now = key
                size += 0 if (key, content) in held else len(content) + 1
                held[key, content] = held.get((key, content), 0) + copies
        if held:
            yield decide(held)

    return (gathered.repartition("key").sortWithinPartitions("key")
            .mapInArrow(run, "key long, content_hash long, runs array<long>"))


def repeats_removed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH,
                    anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """Rows of ``docs`` as (id, n_bytes, removed: first bytes and ends of the removed runs, kept: the other bytes)."""
    texts = identified(docs, id_column, text)
    kind = dict(texts.dtypes)["id"]
    places = keyed(texts, length, anchor)
    held = F.when(F.col("span").bitwiseAND(TWICE << 16) != 0, 2).otherwise(1)
    repeated = cut(places.groupBy("key").agg(F.sum(held).alias("n")).where("n > 1"))
    crowded = crowds(texts, places, repeated, length, anchor, crowd)
    listed = listed_texts(texts, places.join(repeated.select("key"), "key"))
    runs = judged(collections(listed, length, anchor, crowded), length)
    hits = (occurrences(listed, length, anchor, crowded).join(runs, ["key", "content_hash"]).groupBy("t1")
            .agg(F.collect_set(F.struct("t2", "first", "runs")).alias("hits")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents, marks, hits = batch.columns
            marks = marks.to_numpy()
            removed, kept, sizes = [], [], []
            for row, own in enumerate(hits.to_pylist()):
                raw = contents[row].as_py()
                sizes.append(len(raw))
                pieces = sorted((h["first"] + a, h["first"] + b) for h in own or () if h["t2"] == marks[row]
                                for a, b in zip(h["runs"][::2], h["runs"][1::2]))
                merged: list[list[int]] = []
                for a, b in pieces:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                removed.append([{"first": a, "end": b} for a, b in merged])
                borders = [0, *(x for m in merged for x in m), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(borders[::2], borders[1::2])) if merged else raw)
            pairs = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(removed, pairs), pa.array(kept, pa.binary())],
                                             names=[id_column, "n_bytes", "removed", "kept"])

    return (texts.join(hits, "t1", "left").select("id", F.encode("text", "utf-8").alias("text"), "t2", "hits")
            .mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, removed array<struct<first:long,end:long>>, kept binary"))


def digest(removed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Sizes, number of removed runs and a hash of what is kept."""
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return removed.select(id_column, "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))
