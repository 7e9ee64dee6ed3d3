"""Language identification with language-bitmask n-gram filters.

Training counts the character trigrams of letters (lower case, one blank around each word)
per language.  A trigram belongs to a language when its share there is at least ``ratio`` of
its largest share in any language.  The filters of all languages are one bit-sliced Bloom filter:
every slot is a mask with a bit for each language, a trigram sets its languages' bits in
``PROBES`` slots, and the AND of these slots is the mask of all languages that hold it.

A text's trigrams are counted per language bit.  Filters also answer for trigrams they never
saw, at the rate (share of set bits) ** PROBES; with ``n`` trigrams and ``c`` answers the corrected
count is (c - n * rate) / (1 - rate).  The largest decides, ties go to the first language in order.

Defined cases: null texts and texts without a letter get ``und`` and score 0, as does everything when
nothing can be learned; null languages are not learned from; repeated rows count as often as they
occur; texts of any length are read whole, in pieces.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import append, mix

SLOTS = 1 << 20
PROBES = 3
RATIO = 0.5
PIECE = 1 << 20
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point to its lower-case form, 32 for all that is no letter."""
    if not _LETTERS:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for code in range(sys.maxunicode + 1):
            if unicodedata.category(chr(code))[0] == "L":
                low = chr(code).lower()
                table[code] = ord(low) if len(low) == 1 else code
        _LETTERS.append(table)
    return _LETTERS[0]


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and trigram codes (21 bits a character), some texts at a time.

    A text longer than a piece comes in several pieces that overlap by two characters.
    """
    table = letters()

    def codes(group: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.frombuffer("".join(" " + t + " " for _, t in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = table[np.minimum(joined, sys.maxunicode)]
        rows = np.repeat(np.array([r for r, _ in group]), [len(t) + 2 for _, t in group])
        keep = np.ones(len(plain), bool)  # one blank between words
        keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32) | (rows[1:] != rows[:-1])
        plain, rows = plain[keep].astype(np.uint64), rows[keep]
        if len(plain) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        code = (plain[:-2] << np.uint64(42)) | (plain[1:-1] << np.uint64(21)) | plain[2:]
        use = (rows[:-2] == rows[2:]) & (plain[1:-1] != 32)
        return rows[:-2][use], code[use]

    group, size = [], 0
    for row, text in enumerate(texts):
        text = text or ""
        for start in range(0, max(1, len(text)), PIECE):
            group.append((row, text[max(0, start - 2):start + PIECE]))
            size += len(group[-1][1])
            if size >= PIECE:
                yield codes(group)
                group, size = [], 0
    if group:
        yield codes(group)


def count_trigrams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``(lang, gram, n)`` over all rows, added up within each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            which, gram, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((gram, which))
            which, gram, n = which[order], gram[order], n[order]
            new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (gram[1:] != gram[:-1])])
            return which[new], gram[new], np.add.reduceat(n, new)

        def out() -> pa.RecordBatch:
            which, gram, n = settle()
            labels = np.array(list(names), object)
            return pa.RecordBatch.from_arrays(
                [pa.array(labels[which].tolist(), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)],
                names=["lang", "gram", "n"])

        for batch in batches:
            tags = batch.column(0).to_pylist()
            which = np.array([names.setdefault(t, len(names)) for t in tags], np.int64)
            for rows, code in trigrams(batch.column(1).to_pylist()):
                of = which[rows]
                for k in np.unique(of):
                    gram, n = np.unique(code[of == k], return_counts=True)
                    held.append((np.full(len(gram), k), gram, n.astype(np.int64)))
                    size += len(gram)
                if size > 4 * PIECE:
                    held = [settle()]
                    size = len(held[0][0])
                    if size > 2 * PIECE:  # many different trigrams: hand them on
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return (docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
            .mapInArrow(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class Filters:
    """Slot masks, one column of 63 language bits each, with the languages in order."""

    langs: list[str]
    masks: np.ndarray
    rates: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.rates is None:
            fill = [np.mean((self.masks[:, k // 63] >> (k % 63)) & 1) for k in range(len(self.langs))]
            self.rates = np.array(fill) ** PROBES

    def languages(self, gram: np.ndarray) -> np.ndarray:
        found = None
        for probe in range(PROBES):
            mask = self.masks[slot_of(gram, probe)]
            found = mask if found is None else found & mask
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.zeros(len(texts))
        counts = np.zeros((len(texts), len(self.langs)))
        for rows, gram in trigrams(texts):
            found = self.languages(gram)
            total += np.bincount(rows, minlength=len(texts))
            for k in range(len(self.langs)):
                counts[:, k] += np.bincount(rows, (found[:, k // 63] >> (k % 63)) & 1, len(texts))
        true = np.maximum(0, (counts - total[:, None] * self.rates) / (1 - np.minimum(self.rates, 0.999)))
        best = true.argmax(axis=1)
        top = true[np.arange(len(texts)), best]
        share = np.where(total > 0, np.minimum(1, top / np.maximum(total, 1)), 0.0)
        return [self.langs[b] if t else UNKNOWN for b, t in zip(best, total)], share.tolist()


def slot_of(gram: np.ndarray, probe: int) -> np.ndarray:
    return (mix(gram + np.uint64(probe << 58)) % np.uint64(SLOTS)).astype(np.int64)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", ratio: float = RATIO) -> Filters:
    """Filters from all rows of ``docs`` with a language.

    The slots are OR-ed on the cluster; what is collected is at most ``SLOTS`` masks for each
    63 languages, whatever the size of the corpus, and one row for each language.
    """
    counts = cut(count_trigrams(docs, lang, text))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()
    langs = [r["lang"] for r in totals]
    width = max(1, -(-len(langs) // 63))
    if not langs:
        return Filters([], np.zeros((1, 1), np.int64))
    spark = docs.sparkSession
    known = spark.createDataFrame([(r["lang"], k, float(r["total"])) for k, r in enumerate(totals)],
                                  "lang string, place int, total double")
    shares = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total"))
    top = shares.groupBy("gram").agg(F.max("share").alias("top"),
                                     F.collect_list(F.struct("place", "share")).alias("each"))
    member = top.select("gram", F.explode("each").alias("e"), "top").where(F.col("e.share") >= ratio * F.col("top"))
    bits = member.groupBy("gram", F.floor(F.col("e.place") / 63).cast("int").alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, e.place % 63)")).alias("mask"))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy().view(np.uint64)
            slot = np.concatenate([slot_of(gram, p) for p in range(PROBES)])
            again = pa.array(np.tile(np.arange(len(gram)), PROBES))
            yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column(1).take(again), batch.column(2).take(again)],
                                             names=["slot", "word", "mask"])

    merged = (bits.mapInArrow(probes, "slot long, word int, mask long")
              .groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow())
    masks = np.zeros((SLOTS, width), np.int64)
    masks[merged["slot"].to_numpy(), merged["word"].to_numpy()] = merged["mask"].to_numpy()
    return Filters(langs, masks)


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the share of trigrams that the predicted language holds."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(columns: list[pa.Array]) -> list[pa.Array]:
        langs, scores = sent.value.predict(columns[0].to_pylist())
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return append(docs, "lang_pred string, score double", [text], predict)


def least_score(told: DataFrame, lang: str = "lang") -> float:
    """Half of what all but one in a hundred rightly told texts with a language reach; 0 without such texts."""
    right = told.where((F.col(lang) == F.col("lang_pred")) & (F.col("score") > 0))
    low = right.agg(F.percentile_approx("score", 0.01, 10000)).first()[0]
    return (low or 0.0) / 2


def rejected(least: float = 0.0) -> Column:
    """Texts whose language can't be told: no letter, no answer of a filter or a share below ``least``."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("score") <= 0) | (F.col("score") < least)
