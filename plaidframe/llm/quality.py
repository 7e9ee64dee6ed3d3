"""Quality classification by importance resampling.

Two generative models of hashed n-grams stand against each other: one of target and one of raw text.  A document's
importance weight is the ratio of its likelihoods; Gumbel noise on the log weight and the choice of the ``k`` largest
draw ``k`` documents without replacement, with odds that follow the weights.  This is done twice: texts labelled
of good quality against all labelled ones, and those not toxic among them against all of good quality.  A
document is kept if both draws take it.

N-grams are tokens, pairs of neighbours and the first four bytes of tokens (A-Z lower-cased; a token is a run of
letters, digits and characters beyond ASCII, or a run of ASCII marks); a pair of equal tokens is one n-gram for
all tokens.  A bucket of the hash counts only if its number of target n-grams is ``SURE`` standard deviations from
its share, in the second draw also a factor exp(``LEAST``) from it (toxic texts hold few marked words among even
ones), so that slight differences don't add up in long texts.

``k`` is the number of documents whose log weight reaches a cut, set where labelled documents that took no part
in the models are told apart best.  ``TEMPERATURE`` scales the noise.

Models and cuts are fitted on at most ``LABELS`` labelled ids (the smallest by a hash of the id); weights, ``k`` and the
draw cover all documents.

Defined cases: null and blank texts have no n-grams and are never drawn (log weight null); labels with nulls are
not used; an id with several labels has the worst of them; rows with the same id and text are drawn or
left together; a draw without labels of both kinds takes every document with text; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import FOLD, append, hash_runs, mix, slices

BUCKETS = 1 << 18
PRIOR = 2.0
SURE = 4.0
LEAST = 1.2
LABELS = 1 << 18
TEMPERATURE = 0.25
BINS = 4096
_KIND = np.full(256, 1, np.uint8)  # 0 blank, 1 word, 2 mark
_KIND[:128] = [0 if b <= 32 or b == 127 else 1 if chr(b).isalnum() else 2 for b in range(128)]


def ngrams(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and their rows."""
    folded = FOLD[raw]
    kind = np.zeros(len(raw) + 2, np.uint8)
    kind[1:-1] = _KIND[folded]
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    change = (kind[1:] != kind[:-1]) | border
    starts = np.flatnonzero(change & (kind[1:] != 0))
    ends = np.flatnonzero(change & (kind[:-1] != 0))
    token = hash_runs(folded, starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    long = ends - starts >= 4
    opening = mix(hash_runs(folded, starts[long], starts[long] + 4) + np.uint64(4))
    pair = mix(token[:-1] * np.uint64(0x9E3779B97F4A7C15) + token[1:])
    pair[token[:-1] == token[1:]] = np.uint64(1)
    inside = row[1:] == row[:-1]
    bucket = np.concatenate([token, opening, pair[inside]]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([row, row[long], row[1:][inside]])


def label_classes(labels: DataFrame, most: int = LABELS) -> DataFrame:
    """``(doc_id, label)`` of at most ``most`` ids: 1 good, 2 toxic, 3 low quality."""
    label = F.when(F.col("quality") == 0, 3).when(F.col("toxic") == 1, 2).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 1)
    return (labels.select("doc_id", label.alias("label")).where("doc_id is not null and label is not null")
            .groupBy("doc_id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def bucket_counts(docs: DataFrame, text: str, label: str) -> np.ndarray:
    """N-grams per bucket and label, ``(BUCKETS, 3)``; at most ``BUCKETS`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * BUCKETS, np.int64)
        for batch in batches:
            which = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) - 1
            for first, end, offsets, raw in slices(batch.column(0)):
                bucket, row = ngrams(offsets, raw)
                total += np.bincount(bucket + which[first:end][row] * BUCKETS, minlength=3 * BUCKETS)
        total = total.reshape(3, BUCKETS)
        used = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(x[used]) for x in total]],
                                         names=["bucket", "good", "toxic", "low"])

    table = (docs.select(text, label).mapInArrow(count, "bucket long, good long, toxic long, low long")
             .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("good", "toxic", "low")]).toArrow())
    out = np.zeros((BUCKETS, 3))
    out[table["bucket"].to_numpy()] = np.stack([table[c].to_numpy() for c in ("good", "toxic", "low")], axis=1)
    return out


def step(part: np.ndarray, whole: np.ndarray, least: float = 0.0) -> np.ndarray:
    """log of part's share over whole's per bucket, 0 where the difference is small or may be chance."""
    if not part.sum() or part.sum() == whole.sum():
        return np.zeros(len(part))
    share = part.sum() / whole.sum()
    expected = whole * share
    spread = np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    ratio = np.log((part + PRIOR) / (expected + PRIOR))
    return np.where((np.abs(part - expected) >= SURE * spread) & (np.abs(ratio) >= least), ratio, 0.0)


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Ratios of the two draws, ``(BUCKETS, 2)``."""
    good, toxic, low = counts.T
    return np.stack([step(good + toxic, good + toxic + low), step(good, good + toxic, LEAST)], axis=1)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """Where the share of good at or above less the share of others is largest; the middle of the gap there."""
    if not good.any() or good.all():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    below_good, below_bad = np.cumsum(g), np.cumsum(~g)
    gain = below_bad / (~good).sum() - below_good / good.sum()
    gain[:-1][w[1:] == w[:-1]] = -np.inf
    at = int(np.flatnonzero(gain == gain.max())[0])
    return float((w[at] + w[at + 1]) / 2) if at + 1 < len(w) else float(w[at])


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The ``k``-th largest value, from histograms of at most ``BINS`` rows at the driver."""
    if k <= 0:
        return math.inf
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return -math.inf
    x, above = F.col(column), 0
    while low < high:
        place = F.least(F.lit(BINS - 1), F.floor((x - low) / (high - low) * BINS))
        bins = (df.where(x.between(low, high)).groupBy(place.alias("b"))
                .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
                .orderBy(F.desc("b")).collect())
        for b in bins:
            if above + b["n"] >= k:
                if (b["low"], b["high"]) == (low, high):
                    return low
                low, high = b["low"], b["high"]
                break
            above += b["n"]
    return low


@dataclass(frozen=True)
class Classifier:
    ratios: np.ndarray
    bounds: tuple[float, float]
    temperature: float

    def apply(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with the log weights, their noisy keys and kept; one pass without a shuffle."""
        return self.decide(noisy(weigh(docs, self.ratios, text), text, self.temperature))

    def decide(self, keyed: DataFrame) -> DataFrame:
        both = (F.col("quality_key") >= self.bounds[0]) & (F.col("toxic_key") >= self.bounds[1])
        return keyed.withColumn("kept", F.coalesce(both, F.lit(False)))


def noisy(weighed: DataFrame, text: str, temperature: float) -> DataFrame:
    """Log weights with Gumbel noise from a hash of id and text, so reruns agree."""
    for seed, name in enumerate(("quality", "toxic")):
        even = (F.pmod(F.xxhash64("doc_id", text, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        weighed = weighed.withColumn(f"{name}_key", F.col(f"{name}_weight") - F.lit(temperature) * F.log(-F.log(even)))
    return weighed


def weigh(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with quality_weight and toxic_weight, logs of ratios of likelihoods; null without n-grams."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        sums, counts = [[np.zeros(0)], [np.zeros(0)]], [np.zeros(0)]
        for first, end, offsets, raw in slices(columns[0]):
            bucket, row = ngrams(offsets, raw)
            for k in range(2):
                sums[k].append(np.bincount(row, sent.value[bucket, k], end - first))
            counts.append(np.bincount(row, minlength=end - first))
        none = np.concatenate(counts) == 0
        return [pa.array(np.concatenate(s), pa.float64(), mask=none) for s in sums]

    return append(docs, "quality_weight double, toxic_weight double", [text], run)


def train(docs: DataFrame, labels: DataFrame, most: int = LABELS, temperature: float = TEMPERATURE,
          text: str = "text") -> tuple[Classifier, DataFrame]:
    """The classifier, and ``doc_id``, log weights, keys and kept of all rows of ``docs``."""
    sample = cut(label_classes(labels, most))  # at most ``most`` rows of an id and a number
    fitting = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    pairs = docs.select("doc_id", text)
    counts = bucket_counts(pairs.join(F.broadcast(sample.where(fitting)), "doc_id"), text, "label")
    ratios = log_ratios(counts)
    keyed = cut(noisy(weigh(pairs, ratios, text), text, temperature).drop(text))
    # an id may stand for many rows: one mean weight for each id of the bounded sample
    held = (keyed.join(F.broadcast(sample.where(~fitting)), "doc_id").where("quality_weight is not null")
            .groupBy("doc_id").agg(F.avg("quality_weight").alias("q"), F.avg("toxic_weight").alias("t"),
                                   F.max("label").alias("label")).toArrow())
    label = held["label"].to_numpy()
    cuts = (best_cut(held["q"].to_numpy(), label < 3),
            best_cut(held["t"].to_numpy()[label < 3], label[label < 3] == 1))
    sizes = keyed.agg(*[F.count(F.when(F.col(f"{n}_weight") >= c, 1)) for n, c in zip(("quality", "toxic"), cuts)]).first()
    filled = keyed.where("quality_key is not null")
    bounds = tuple(kth_largest(filled, f"{n}_key", k) for n, k in zip(("quality", "toxic"), sizes))
    made = Classifier(ratios, bounds, temperature)
    return made, made.decide(keyed)
