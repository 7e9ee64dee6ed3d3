"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Normal form: A-Z lower-cased, words of ASCII letters, digits and all characters beyond
ASCII, one space between words and at both ends.  The automaton holds every window of 13
consecutive item words (the whole item, if it is shorter) in that form and reads each text
once; ends of matches are mapped back to words, and words to characters of the original.

Defined cases: null or wordless texts have no words, no hits and are not contaminated; null or
wordless items have no window; windows of an item without id count as hits but not as
an item; items with the same id are one item; repeated documents are judged each for
itself; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import append

WINDOW = 13
SHARD_BYTES = 64 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACED = bytes(_LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split() if text else []


def normal_form(words: list[bytes]) -> str:
    """One character per UTF-8 byte, so the automaton sees a small alphabet."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows in normal form with their number of words and item ids."""

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, forms, counts = [], [], []
            for item, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
                words = normal_words(text)
                for k in range(max(1, len(words) - size + 1) if words else 0):
                    part = words[k:k + size]
                    ids.append(item)
                    forms.append(normal_form(part))
                    counts.append(len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(forms, pa.string()), pa.array(counts, pa.int32())],
                names=["item", "form", "words"])

    items = benchmark.select(F.col("item_id").cast("string"), "text")
    return (items.mapInArrow(cut_items, "item string, form string, words int").distinct()
            .groupBy("form", "words").agg(F.collect_list("item").alias("items")))


class Scanner:
    def __init__(self, entries: list[tuple[str, int, list[str]]]):
        self.automaton = ahocorasick.Automaton()
        for k, (form, _, _) in enumerate(entries):
            self.automaton.add_word(form, k)
        self.entries = entries
        if entries:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of words ``[first, end)``, merged and in order, and the items found."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.entries or not words:
            return spans, items
        form = normal_form(words)
        counted, at = 0, 0  # words that end before position ``at``
        for last, which in self.automaton.iter(form):
            counted += form.count(" ", at, last + 1)
            at = last + 1
            end = counted - 1
            _, length, names = self.entries[which]
            items.update(names)
            first = end - length
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append((first, end))
        return spans, items


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES,
         size: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, hits (runs of words), items and spans (characters of the original).

    The windows are sent to the executors; their total size is measured before.  Beyond
    ``shard_bytes`` they are dealt into shards by hash, one pass over the documents each, written
    in between, so no automaton is larger and no window is left out.
    """
    found = cut(windows(benchmark, size))
    total = found.agg(F.coalesce(F.sum(F.length("form") + F.size("items") * 16), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_bytes))
    ddl = ("n_words long, hits array<struct<first:int,end:int>>, items array<string>, "
           "spans array<struct<first:int,end:int>>")
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    context = docs.sparkSession.sparkContext
    for shard in range(shards):
        part = found if shards == 1 else found.where(F.pmod(F.xxhash64("form"), F.lit(shards)) == shard)
        sent = context.broadcast([(r["form"], r["words"], list(r["items"])) for r in part.collect()])
        more = shard > 0
        made: list[Scanner] = []

        def scan(columns: list[pa.Array], sent=sent, more=more, made=made) -> list[pa.Array]:
            if not made:
                made.append(Scanner(sent.value))
            before = [c.to_pylist() for c in columns[1:]]
            counts, hits, items, spans = [], [], [], []
            for k, value in enumerate(columns[0]):
                original = value.as_py()
                words = normal_words(original)
                runs, names = made[0].scan(words)
                if more:
                    runs = merge(runs + [(r["first"], r["end"]) for r in before[0][k]])
                    names |= set(before[1][k])
                counts.append(len(words))
                hits.append(runs)
                items.append(sorted(names))
                spans.append(original_spans(original, runs))
            as_runs = lambda rows: pa.array([[{"first": a, "end": b} for a, b in r] for r in rows], run_type)
            return [pa.array(counts, pa.int64()), as_runs(hits), pa.array(items, pa.list_(pa.string())), as_runs(spans)]

        if more:
            docs = cut(docs)
            kept = docs.withColumns({"__hits": F.col("hits"), "__items": F.col("items")})
            docs = append(kept, ddl, [text, "__hits", "__items"], scan).drop("__hits", "__items")
        else:
            docs = append(docs, ddl, [text], scan)
    return docs


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def original_spans(text: str | None, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character positions of runs of words in the original text."""
    if not runs:
        return []
    ends = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [(ends[first][0], ends[end - 1][1]) for first, end in runs]


def n_hit() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["first"])


def contaminated() -> F.Column:
    """The contract's rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(marked: DataFrame) -> DataFrame:
    return (marked.withColumn("n_hit", n_hit())
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", F.sort_array("items")).cast("binary"), 256).alias("items_sha256"),
                    contaminated().alias("contaminated")))
