"""Language-model scores: prediction by partial matching over bytes, beside a unigram base.

Training counts all byte strings of length ``ORDER + 1`` of the training texts (A-Z lower-cased as for the
base; a text starts behind
and ends with the mark 0xFF, which UTF-8 never uses).  Summed up by suffix they make the trie:
a node is a context of up to ``ORDER`` bytes, the most recent byte first.  A symbol is coded in
the longest context known; a context with ``n`` occurrences of ``d`` symbols gives each seen symbol
(count - 1/2) / n and the escape d / 2n.  After an escape the symbols of the longer context
are excluded from the shorter one's counts (symbol exclusion), down to an even choice among bytes never seen.
The excluded set of a context depends on the context alone, so the code length of every (context,
symbol) is worked out once, and scoring a text is array look-ups.

The most frequent contexts are sent to the tasks: all above a count chosen so that at most ``NODES`` remain.
Longer ones are frequent only if their suffixes are, so a trie is left.  The other contexts stay a table.  A
byte whose context may go on in there is not scored by the task: it hands on its byte string, and the
code lengths of the distinct ones are worked out by a join with the table, so no context is left out.

Word counts of the base have no bound.  The most frequent words, at most ``HEAD``, are sent to the tasks;
tokens with any other word are joined with the table of the remaining counts.

Defined cases: null texts are empty (one end token); null ids count as empty ids; repeated rows are scored
each; without training texts the base is spread evenly and the model an even choice of bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import FOLD, append, slices, spaced_words

ORDER = 5
NODES = 1 << 17
HEAD = 1 << 20
MARK = 255
PIECE = 2 << 20
WORD_TYPE = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))
GRAM_TYPE = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64()), ("cost", pa.float64()), ("beyond", pa.float64()),
                                ("seen", pa.bool_())]))
GRAM_DDL = "array<struct<gram:long,n:long,cost:double,beyond:double,seen:boolean>>"


def marked(offsets: np.ndarray, raw: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, A-Z lower-cased, with ``order`` marks around each; positions of the symbols (text and one mark) and their rows."""
    n = len(offsets) - 1
    out = np.full(len(raw) + order * (n + 1), MARK, np.uint8)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    out[np.arange(len(raw)) + order * (row + 1)] = FOLD[raw]
    rows = np.repeat(np.arange(n), lengths + 1)
    at = np.arange(len(rows)) + order + rows * (order - 1)
    return out, at, rows


def settle(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(counts, new)


def counted(docs: DataFrame, text: str, order: int) -> tuple[DataFrame, DataFrame]:
    """``(gram, n)`` of byte strings and ``(word, n)`` of hashed words, over all rows of ``docs``.

    Each task adds up what it reads before the shuffle and hands on its counts when they become many.
    """

    def counts_of(kind: str):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for batch in batches:
                for _, _, offsets, raw in slices(batch.column(0), PIECE):
                    if kind == "gram":
                        whole, at, _ = marked(offsets, raw, order)
                        key = np.zeros(len(at), np.int64)
                        for k in range(order, -1, -1):
                            key = (key << 8) | whole[at - k]
                    else:
                        key = spaced_words(offsets, raw)[0].view(np.int64)
                    if len(key):
                        held.append(np.unique(key, return_counts=True))
                        size += len(held[-1][0])
                    if size > PIECE:
                        held = [settle(held)]
                        size = len(held[0][0])
                        if size > PIECE // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=[kind, "n"])
                            held, size = [], 0
            if held:
                key, n = settle(held)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=[kind, "n"])

        return docs.select(text).mapInArrow(count, f"{kind} long, n long").groupBy(kind).agg(F.sum("n").alias("n"))

    return counts_of("gram"), counts_of("word")


def at_least(counts: DataFrame, most: int) -> int:
    """Smallest count, on a scale of quarter powers of two, that at most ``most`` rows reach."""
    quarter = F.floor(F.log2("n") * 4).cast("int")
    rows = 0
    level = 1 << 10
    for r in counts.groupBy(quarter.alias("q")).agg(F.count("*").alias("rows")).orderBy(F.desc("q")).collect():
        rows += r["rows"]
        if rows > most:
            break
        level = r["q"]
    return level


class Trie:
    """Code lengths (log10) of every kept context and symbol, and the step to a longer context.

    ``open`` tells which contexts have longer ones that are not kept.
    """

    def __init__(self, depth: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, order: int):
        self.order = order
        seen = np.unique(symbol[depth == 0])
        self.place = np.full(256, len(seen), np.int64)  # the last place is for bytes never seen
        self.place[seen] = np.arange(len(seen))
        self.width = wide = len(seen) + 1
        unseen = -math.log10(max(1, 256 - len(seen)))
        if not len(seen):
            self.cost, self.child = np.full(1, unseen, np.float32), np.zeros(1, np.int32)
            self.open, self.seen = np.zeros(1, bool), np.zeros(1, bool)
            self.total, self.escape = np.ones(1), np.zeros(1)
            return
        keys = depth.astype(np.int64) << 56 | context
        nodes = np.unique(keys)
        which = np.searchsorted(nodes, keys)
        level, suffix = nodes >> 56, nodes & ((1 << 56) - 1)
        counts = np.zeros((len(nodes), wide), np.float32)
        counts[which, self.place[symbol]] = n
        held, longer = np.bincount(which, n, len(nodes)), np.zeros(len(nodes))
        total, kinds = counts.sum(axis=1, dtype=np.float64), (counts > 0).sum(axis=1).astype(np.float64)
        escape = np.log10(kinds / (2 * total))
        cost = np.empty_like(counts)
        child = np.zeros((len(nodes), wide), np.int32)
        cost[0] = np.where(counts[0] > 0, np.log10((np.maximum(counts[0], 1) - 0.5) / total[0]), escape[0] + unseen)
        for k in range(1, order + 1):
            ids = np.flatnonzero(level == k)
            if not len(ids):
                break
            older = (suffix[ids] >> (8 * (k - 1))) & 255
            up = np.searchsorted(nodes, (k - 1) << 56 | suffix[ids] & ((1 << (8 * (k - 1))) - 1))
            child[up, self.place[older]] = ids
            np.add.at(longer, up, held[ids])
            for part in np.array_split(np.arange(len(ids)), max(1, len(ids) // 8192)):
                own, par = ids[part], up[part]
                has, above = counts[own] > 0, counts[par]
                mass = total[par] - np.where(has, above, 0).sum(axis=1, dtype=np.float64)
                fresh = kinds[par] - kinds[own]
                beyond = cost[par] - escape[par, None]  # for symbols that the parent has not seen either
                with np.errstate(divide="ignore", invalid="ignore"):
                    there = np.log10(np.maximum(above, 1) - 0.5) - np.log10(mass)[:, None]
                    below = np.where((fresh > 0)[:, None], np.log10(fresh / (2 * mass))[:, None], 0.0) + beyond
                    mine = np.log10((np.maximum(counts[own], 1) - 0.5) / total[own, None])
                cost[own] = np.where(has, mine, escape[own, None] + np.where(above > 0, there, below))
        self.cost, self.child = cost.ravel(), child.ravel()
        self.open, self.seen = (longer < held) & (level < order), (counts > 0).ravel()
        self.total, self.escape = np.log10(total), escape

    def score(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """log10 probability of each text, its end included, without the bytes in open contexts.

        These follow as byte strings: where each text's begin, and the columns of ``GRAM_DDL`` (the string, how often
        the text has it, its code length if no longer context is known, the one behind an escape from a longer
        context, less that escape's share, and whether the kept context has seen the symbol).
        """
        whole, at, rows = marked(offsets, raw, self.order)
        symbol = self.place[whole]
        node = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for k in range(1, self.order + 1):
            step = self.child[node[live] * self.width + symbol[at[live] - k]]
            live, step = live[step > 0], step[step > 0]
            if not len(live):
                break
            node[live] = step
        texts, place = len(offsets) - 1, node * self.width
        place += symbol[at]
        ends, cost = self.open[node], self.cost[place]
        cost[ends] = 0
        total = np.bincount(rows, cost, texts)
        at, rows, node, place = at[ends], rows[ends], node[ends], place[ends]
        gram = np.zeros(len(at), np.int64)
        for k in range(self.order, -1, -1):
            gram = (gram << 8) | whole[at - k]
        by = np.lexsort((gram, rows))
        first = np.flatnonzero(np.r_[True, (np.diff(rows[by]) != 0) | (np.diff(gram[by]) != 0)][:len(by)])
        one = by[first]
        cost, seen, node = self.cost[place[one]].astype(np.float64), self.seen[place[one]], node[one]
        beyond = np.where(seen, cost + self.total[node], cost - self.escape[node])
        begins = np.searchsorted(rows[one], np.arange(texts + 1))
        return total, begins, [gram[one], np.diff(np.r_[first, len(by)]), cost, beyond, seen]


class Model:
    """What is sent to the tasks; the trie is put together there once for each Python worker."""

    def __init__(self, entries: tuple, order: int, words: np.ndarray, counts: np.ndarray, tokens: int,
                 distinct: int, ends: int):
        self.entries, self.order, self.words, self.counts = entries, order, words, counts
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        self.made: Trie | None = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    @property
    def trie(self) -> Trie:
        if self.made is None:
            self.made = Trie(*self.entries, self.order)
        return self.made

    def log_share(self, c):
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def look_up(self, word: np.ndarray) -> np.ndarray:
        """Count of each hashed word of the head, 0 for others."""
        if not len(self.words):
            return np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, self.counts[at], 0)


class Rest(NamedTuple):
    """What the model does not hold itself: counts ``(word, n)`` of words, and contexts (see :func:`rare_contexts`)."""

    words: DataFrame
    contexts: DataFrame


def low_bytes(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k * 8) - 1


def rare_contexts(symbols: DataFrame, contexts: DataFrame, rare: Column) -> DataFrame:
    """Contexts that are ``rare``, with the counts of their symbols and what symbol exclusion leaves of the next
    shorter context: ``mass`` occurrences of ``fresh`` symbols."""
    up = F.col("context").bitwiseAND(low_bytes(F.col("k") - 1))
    same = Window.partitionBy("k", "up", "symbol")  # a shorter context's count is the sum over its longer ones
    above = symbols.where("k > 0").withColumn("up", up).withColumn("above", F.sum("n").over(same))
    chosen = contexts.where(rare).select("k", "context")
    shorter = contexts.select((F.col("k") + 1).alias("k"), F.col("context").alias("up"), F.col("n").alias("n_up"),
                              F.col("kinds").alias("kinds_up"))
    return (above.join(chosen, ["k", "context"]).groupBy("k", "context", "up")
            .agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("above").alias("above"),
                 F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("counts"))
            .join(shorter, ["k", "up"])
            .select("k", "context", "total", "kinds", "counts", (F.col("n_up") - F.col("above")).alias("mass"),
                    (F.col("kinds_up") - F.col("kinds")).alias("fresh")))


def code_lengths(grams: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """``(gram, length)`` of distinct byte strings in open contexts, over the ``contexts`` that are not kept.

    The rare contexts of a string, longest first, are gone through as in the trie: the symbol is coded in the first one that
    has seen it, after an escape from each before; then the kept context takes its turn.
    """
    symbol = F.col("gram").bitwiseAND(255).cast("int")
    k = F.col("k")
    asked = (grams.select("gram", F.explode(F.sequence(F.lit(1), F.lit(order))).alias("k"))
             .withColumn("context", F.shiftright("gram", 8).bitwiseAND(low_bytes(k))))
    left = F.when(F.col("fresh") > 0, F.log10(F.col("fresh") / (F.lit(2.0) * F.col("mass")))).otherwise(0.0)
    level = F.struct((-k).alias("k"), F.try_element_at("counts", symbol).cast("double").alias("n"), "total",
                     F.log10(F.col("kinds") / (F.lit(2.0) * F.col("total"))).alias("escape"),
                     F.log10("mass").alias("mass"), left.alias("left"))
    found = (asked.join(contexts, ["k", "context"]).groupBy("gram")
             .agg(F.sort_array(F.collect_list(level)).alias("levels")))
    levels = F.col("levels")
    at = F.coalesce(F.array_position(F.transform(levels, lambda x: x["n"].isNotNull()), True), F.lit(0)).cast("int")
    some, last = at > 0, F.element_at(levels, -1)
    own = F.get(levels, at - 1)
    passed = F.when(some, at - 2).otherwise(F.size(levels) - 1)  # escapes between the first context and the one that tells
    steps = F.aggregate(F.slice(levels, F.lit(1), F.greatest(passed, F.lit(0))), F.lit(0.0), lambda t, x: t + x["left"])
    ahead = levels[0]["escape"] + steps
    rare = (F.when(at == 1, F.log10((own["n"] - 0.5) / own["total"]))
            .when(some, ahead + F.log10(own["n"] - 0.5) - F.get(levels, at - 2)["mass"])
            .when(F.col("seen"), ahead + F.col("beyond") - last["mass"])
            .otherwise(ahead + last["left"] + F.col("beyond")))
    return (grams.join(found, "gram", "left")
            .select("gram", F.when(levels.isNull(), F.col("cost")).otherwise(rare).alias("length")))


def train(docs: DataFrame, text: str = "text", order: int = ORDER, nodes: int = NODES,
          head: int = HEAD) -> tuple[Model, Rest]:
    """The model, and the words and contexts that it does not hold itself."""
    grams, words = (cut(x) for x in counted(docs, text, order))
    mask = F.expr("shiftleft(1L, k * 8) - 1")
    symbols = (grams.select(F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k"), "gram", "n")
               .select("k", F.shiftright("gram", 8).bitwiseAND(mask).alias("context"),
                       F.col("gram").bitwiseAND(255).cast("int").alias("symbol"), "n")
               .groupBy("k", "context", "symbol").agg(F.sum("n").alias("n")))
    symbols = cut(symbols)
    contexts = symbols.groupBy("k", "context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    level = at_least(contexts, nodes)
    common = (F.floor(F.log2("n") * 4) >= level) | (F.col("k") == 0)
    kept = contexts.where(common).select("k", "context")
    table = symbols.join(F.broadcast(kept), ["k", "context"]).toArrow()  # at most ``nodes`` contexts, 256 symbols each
    entries = tuple(table[c].to_numpy() for c in ("k", "context", "symbol", "n"))
    summary = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    ends = docs.count()
    level = at_least(words, head)
    often = F.floor(F.log2("n") * 4) >= level
    top = words.where(often).toArrow()
    hashed, n = top["word"].to_numpy(), top["n"].to_numpy()
    by_hash = np.argsort(hashed)
    model = Model(entries, order, hashed[by_hash], n[by_hash], int(summary["tokens"] or 0) + ends,
                  summary["distinct"] + (ends > 0), ends)
    return model, Rest(words.where(~often), rare_contexts(symbols, contexts, ~common))


def score(docs: DataFrame, model: Model, rest: Rest, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        m: Model = sent.value
        tokens, known, base, scores, others, grams = [], [], [], [], [], []
        end = m.log_share(m.ends)
        for first, last, offsets, raw in slices(columns[0], PIECE // 2):
            words, at = spaced_words(offsets, raw)
            words = words.view(np.int64)
            c = m.look_up(words)
            rows = np.repeat(np.arange(last - first), np.diff(at))
            n = last - first
            tokens.append(np.diff(at) + 1)
            known.append(np.bincount(rows, c > 0, n).astype(np.int64) + (m.ends > 0))
            base.append(np.bincount(rows, np.where(c > 0, m.log_share(c), 0.0), n) + end)
            total, begins, strings = m.trie.score(offsets, raw)
            scores.append(total)
            grams.append(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(x) for x in strings], names=["gram", "n", "cost", "beyond", "seen"])))
            absent = c == 0
            lengths = np.bincount(rows[absent], minlength=n)
            others.append((np.r_[0, np.cumsum(lengths)], words[absent]))
        listed = [[{"word": w, "n": 1} for w in word[a:b].tolist()]
                  for at, word in others for a, b in zip(at[:-1], at[1:])]
        whole = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        return [whole(tokens, pa.int64()), whole(known, pa.int64()), whole(base, pa.float64()),
                whole(scores, pa.float64()), pa.array(listed, WORD_TYPE),
                pa.concat_arrays(grams) if grams else pa.array([], GRAM_TYPE)]

    ddl = ("n_tokens long, __known long, __base double, __score double, "
           f"__others array<struct<word:long,n:long>>, __grams {GRAM_DDL}")
    scored = cut(append(docs, ddl, [text], run).drop(text)).withColumn("__row", F.monotonically_increasing_id())
    others = (scored.select("__row", F.explode("__others").alias("o"))
              .groupBy("__row", F.col("o.word").alias("word")).agg(F.sum("o.n").alias("times")))
    c = F.coalesce(F.col("n"), F.lit(0))
    share = F.log10((c + F.lit(0.1)) / F.lit(model.tokens + 0.1 * (model.distinct + 1)))
    told = (others.join(rest.words, "word", "left")
            .select("__row", (F.col("times") * share).alias("base"), F.when(c > 0, F.col("times")).alias("also"),
                    F.lit(None).cast("double").alias("part")))
    grams = scored.select("__row", F.inline("__grams"))
    distinct = grams.groupBy("gram").agg(*[F.max(x).alias(x) for x in ("cost", "beyond", "seen")])
    coded = (grams.select("__row", "gram", "n").join(code_lengths(distinct, rest.contexts, model.order), "gram")
             .select("__row", F.lit(None).cast("double").alias("base"), F.lit(None).cast("long").alias("also"),
                     (F.col("n") * F.col("length")).alias("part")))
    added = (told.unionByName(coded).groupBy("__row")
             .agg(F.sum("base").alias("__more"), F.sum("also").alias("__also"), F.sum("part").alias("__part")))
    return (scored.drop("__others", "__grams").join(added, "__row", "left")
            .withColumn("n_known", F.col("__known") + F.coalesce("__also", F.lit(0)))
            .withColumn("train_tokens", F.lit(model.tokens).cast("long"))
            .withColumn("base_score", F.col("__base") + F.coalesce("__more", F.lit(0.0)))
            .withColumn("score", F.col("__score") + F.coalesce("__part", F.lit(0.0)))
            .drop("__row", "__known", "__base", "__score", "__more", "__also", "__part"))
