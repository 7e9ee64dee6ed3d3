"""Mixing sources to target weights, by DataFrame functions only.

Every document gets a random key from a hash of its id.  Within a source documents are
put in the order of their keys, a distributed prefix sum adds up their word counts, and
the source is cut at exactly its budget; a budget above the source's size first takes the
source as a whole, once or several times.

Defined cases: a null text has no words and is never taken; a null source is a source of
its own, after all others; a null id has the key of an empty id; equal rows stay separate
rows; an empty table gives an empty mix; when nothing has words all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import WORD, running_sum

WHOLE = "decimal(38,0)"


def targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """Target of every source, ``(__source, source_size, target)``, from one row a source.

    The words of all sources are shared by weight.  A source stops at ``epochs`` times its
    size; what is left is shared among the others, until none is above.  Sources in the
    order of size to weight fill up one after the other, so running totals over the table
    of sources find the level.  The table has a row for each source, to which somebody has
    given a weight; it is the only one ordered as a whole.
    """
    by_name = Window.orderBy("__source")
    total = Window.partitionBy()
    weighed = (sizes.withColumn("__rank", F.row_number().over(by_name) - 1)
               .withColumn("__weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                                    (F.col("__rank") % len(weights) + 1).cast("int")))
               .withColumn("__cap", F.col("source_size").cast(WHOLE) * epochs)
               .withColumn("__total", F.sum(F.col("source_size").cast(WHOLE)).over(total)))
    by_fill = Window.orderBy(F.col("__cap").cast("double") / F.col("__weight"), "__rank")
    below = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    above = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (weighed
              .withColumn("__left", F.col("__total") - F.coalesce(F.sum("__cap").over(below), F.lit(0)))
              .withColumn("__shares", F.sum("__weight").over(above))
              .withColumn("__full", F.col("__left") * F.col("__weight") >= F.col("__cap") * F.col("__shares")))
    level = F.min_by(F.struct("__left", "__shares"), F.when(~F.col("__full"), F.col("__shares") * -1)).over(total)
    return (filled.withColumn("__level", level)
            .select("__source", "source_size",
                    F.when(F.col("__full"), F.col("__cap").cast("double"))
                    .otherwise((F.col("__weight") * F.col("__level.__left")).cast("double")
                               / F.col("__level.__shares").cast("double")).alias("target")))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = 3, seed: str = "") -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, repeats, part, taken.

    The mix holds the document's text ``repeats`` times as a whole and its first ``part``
    words once more; ``taken`` counts these words.  The words taken of a source add up to
    its target, rounded down.

    Ids, sources, sizes and keys are written once to the checkpoint folder; the texts are
    read once and never shuffled.  The first three digits of the key cut each source into
    4096 even blocks, whose sums make the prefix sums.
    """
    text_key = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = cut(docs.select(
        "doc_id", "source",
        F.when(F.col("source").isNull(), "2").otherwise(F.concat(F.lit("1"), "source")).alias("__source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(text_key.cast("binary")).alias("__key")))
    wanted = targets(sized.groupBy("__source").agg(F.sum("size").alias("source_size")), weights, epochs)
    placed = running_sum(sized, ["__source"], F.substring("__key", 1, 3), [F.col("__key"), F.col("doc_id"), F.col("size")],
                         {"__earlier": F.col("size")})
    # one row per source and block carries the targets, so that a large source is no hot key of the join
    spread = sized.select("__source", F.substring("__key", 1, 3).alias("__piece")).distinct().join(wanted, "__source")
    budget = F.floor("target")
    joined = placed.withColumn("__piece", F.substring("__key", 1, 3)).join(spread, ["__source", "__piece"])
    return (joined
            .withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")))
                        .otherwise(F.lit(0)).cast("long"))
            .withColumn("__rest", budget - F.col("repeats") * F.col("source_size"))
            .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__earlier"))).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "repeats", "part",
                    (F.col("repeats") * F.col("size") + F.col("part")).alias("taken")))
