"""Merkle manifest of a dataset by a nested-struct rollup, DataFrame functions only.

Rows become leaves.  Within a group (a source) leaves are ranked; the digits of a rank in the tree's
fan-out are the places of the row's ancestors.  Digit columns are grouped away one after the other inside
blocks of ``fan_out ** LEVELS`` ranks: a node's struct holds its digest and the structs of its children, so
a block is one row of bounded size and all its levels take one shuffle.  Block digests are the leaves of the
next tier, which is rolled up in the same way; the digests of the groups, in the order of the groups, make
the last tree.  Proofs are read off the nested structs from the top down by ``transform`` and ``explode``:
inside a block no join is needed.  Only the part of a path above a block, one row a block, is joined to it.

Defined cases: a null in a field counts as ``-``; a null group is a group of its own before all others; null
ids come before others; rows with one id are ordered by their leaf, equal rows stay separate leaves; a group
with one row has its leaf as digest; texts of any length are hashed whole; an empty table gives no rows;
other columns of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import ascii_lower

FAN_OUT = 16
LEVELS = 3


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """Length in bytes, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return sha(F.concat(*[field(f) for f in fields]))


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with their rank (from 0) within ``group`` and ``nodes``, the size of the group.

    Rows are dealt out by ranges of (group, order), a large group to many tasks, and written once; ranks
    inside a task are added to the sizes of the tasks before.  Equal rows are dealt out by chance.
    """
    dealt = rows.withColumn("__tie", F.rand(0)).repartitionByRange(*group, *order, "__tie").drop("__tie")
    dealt = cut(dealt.withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group, "__part").agg(F.count("*").alias("__size"))
    offsets = sizes.select(*group, "__part", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"),
                           F.sum("__size").over(Window.partitionBy(*group)).alias("nodes"))
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    return (dealt.join(offsets, [*group, "__part"])
            .withColumn("rank", F.col("__before") + F.row_number().over(inside) - 1).drop("__part", "__before"))


def rolled_up(nodes: DataFrame, group: Sequence[str], fan_out: int, levels: int) -> DataFrame:
    """One row a block of ``fan_out ** levels`` ranks: (group, nodes, at, digest, below).

    ``nodes`` has (group, rank, nodes, digest, below); ``below`` of the result is the run of child structs
    (digit, digest, below).  A level at which the group has one node only passes it on.
    """
    size = fan_out ** levels
    rows = nodes.select(*group, "nodes", F.floor(F.col("rank") / size).alias("__block"), F.col("rank").alias("at"),
                        "digest", "below").repartition(*group, "__block")
    for level in range(levels):
        child = F.struct((F.col("at") % fan_out).alias("digit"), "digest", "below")
        above = F.floor(F.col("at") / fan_out)
        rows = rows.groupBy(*group, "nodes", "__block", above.alias("at")).agg(
            F.array_sort(F.collect_list(child), lambda a, b: (a["digit"] - b["digit"]).cast("int")).alias("below"))
        digests = F.transform("below", lambda node: node["digest"])
        digest = F.when(F.col("nodes") > fan_out ** level, sha(F.array_join(digests, ""))).otherwise(digests[0])
        rows = rows.withColumn("digest", digest)
    return rows.drop("__block")


def tree(nodes: DataFrame, group: Sequence[str], fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """The blocks of :func:`rolled_up` with the group's digest ``top`` and the ``path`` above each block."""
    blocks = cut(rolled_up(nodes, group, fan_out, levels))
    last = blocks.agg(F.max("at")).first()[0]
    if not last:  # each group is one block
        nothing = F.array().cast("array<struct<before:string,after:string>>")
        return blocks.withColumns({"path": nothing, "top": F.col("digest")})
    size = fan_out ** levels
    upper = tree(blocks.select(*group, F.col("at").alias("rank"), F.ceil(F.col("nodes") / size).alias("nodes"), "digest",
                               F.struct("at").alias("below")), group, fan_out, levels)
    above = leaves(upper, group, fan_out, levels).select(*group, F.col("below.at").alias("at"), "path", "top")
    return blocks.join(above, [*group, "at"])


def leaves(blocks: DataFrame, group: Sequence[str], fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """One row a leaf: (group, digest, below, path, top); ``path`` has the siblings before and after, from below."""
    rows = blocks.select(*group, "nodes", "below", "path", "top")
    for level in reversed(range(levels)):
        digests = F.transform("below", lambda node: node["digest"])
        step = F.transform("below", lambda node, k: F.struct(
            node["digest"].alias("digest"), node["below"].alias("below"),
            F.array_join(F.slice(F.col("__digests"), F.lit(1), k), "").alias("before"),
            F.array_join(F.slice(F.col("__digests"), k + 2, F.lit(fan_out)), "").alias("after")))
        rows = (rows.withColumn("__digests", digests)
                .select(*group, "nodes", "top", "path", F.explode(step).alias("__node"))
                .select(*group, "nodes", "top", F.col("__node.digest").alias("digest"), F.col("__node.below").alias("below"),
                        F.when(F.col("nodes") > fan_out ** level, F.concat(
                            F.array(F.struct("__node.before", "__node.after")), F.col("path"))).otherwise(F.col("path")).alias("path")))
    return rows.drop("nodes")


def fold(start: Column, path: str = "path") -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda node, step: sha(F.concat(step["before"], node, step["after"])))


def proof_digest(path: str = "path") -> Column:
    return sha(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))


def manifest(rows: DataFrame, group: Column, order: Column, fields: Sequence[Column], keep: dict[str, Column],
             fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root and path of every row, with the ``keep`` columns by name.

    ``order`` ranks the rows of a ``group``; ``fields`` are hashed into the leaf.  Texts are read once and
    never shuffled.
    """
    named = F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group.cast("string")))  # null first
    items = rows.select(named.alias("__group"), order.alias("__order"), leaf(fields).alias("digest"),
                        F.struct(*[column.alias(name) for name, column in keep.items()]).alias("below"))
    blocks = tree(ranked(items, ["__group"], ["__order", "digest"]), ["__group"], fan_out, levels)
    groups = ranked(blocks.where("at = 0").select("__group", F.col("top").alias("digest")), [], ["__group"])
    above = leaves(tree(groups.withColumn("below", F.struct("__group")), [], fan_out, levels), [], fan_out, levels)
    above = above.select("below.__group", F.col("path").alias("__above"), F.col("top").alias("root"))
    joined = blocks.join(above, "__group").withColumn("path", F.concat("path", "__above"))
    roots = joined.withColumn("top", F.struct(F.col("top").alias("subroot"), "root"))
    return leaves(roots, [], fan_out, levels).select("below.*", F.col("digest").alias("leaf"), "top.subroot", "top.root", "path")


def audited(docs: DataFrame, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents, each checked against a copy whose text may be tampered with.

    Rows whose id's crc32 is divisible by 5 have the letters A-Z of their text lower-cased in the copy; the
    copy's leaf is folded up the original path, and ``verified`` says whether the root comes out.
    """
    def fields(text: Column) -> list[Column]:
        return [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    copy = F.when(tampered, leaf(fields(ascii_lower("text"))))
    made = manifest(docs, F.col("source"), F.col("doc_id"), fields(F.col("text")),
                    {"doc_id": F.col("doc_id"), "copy": copy}, fan_out, levels)
    return (made.withColumns({"proof_sha256": proof_digest(), "folded_root": fold(F.coalesce("copy", "leaf"))})
            .withColumn("verified", F.col("folded_root") == F.col("root")))
