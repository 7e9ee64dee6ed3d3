"""Chat formatting with prefix-target examples, by DataFrame functions only.

Every assistant turn becomes an example: its context is all that came before in the
conversation, and only its own text is trainable.  The examples of a conversation are
prefixes of one another, so each one stores only what it adds to the one before
(``new_text``) and how many characters precede it (``context_chars``); the size of what is kept
is that of the input and not its square.  ``full_text`` writes the whole examples, each with its
context, and ``read_back`` reads these.

A turn is written ``<|im_start|>role\\n text <|im_end|>\\n``.  In texts and roles a backslash
comes before each backslash and inside each ``<|`` (``<\\|``), in roles also before a line
break, so no text can close or open a turn; reading drops one backslash before each
character that it marks.

Defined cases: turns go by number, nulls first, then role and text; null role and text are
empty; null conversation ids are one conversation; turns after the last assistant turn are
kept as an example without trainable text; repeated rows are repeated turns; an empty table
gives no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sum

START, END = "<|im_start|>", "<|im_end|>"
TURN_BLOCK = 1024


def escape(column: Column | str) -> Column:
    doubled = F.regexp_replace(column, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"<\|", r"<\\|")


def escape_role(column: Column | str) -> Column:
    return F.regexp_replace(escape(column), "\n", "\\\\\n")


def unescape(column: Column) -> Column:
    return F.regexp_replace(column, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, context_turns, context_chars, new_text, loss_start, loss_end.

    ``loss_start`` and ``loss_end`` are character positions in ``new_text``, null where nothing
    is trainable.  Turns are numbered block-wise by turn number, so one conversation with
    many rows is not one task; only the turns of one example meet in a row, its text.
    """
    rows = turns.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("__conv"),
        F.col("conv_id").isNull().alias("__none"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-(1 << 62))).cast("long")
    reply = (F.col("role") == "assistant").cast("long")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = running_sum(rows, ["__conv", "__none"], block, order, {"example": reply})
    opened = F.concat(F.lit(START), escape_role("role"), F.lit("\n"))
    written = numbered.select(
        "conv_id", "__conv", "__none", "example", "turn", "role", "text",
        F.concat(opened, escape("text"), F.lit(END + "\n")).alias("segment"),
        F.when(reply == 1, F.length(escape("text"))).alias("loss"))
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "segment", "loss")))
    closing = F.length(F.lit(END + "\n"))
    told = (written.groupBy("__conv", "__none", "example")
            .agg(F.first("conv_id").alias("conv_id"), parts.alias("parts"))
            .select("conv_id", "__conv", "__none", "example", F.size("parts").alias("turns"),
                    F.concat_ws("", "parts.segment").alias("new_text"),
                    F.element_at("parts.loss", -1).alias("loss"))
            .withColumn("loss_end", F.when(F.col("loss").isNotNull(), F.length("new_text") - closing))
            .withColumn("loss_start", F.col("loss_end") - F.col("loss")))
    block = F.floor(F.col("example") / TURN_BLOCK)
    counted = running_sum(told, ["__conv", "__none"], block, [F.col("example")],
                          {"context_chars": F.length("new_text").cast("long"), "context_turns": F.col("turns").cast("long")})
    return counted.select("conv_id", "example", "context_turns", "context_chars", "new_text", "loss_start", "loss_end")


def full_text(parts: DataFrame) -> DataFrame:
    """Whole text of every example, context included: ``conv_id, example, text, loss_start, loss_end, last``.

    Positions are those in ``text``; ``last`` marks the example that holds the whole conversation.  A conversation's
    parts are exchanged once and meet in one row; its examples are written from there one after the other, so their
    size, the square of a conversation's, passes through but is neither held nor exchanged.
    """
    whole = F.sort_array(F.collect_list(F.struct("example", "new_text", "loss_start", "loss_end", "context_chars")))
    each = (parts.groupBy("conv_id").agg(whole.alias("parts"))
            .select("conv_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k")))
    own = F.element_at("parts", F.col("k"))
    return each.select(
        "conv_id", own["example"].alias("example"),
        F.concat_ws("", F.slice(F.col("parts.new_text"), F.lit(1), F.col("k"))).alias("text"),
        (own["context_chars"] + own["loss_start"]).alias("loss_start"),
        (own["context_chars"] + own["loss_end"]).alias("loss_end"), (F.col("k") == F.size("parts")).alias("last"))


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation as read from its whole examples and their loss spans.

    The turns are those of the longest example.  A digest is that of one string, so the trained texts of a
    conversation meet in one row here.
    """
    segments = F.filter(F.split("text", r"<\|im_end\|>\n", -1), lambda s: s != "")
    role = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*)$"
    turns = F.transform(segments, lambda s: F.concat(
        unescape(F.regexp_extract(s, role, 1)), F.lit("\n"), unescape(F.regexp_extract(s, role, 2)), F.lit("\n")))
    trained = F.col("loss_start").isNotNull()
    start, end = F.col("loss_start").cast("int"), F.col("loss_end").cast("int")
    read = full_text(parts).select(
        "conv_id", "example", F.when(trained, unescape(F.substring("text", start + 1, end - start))).alias("lost"),
        F.when(trained, F.length("text")).cast("long").alias("chars"),
        F.when(F.col("last"), F.struct(turns.alias("turns"), F.length("text").cast("long").alias("chars"))).alias("whole"))
    read = read.select("conv_id", "example", "lost", "chars", F.size("whole.turns").cast("long").alias("n_turns"),
                       F.sha2(F.concat_ws("", "whole.turns").cast("binary"), 256).alias("turns_sha256"),
                       F.col("whole.chars").alias("formatted_chars"), F.col("whole").isNotNull().alias("last"))
    at_last = lambda c: F.max(F.when(F.col("last"), F.col(c))).alias(c)
    losses = F.sort_array(F.collect_list(F.when(F.col("lost").isNotNull(), F.struct("example", "lost"))))
    return (read.groupBy("conv_id")
            .agg(at_last("n_turns"), at_last("turns_sha256"), losses.alias("losses"), at_last("formatted_chars"),
                 F.count("lost").alias("n_examples"), F.coalesce(F.sum("chars"), F.lit(0)).alias("example_chars"))
            .withColumn("__lost", F.concat_ws("", "losses.lost"))
            .select("conv_id", "n_turns", "turns_sha256", F.length("__lost").cast("long").alias("loss_chars"),
                    F.sha2(F.col("__lost").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_examples",
                    "example_chars"))
