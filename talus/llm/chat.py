"""Prefix-target expansion of conversations into training examples.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its text is trainable. A turn reads

    <|im_start|>role NEWLINE text<|im_end|>NEWLINE

and texts are escaped so that none can forge such a mark: a backslash before
each backslash and between ``<`` and ``|``; in a role, a line break becomes a
backslash with n. ``read_back`` undoes that and recovers the turns.

Turns after the last assistant turn, and conversations without one, would be
in no example; they end in one row without a trainable span, so the output
holds every turn. Examples repeat their context by definition, so the output
grows with the square of the turns of one conversation; a conversation is
streamed through one window, and reading back keeps its longest example only.

A null text or role is empty, turns that share a number come in the order of
role and text, repeated rows stay, and a null conversation id is one
conversation. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(text: Column) -> Column:
    return F.replace(escaped(text), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(text: Column) -> Column:
    # a backslash pair is kept apart while \n is undone
    pairs = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pairs, lambda p: unescaped(F.replace(p, F.lit("\\n"), F.lit("\n")))), "\\")


def expand(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant"
) -> DataFrame:
    """conv_id, example (turns in it), formatted, loss_start, loss_end (code points; null without a trainable turn)."""
    own = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    piece = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = own.withColumn("piece", piece).select(
        "conv_id",
        F.row_number().over(order).cast("bigint").alias("example"),
        (F.col("role") == target).alias("trained"),
        F.lead(F.lit(1)).over(order).isNull().alias("last"),
        F.length(escaped(F.col("text"))).alias("size"),
        F.collect_list("piece").over(upto).alias("pieces"),
    )
    full = rows.where("trained OR last").withColumn("formatted", F.array_join("pieces", ""))
    stop = F.when(F.col("trained"), F.length("formatted") - len(END)).cast("bigint")
    return full.select("conv_id", "example", "formatted", (stop - F.col("size")).alias("loss_start"), stop.alias("loss_end"))


def turns_of(formatted: Column) -> Column:
    """(role, text) of each turn of an example."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    body = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, len(START) + 1, F.length(p)))

    def parted(p: Column) -> Column:
        at = F.instr(p, "\n")
        return F.struct(
            _unescaped_role(F.substring(p, 1, at - 1)).alias("role"), unescaped(F.substring(p, at + 1, F.length(p))).alias("text")
        )

    return F.transform(body, parted)


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), losses (the trainable texts in order), formatted_chars: all from the formatted text."""
    loss = F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    by_conversation = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("loss_end").isNotNull(), F.struct("example", loss.alias("text"))))).alias("losses"),
        F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"),
    )
    return by_conversation.select(
        "conv_id", turns_of(F.col("longest")).alias("turns"), F.transform("losses", lambda x: unescaped(x.text)).alias("losses"), "formatted_chars"
    )
