"""Prefix-target expansion of conversations: one training example per assistant turn, with all turns before it as context.

Only the target's text is trainable; its place is given in code points of the example. The template writes a turn as
``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts the backslash and ``<|`` are escaped, so a text that
holds control strings can't open or close a turn, and reading back gives the text unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escaped_role(role: Column) -> Column:
    """A role keeps to one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), escaped_role(role), F.lit("\n"))


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id, target, n_turns, formatted, loss_start, loss_length``.

    One row per assistant turn; target is the turn's 0-based place, n_turns the turns in the example, loss_start and
    loss_length the trainable code points. A conversation that does not end with an assistant turn gives one more row
    with a null target and nothing trainable, so that no turn is lost. Turns are ordered by ``turn`` (nulls first), then
    role and text; null roles and texts count as empty; rows with a null ``conv_id`` are one conversation. An empty table
    gives no row, extra columns are left out.

    A conversation is put together in one task, as its longest example has to be.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    written = F.transform("_turns", lambda t: F.concat(_head(t["role"]), escaped(t["text"]), F.lit(END + "\n")))
    places = F.sequence(F.lit(0), F.size("_turns") - 1)
    is_target = F.element_at("_turns", F.col("_at") + 1)["role"] == TARGET
    rows = whole.withColumn("_written", written).withColumn("_at", F.explode(places))
    rows = rows.where(is_target | (F.col("_at") == F.size("_turns") - 1))
    last = F.element_at("_turns", F.col("_at") + 1)
    before = F.array_join(F.slice("_written", F.lit(1), F.col("_at")), "")
    rows = rows.withColumns({"_before": before, "_target": is_target, "_head": _head(last["role"]), "_text": escaped(last["text"])})
    return rows.select(
        "conv_id",
        F.when(F.col("_target"), F.col("_at")).alias("target"),
        (F.col("_at") + 1).alias("n_turns"),
        F.concat("_before", "_head", "_text", F.lit(END + "\n")).alias("formatted"),
        F.when(F.col("_target"), F.length("_before") + F.length("_head")).otherwise(F.lit(0)).alias("loss_start"),
        F.when(F.col("_target"), F.length("_text")).otherwise(F.lit(0)).alias("loss_length"),
    )


def turns_of(formatted: Column) -> Column:
    """Array of (role, text), read back from an example."""
    split = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(split, F.lit(2), F.size(split))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(F.substring_index(F.substr(p, F.instr(p, F.lit("\n")) + 1), END, 1)).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from the examples alone.

    turns_sha256: hex digest of role, newline, text, newline of every turn. loss_sha256: of all trainable text, unescaped,
    in order, nothing between. formatted_chars: code points of all of the conversation's examples.
    """
    loss = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    rows = examples.withColumn("_loss", loss)
    whole = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("_all"),
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "_loss")))).alias("_parts"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    whole = whole.withColumns({"_turns": turns_of(F.col("_all")), "_trained": F.array_join(F.transform("_parts", lambda p: p["_loss"]), "")})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("_trained").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
