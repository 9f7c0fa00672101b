"""Chat formatting by cumulative-snapshot collapse.

A logger that stores a conversation after every turn leaves snapshots: each is a prefix of a longer one. Every turn adds
a hash of its place, role and text to a running sum over its conversation, so each prefix of turns has a rolling hash; a
conversation whose whole hash is a strict prefix hash of another goes (anti-join), equal conversations keep the smallest
id, and what is left is rendered.

Only DataFrame functions are used. The sums are two numbers of 60 bits of SHA-256 each, beside the number of turns, and
come from one window over the conversation, in time in proportion to its turns. The same exchange serves the window and
the grouping. Prefix hashes are made distinct before the join (one very common first turn is one row).

Cases: a null role or text counts as the empty string, a null turn sorts first, ties of ``turn`` are ordered by role
and text, repeated rows are repeated turns, a row with a null ``conv_id`` belongs to no other one and is a conversation
of its own (of equal ones a single one stays, as always), an empty table gives an empty result, other columns are
ignored, whatever their names. A rendered conversation is one row, so its size is what one task must hold; the number of
conversations and of copies is not bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _said(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = F.struct(
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    return df.select(F.col(conv).alias("conv_id"), said.alias("said"))


def _digest(place: Column, said: Column) -> Column:
    """SHA-256 of a turn and its place. The length of the role keeps role and text apart."""
    return F.sha2(F.concat_ws("\x1f", place.cast("string"), F.length(said["role"]).cast("string"), said["role"], said["text"]), 256)


def _half(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")


def _name(place: Column, a: Column, b: Column) -> Column:
    return F.concat_ws("-", place.cast("string"), a.cast("string"), b.cast("string"))


def conversation_prefixes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns array<struct<turn, role, text>>, prefixes array<string>: rolling hashes after each turn."""
    rows = _said(df, conv, turn, role, text)
    ordered = Window.partitionBy("conv_id").orderBy("said.turn", "said.role", "said.text")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.filter("conv_id is not null").withColumn("place", F.row_number().over(ordered)).withColumn("digest", _digest(F.col("place"), F.col("said")))
    summed = placed.withColumn("prefix", _name(F.col("place"), F.sum(_half(F.col("digest"), 0)).over(running), F.sum(_half(F.col("digest"), 1)).over(running)))
    steps = F.sort_array(F.collect_list(F.struct("place", "said", "prefix")))
    grouped = summed.groupBy("conv_id").agg(steps.alias("steps")).select("conv_id", F.col("steps.said").alias("turns"), F.col("steps.prefix").alias("prefixes"))
    digest = _digest(F.lit(1), F.col("said"))
    alone = rows.filter("conv_id is null").select("conv_id", F.array("said").alias("turns"), F.array(_name(F.lit(1), _half(digest, 0), _half(digest, 1))).alias("prefixes"))
    return grouped.unionByName(alone)


def maximal_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations that are no prefix of a longer one; of equal ones that with the smallest id (null last), and how many there were."""
    chains = conversation_prefixes(df, conv, turn, role, text).withColumn("whole", F.element_at("prefixes", -1))
    inner = chains.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("whole")).distinct()
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "turns"))
    kept = chains.groupBy("whole").agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies")).join(inner, "whole", "left_anti")
    return kept.select("first.conv_id", "first.turns", "n_copies")


def render(conversations: DataFrame, open_tag: str = OPEN, close_tag: str = CLOSE) -> DataFrame:
    """Adds n_turns and rendered: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn."""
    line = lambda t: F.concat(F.lit(open_tag), t["role"], F.lit("\n"), t["text"], F.lit(close_tag), F.lit("\n"))
    return conversations.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "n_copies",
        F.array_join(F.transform("turns", line), "").alias("rendered"),
    )
