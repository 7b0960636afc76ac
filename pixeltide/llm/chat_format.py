"""Cumulative-snapshot collapse of logged conversations, then chat rendering.

Chat logs often hold a conversation once per turn, each time a little longer.
Every turn gets a rolling hash of the prefix that ends with it; a conversation
whose whole hash is the hash of a proper prefix elsewhere is a snapshot of a
longer one and goes; of equal conversations the one of the least id stays.

The rolling hash of a prefix is a pair of running XORs of position-salted 64-bit
turn hashes (128 bits together), a window aggregate with constant state that
streams over a sorted partition, so no conversation is gathered to be hashed.
Hashes are made distinct before they are joined: a first turn that a third of all
conversations share is one row on the right side of the anti-join.

Defined results: a null text is an empty text and a null role is ``unknown``;
turns are ordered by (turn, role, text), null turns first, and repeated turn
rows count as turns of their own; rows with a null conversation id form one
conversation; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is rendered; both marks are parameters of ``render``.
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = turns.withColumn("k", F.row_number().over(order))
    running = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    salted = placed.withColumns(
        {"a": F.xxhash64("k", "role", "text"), "b": F.xxhash64("text", F.lit("second"), "role", "k")}
    )
    return salted.select(
        "conv_id", "k", "role", "text", F.bit_xor("a").over(running).alias("a"), F.bit_xor("b").over(running).alias("b")
    )


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """One row per turn: (conv_id, k, a, b), the hash pair of the first k turns."""
    return _turns(conversations).select("conv_id", "k", "a", "b")


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that are no proper prefix of another.

    ``n_copies`` counts the equal conversations that the kept one stands for.
    """
    hashes = prefix_hashes(conversations)
    last = hashes.groupBy("conv_id").agg(F.max_by(F.struct("k", "a", "b"), "k").alias("e"))
    whole = (
        last.groupBy(F.col("e.k").alias("k"), F.col("e.a").alias("a"), F.col("e.b").alias("b"))
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    ends = last.select("conv_id", F.col("e.k").alias("n"))
    proper = (
        hashes.join(ends.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
        .filter(F.col("k") < F.col("n"))
        .select("k", "a", "b")
        .distinct()
    )
    kept = whole.join(proper, ["k", "a", "b"], "left_anti")
    return kept.select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, opening: str = OPEN, closing: str = CLOSE) -> DataFrame:
    """Maximal conversations as one text each: (conv_id, n_turns, n_copies, rendered)."""
    head = F.replace(F.lit(opening), F.lit("{role}"), F.col("role"))
    pieces = _turns(conversations).select("conv_id", "k", F.concat(head, "text", F.lit(closing)).alias("piece"))
    kept = maximal(conversations).withColumnRenamed("conv_id", "c")
    joined = pieces.join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
    texts = joined.groupBy("conv_id", "n_turns", "n_copies").agg(
        F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p")
    )
    return texts.select(
        "conv_id", "n_turns", "n_copies", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("rendered")
    )
