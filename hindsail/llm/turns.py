"""Places of turns in their conversations, counted without a window over a whole conversation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Turn numbers of one piece, as a power of two.
PIECE_BITS = 10


def spoken(role: Column, text: Column) -> Column:
    """MD5 of what a turn says, its role's length before it so that no two turns read alike."""
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit("\n"), role, text).cast("binary"))


def numbered(rows: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """rows(conv_id, turn long, ...) with a place from 1 in the conversation: by turn (null first), then by the columns of order.

    Places are counted inside pieces of 1,024 turn numbers; what earlier pieces
    hold, one row a piece, is joined in and added. So a conversation that holds
    a third of all rows is many tasks. A null conv_id is a conversation.
    """
    cut = rows.withColumn("_piece", F.shiftright("turn", PIECE_BITS))
    inner = Window.partitionBy("conv_id", "_piece").orderBy(F.asc_nulls_first("turn"), *order)
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    held = cut.groupBy("conv_id", "_piece").agg(F.count("*").alias("_n"))
    # a first piece needs no offset, and most conversations have one piece
    offsets = held.withColumn("_o", F.sum("_n").over(before)).where("_o > 0").select(F.col("conv_id").alias("_c"), F.col("_piece").alias("_p"), "_o")
    local = cut.withColumn("_r", F.row_number().over(inner))
    same = local["conv_id"].eqNullSafe(offsets["_c"]) & local["_piece"].eqNullSafe(offsets["_p"])
    return local.join(offsets, same, "left").select(*rows.columns, (F.col("_r") + F.coalesce("_o", F.lit(0))).cast("long").alias(name))
