"""Conversations logged again and again as they grow: only the longest of each is kept, then rendered. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions.session import stored


def lone(turns: DataFrame) -> Column:
    """0, or for a row without a conversation the hash of its content, which keeps such rows from being one group."""
    return F.when(F.col("conv_id").isNull(), F.xxhash64("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long"))


def rolled(turns: DataFrame) -> DataFrame:
    """(conv_id, own, n, size, p, q): for the n-th turn of a conversation of `size` turns, a rolling hash of the turns up to it.

    The hash is the exclusive or of hashes of (place, role, text), twice 64 bits. Only ids and hashes are shuffled.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", lone(turns).alias("own"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h"), F.xxhash64(F.lit(7), text, role).alias("g"))
    by = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "h", "g")
    same = F.lag("h").over(by).eqNullSafe(F.col("h")) & F.lag("g").over(by).eqNullSafe(F.col("g")) & F.lag("turn").over(by).eqNullSafe(F.col("turn"))
    # lag() gives null before the first row; h and g are never null
    rows = rows.withColumn("new", F.coalesce(~same, F.lit(True)))
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n", F.sum(F.col("new").cast("int")).over(so_far))
    rows = rows.withColumns({"p": F.when(F.col("new"), F.xxhash64("n", "h")), "q": F.when(F.col("new"), F.xxhash64("g", "n"))})
    rows = rows.withColumns({"p": F.bit_xor("p").over(so_far), "q": F.bit_xor("q").over(so_far)})
    return rows.where("new").withColumn("size", F.max("n").over(Window.partitionBy("conv_id", "own"))).select("conv_id", "own", "n", "size", "p", "q")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, own, n_turns, n_copies) of the conversations that are no proper prefix of another.

    Of equal conversations the smallest conv_id stays and n_copies counts them. Wholes and prefixes are each reduced to one
    row per hash, with partial sums in every task, before they meet, so a first turn that everyone shares is one row.
    """
    steps = stored(rolled(turns), "prefixes")
    whole = steps.where("n = size").groupBy("n", "p", "q").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "own")).alias("least"), F.count(F.lit(1)).alias("n_copies"))
    prefix = steps.where("n < size").select("n", "p", "q").distinct()
    return whole.join(prefix, ["n", "p", "q"], "left_anti").select("least.conv_id", "least.own", F.col("n").alias("n_turns"), "n_copies")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) per maximal conversation of (conv_id, turn, role, text).

    Turns come by turn number (null first), then role, then a hash of the text; a row repeated within a conversation is one turn.
    Null roles and texts are empty; a row with a null conv_id is a conversation of its own, equal ones
    one. A turn is rendered as
    <|im_start|>role, line feed, text, <|im_end|>, line feed. An empty table gives no rows; other columns are not read.
    Only the texts of conversations that stay are shuffled.
    """
    stay = stored(maximal_conversations(turns), "maximal").select(F.col("conv_id").alias("stays"), F.col("own").alias("stays_own"), "n_turns", "n_copies")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", lone(turns).alias("own"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h"), F.xxhash64(F.lit(7), text, role).alias("g"), text.alias("text"))
    rows = rows.join(stay, F.col("conv_id").eqNullSafe(F.col("stays")) & (F.col("own") == F.col("stays_own")))
    told = F.transform("turns", lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")))
    found = rows.groupBy("conv_id", "own").agg(
        F.first("n_turns").cast("long").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.array_distinct(F.collect_list(F.struct("turn", "role", "h", "g", "text")))).alias("turns")
    )
    return found.select("conv_id", "n_turns", "n_copies", F.array_join(told, "").alias("rendered"))
