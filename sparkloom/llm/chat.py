"""Chat formatting: logged snapshots that a longer conversation continues are dropped, the rest rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import stored

#: The default rendering of one turn: ChatML.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, x, y, last): for each turn the number of turns up to it and two rolling hashes of them.

    The hash of a prefix is the exclusive or of one hash for each (place, role, text) in it, so a window
    rolls it forward without holding the conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turn = F.struct("turn", "role", "text")
    once = turns.withColumn("repeat", F.lag(turn).over(order).eqNullSafe(turn)).where(~F.col("repeat"))
    once = once.withColumn("n", F.row_number().over(order))
    content = [F.col("n"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    rolling = order.rowsBetween(Window.unboundedPreceding, 0)
    hashed = once.select("conv_id", "turn", "role", "text", "n", F.xxhash64(*content).alias("h"), F.xxhash64(F.lit(1), *content).alias("g"))
    return hashed.select(
        "conv_id",
        "n",
        F.bit_xor("h").over(rolling).alias("x"),
        F.bit_xor("g").over(rolling).alias("y"),
        F.lead("n").over(order).isNull().alias("last"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): conversations that are no proper prefix of another, one of each n_equal
    equal ones (that with the smallest id)."""
    hashes = stored(prefix_hashes(turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")), "turn-prefixes")
    whole = hashes.where("last").groupBy("n", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    continued = hashes.where("not last").select("n", "x", "y").distinct()
    return whole.join(continued, ["n", "x", "y"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_equal")


def render(turns: Column) -> Column:
    """A text of the turns, an array of structs with role and text."""
    parts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE)))
    return F.array_join(parts, "")


def chat_texts(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, text): each maximal conversation, rendered.

    turns has conv_id, turn, role and text; other columns are ignored. Turns are in order of (turn,
    role, text), nulls first; a turn logged twice counts once; null roles and texts render as empty but
    differ from empty ones. Turns without a conv_id belong to no conversation and are left out. A
    conversation is one row of the result, so it is gathered, but nothing larger is.
    """
    kept = stored(maximal_conversations(turns), "maximal-conversations")
    own = turns.select("conv_id", F.struct("turn", "role", "text").alias("t")).join(kept, "conv_id")
    whole = own.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("n_equal").alias("n_equal"), F.sort_array(F.collect_set("t")).alias("turns"))
    return whole.select("conv_id", "n_turns", "n_equal", render(F.col("turns")).alias("text"))
