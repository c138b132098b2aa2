"""Folds of conversations (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _order():
    return Window.partitionBy("conv_id").orderBy("turn")


def merge_runs(conv: DataFrame, role: str = "user", sep: str = "\n\n") -> DataFrame:
    """(conv_id, turn, role, text): consecutive messages of ``role`` joined, at the first one's turn."""
    same = (F.col("role") == role) & F.coalesce(F.lag("role").over(_order()) == role, F.lit(False))
    island = conv.withColumn("run", F.sum((~same).cast("int")).over(_order()))
    one = island.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return one.select("conv_id", F.col("m")[0]["turn"].alias("turn"), F.col("m")[0]["role"].alias("role"), F.array_join(F.transform("m", lambda x: x["text"]), sep).alias("text"))


def first_of(conv: DataFrame, role: str) -> DataFrame:
    return conv.filter(F.col("role") == role).groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))


def last_of(conv: DataFrame, role: str, default: str) -> DataFrame:
    """The last message of ``role`` in each conversation, or the default."""
    return conv.groupBy("conv_id").agg(F.coalesce(F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))), F.lit(default)).alias("text"))


def folded(conv: DataFrame, sep: str = "\n") -> DataFrame:
    """Each conversation as one prompt of ``role: text`` parts in order."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return conv.groupBy("conv_id").agg(m.alias("m")).select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), sep).alias("prompt"))


def cumulative(conv: DataFrame) -> DataFrame:
    """Messages and characters so far at each turn."""
    w = _order().rowsBetween(Window.unboundedPreceding, 0)
    return conv.select("conv_id", "turn", F.count("*").over(w).alias("n_messages"), F.sum(F.length("text")).over(w).alias("n_chars"))


def reply_pairs(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, text, reply): user messages and the assistant message right after."""
    nxt = conv.withColumns({"reply": F.lead("text").over(_order()), "who": F.lead("role").over(_order())})
    return nxt.filter((F.col("role") == "user") & (F.col("who") == "assistant")).select("conv_id", "turn", "text", "reply")
