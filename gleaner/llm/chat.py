"""Chat formatting with collapse of cumulative snapshots.

A log often holds one conversation many times, each time a few turns longer. Each turn gets the rolling hash
of the turns so far: two running exclusive-ors of 64-bit hashes of (position, role, text), which never overflow. A
conversation whose whole hash is a proper prefix hash of another is dropped by an anti-join; of equal ones the smallest
conv_id stays. What is left, the maximal conversations, is rendered.

Turns go by turn, nulls first, ties by a hash of role and text. Null roles count as "" and render as `unknown_role`, null texts
count as "". Each row without conv_id is a conversation of one turn, of its own: equal ones collapse into one row
(conv_id null), and one that a longer conversation begins with is dropped. Other columns are not kept: a row is a
conversation. Only hashes are shuffled until the survivors are known; one conversation's turns meet in
one row, as its rendered text must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_BEFORE = (W.unboundedPreceding, W.currentRow)


def _step() -> Column:
    return F.sha2(F.concat_ws("\x1f", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256)


def _mixed(k: Column, step: Column) -> tuple[Column, Column]:
    return F.xxhash64(k, step), F.xxhash64(F.lit("again"), step, k)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, last, h1, h2): for each turn its position k from 1, whether it is the last, the rolling hash."""
    t = turns.select("conv_id", "turn", _step().alias("step"))
    # one sort serves both windows; neither holds a conversation in memory
    w = W.partitionBy("conv_id").orderBy("turn", "step")
    named = t.where("conv_id is not null").withColumn("k", F.row_number().over(w)).withColumn("last", F.lead("step").over(w).isNull())
    a, b = _mixed(F.col("k"), F.col("step"))
    run = w.rowsBetween(*_BEFORE)
    named = named.withColumn("a", a).withColumn("b", b).select("conv_id", "k", "last", F.bit_xor("a").over(run).alias("h1"), F.bit_xor("b").over(run).alias("h2"))
    a, b = _mixed(F.lit(1), F.col("step"))
    alone = t.where("conv_id is null").select("conv_id", F.lit(1).alias("k"), F.lit(True).alias("last"), a.alias("h1"), b.alias("h2"))
    return named.unionByName(alone)


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, h1, h2) of the conversations that no longer one begins with; one of equal ones."""
    p = prefix_hashes(turns)
    whole = p.where("last").groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    shorter = p.where("not last").select("k", "h1", "h2").distinct()
    return whole.join(shorter, ["k", "h1", "h2"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies", "h1", "h2")


def render(turns: DataFrame, kept: DataFrame, opening: str = "<|", closing: str = "|>\n", end: str = "\n<|end|>\n", unknown_role: str = "unknown") -> DataFrame:
    """kept (from `maximal`) with `chat`: its turns in order, each as opening + role + closing + text + end."""
    said = F.concat(F.lit(opening), F.coalesce(F.nullif("role", F.lit("")), F.lit(unknown_role)), F.lit(closing), F.coalesce("text", F.lit("")), F.lit(end))
    t = turns.select("conv_id", F.struct("turn", _step().alias("step"), said.alias("said")).alias("t"))
    named = t.where("conv_id is not null").join(kept.where("conv_id is not null").drop("h1", "h2"), "conv_id")
    chat = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["said"]), "").alias("chat")
    named = named.groupBy("conv_id", "n_turns", "n_copies").agg(chat)
    # rows without conv_id find themselves by their hash; one of equal ones is rendered
    h1, h2 = _mixed(F.lit(1), F.col("t.step"))
    alone = t.where("conv_id is null").select(h1.alias("h1"), h2.alias("h2"), "t.said").groupBy("h1", "h2").agg(F.min("said").alias("chat"))
    alone = kept.where("conv_id is null").join(alone, ["h1", "h2"]).select("conv_id", "n_turns", "n_copies", "chat")
    return named.unionByName(alone)


def collapse_and_render(turns: DataFrame, **template) -> DataFrame:
    return render(turns, maximal(turns), **template)
