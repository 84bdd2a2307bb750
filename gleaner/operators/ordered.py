"""Ordered computations over groups of any size.

A window over one group is one task's work, however large the group. Here a group is cut into blocks of its whole-number
order; windows run inside blocks, and what crosses a block's edge goes through a table with a row for each block. That table
is cut into blocks of blocks in turn, so sparse orders (a row a block) spread over tasks too: with blocks of 2 ** 20 values no
window holds more than 2 ** 20 rows below the top, and the top has a row for each 2 ** 40 values of a group's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..jobs.state import lean_shuffles, scratch_dir

BLOCK = 1 << 20  # a power of 2
_PAST = (W.unboundedPreceding, -1)


def _block_of(order: Column) -> Column:
    return F.shiftright(order.cast("bigint"), BLOCK.bit_length() - 1)


def _blocked(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_block", _block_of(F.col(order)))


def _edges(d: DataFrame, by: list[str], order: str, value: Column, add: bool) -> DataFrame:
    """by, _block, _edge: of all earlier blocks of the group, the sum of value (add) or its last value that isn't null."""

    def whole(v: Column, at: str) -> Column:
        return F.sum(v) if add else F.max_by(v, F.when(v.isNotNull(), F.col(at)))

    def past(v: str, *within: str) -> Column:
        return (F.sum(v) if add else F.last(v, ignorenulls=True)).over(W.partitionBy(*by, *within[:-1]).orderBy(within[-1]).rowsBetween(*_PAST))

    blocks = d.groupBy(*by, "_block").agg(whole(value, order).alias("_v")).withColumn("_over", _block_of(F.col("_block")))
    over = blocks.groupBy(*by, "_over").agg(whole(F.col("_v"), "_block").alias("_w")).select(*by, "_over", past("_w", "_over").alias("_far"))
    edge = F.coalesce("_far", F.lit(0)) + F.coalesce("_near", F.lit(0)) if add else F.coalesce("_near", "_far")
    return blocks.withColumn("_near", past("_v", "_over", "_block")).join(over, [*by, "_over"]).select(*by, "_block", edge.alias("_edge"))


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over its group's rows up to this one, nulls as 0; order is unique in a group."""
    d = _blocked(df, order)
    here = F.sum(value).over(W.partitionBy(*by, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_here", here).join(_edges(d, by, order, F.col(value), True), [*by, "_block"])
    return d.withColumn(name, (F.col("_edge") + F.coalesce("_here", F.lit(0))).cast("bigint")).drop("_edge", "_here", "_block")


def previous(df: DataFrame, by: list[str], order: str, cols: list[str], prefix: str = "prev_") -> DataFrame:
    """df with the columns' values in the row before, null in a group's first row."""
    d, s = _blocked(df, order), F.struct(*cols)
    d = d.withColumn("_lag", F.lag(s).over(W.partitionBy(*by, "_block").orderBy(order))).join(_edges(d, by, order, s, False), [*by, "_block"])
    return d.select(*df.columns, *(F.coalesce(F.col("_lag"), F.col("_edge"))[c].alias(prefix + c) for c in cols))


def carry_forward(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with the last non-null value up to this row."""
    d = _blocked(df, order)
    here = F.last(value, ignorenulls=True).over(W.partitionBy(*by, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_here", here).join(_edges(d, by, order, F.col(value), False), [*by, "_block"])
    return d.withColumn(name, F.coalesce("_here", "_edge")).drop("_here", "_edge", "_block")


def run_numbers(df: DataFrame, by: list[str], order: str, cols: list[str], name: str) -> DataFrame:
    """df with the number, from 1, of the row's run: rows of a group that follow each other with equal cols, nulls included.

    Changes are counted inside blocks; whether a block's first row is a change is told from the blocks' first and last rows.
    """

    def changed(now: Column, before: str) -> Column:
        return F.when(F.col(before).isNull() | now.eqNullSafe(F.col(before)), 0).otherwise(1)

    def through(w):
        return w.rowsBetween(W.unboundedPreceding, 0)

    s, w = F.struct(*cols), W.partitionBy(*by, "_block").orderBy(order)
    d = _blocked(df, order).withColumn("_lag", F.lag(s).over(w))
    d = d.withColumn("_here", F.sum(changed(s, "_lag")).over(through(w))).drop("_lag")
    blocks = d.groupBy(*by, "_block").agg(F.min_by(s, order).alias("_first"), F.max_by(s, order).alias("_last"), F.max("_here").alias("_n"))
    path = scratch_dir(df.sparkSession)  # stored, as they are read twice
    with lean_shuffles(df.sparkSession):
        blocks.write.parquet(path)
    blocks = df.sparkSession.read.schema(blocks.schema).parquet(path)
    w = W.partitionBy(*by, "_over").orderBy("_block")
    blocks = blocks.withColumn("_over", _block_of(F.col("_block"))).withColumn("_lag", F.lag("_last").over(w))
    blocks = blocks.withColumn("_turn", changed(F.col("_first"), "_lag")).withColumn("_near", F.sum(F.col("_turn") + F.col("_n")).over(through(w)) - F.col("_n"))
    over = blocks.groupBy(*by, "_over").agg(F.min_by("_first", "_block").alias("_f"), F.max_by("_last", "_block").alias("_l"), F.sum(F.col("_turn") + F.col("_n")).alias("_m"))
    w = W.partitionBy(*by).orderBy("_over")
    over = over.withColumn("_lag", F.lag("_l").over(w)).withColumn("_turn", F.when(F.col("_lag").isNull(), 1).otherwise(changed(F.col("_f"), "_lag")))
    over = over.select(*by, "_over", (F.sum(F.col("_turn") + F.col("_m")).over(through(w)) - F.col("_m")).alias("_far"))
    edges = blocks.select(*by, "_over", "_block", "_near").join(over, [*by, "_over"]).select(*by, "_block", (F.col("_near") + F.col("_far")).alias("_edge"))
    return d.join(edges, [*by, "_block"]).select(*df.columns, (F.col("_edge") + F.col("_here")).cast("bigint").alias(name))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the row's place, from 1, in the order of the given columns, of any type; equal rows in any order.

    Rows are sorted into ranges and stored, so that a row's range and its place there can't change; a table with a row for
    each range then says how many rows come before. No task sees more than a range.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    # the number is the partition's, in the upper bits, and the place in the sorted partition
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    d = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    ranges = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = ranges.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(*_PAST)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return d.join(F.broadcast(before), "_range").select(*df.columns, place.alias(name))  # as many ranges as partitions


def in_work_order(answers: DataFrame, work: DataFrame, key: str, order: list[str], name: str = "place") -> DataFrame:
    """Answers of the work that is asked for, stale ones left out, with their place in its order. work: key, order columns."""
    return ranked(work.select(key, *order).join(answers, key), order, name)
