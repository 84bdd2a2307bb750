"""What searches over whole-number vectors share: rounding, exact inner products, cells of near rows, sorted streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import maybe_broadcast, save

EXACT = float(1 << 53)  # whole numbers below are exact as doubles
SAMPLE = 1 << 22  # components of a sample that the driver holds
LONGS = (-(1 << 63), (1 << 63) - 1)


def whole(vectors: DataFrame, scale: float, **more: Column) -> DataFrame:
    """(row, vec_id, v, dim, more): a saved row number, components floor(scale * x) as longs (beyond their range: its ends).

    Vectors that are null or hold null or non-finite components are left out.
    """
    e = F.col("embedding")
    sound = e.isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    v = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    out = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding", *(c.alias(k) for k, c in more.items()))
    return save(out.where(sound).select("row", "vec_id", v.alias("v"), F.size("embedding").alias("dim"), *more), "whole")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The longs of a list column whose lists all have `dim` items."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt((x * x).sum(1))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of longs, exact; beyond a long's range its ends."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if norms(a).max() * norms(b).max() < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, *LONGS).astype(np.int64)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by a column of whole numbers, one at a time."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for i, j in zip(cuts, cuts[1:]):
            if held and k[i] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = k[i]
    if held:
        yield pa.Table.from_batches(held)


def halve(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A direction along which the rows lie far apart, and the rows' places on it."""
    far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    other = x[((x - far) ** 2).sum(1).argmax()]
    return other - far, x @ (other - far)


class Cells:
    """A binary tree of half spaces, fitted on a sample; every row belongs to one of its leaves, near rows mostly to one."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, n = depth, (1 << depth) - 1
        self.turn, self.cut = np.zeros((n, sample.shape[1])), np.zeros(n)
        parts = {0: sample}
        for node in range(n):
            x = parts.pop(node)
            if len(x) < 2:
                low, high = x, x
            else:
                self.turn[node], at = halve(x)
                self.cut[node] = np.median(at)
                low, high = x[at <= self.cut[node]], x[at > self.cut[node]]
            if 2 * node + 1 < n:
                parts[2 * node + 1], parts[2 * node + 2] = low, high

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((x * self.turn[node]).sum(1) > self.cut[node])
        return node - ((1 << self.depth) - 1)


def with_cells(rows: DataFrame, part_rows: int, sample_rows: int = 8192, least: int = 64) -> DataFrame:
    """rows (row, v, dim, ...) with `cell`: trees for each dim, fitted on the `sample_rows` rows of smallest hash (of wide
    vectors on fewer: SAMPLE components at most).

    Deep enough for about `part_rows` rows in a cell, if each leaf still has `least` rows of the sample. Rows of a
    dimension that the sample lacks are one cell. Cells only decide what lies together, never what is compared.
    """
    n, widest = rows.agg(F.count(F.lit(1)), F.max("dim")).first()
    sample_rows = min(sample_rows, SAMPLE // max(widest or 1, 1) + 1)
    sample = rows.select("dim", "v", F.xxhash64("row").alias("h")).orderBy("h").limit(sample_rows).select("dim", "v").toArrow()
    trees: dict[int, Cells] = {}
    dims = sample.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        x = matrix(sample.filter(pa.array(dims == dim)).column("v"), dim).astype(np.float64)
        depth = min(max(0, -(-n // part_rows) - 1).bit_length(), max(0, (len(x) // least).bit_length() - 1))
        if dim:
            trees[dim] = Cells(x, depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, cell = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dim).tolist():
                if d in trees:
                    own = np.flatnonzero(dim == d)
                    cell[own] = trees[d].of(matrix(b.column("v").take(pa.array(own)), d).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    return rows.mapInArrow(place, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell long")


def with_parts(rows: DataFrame, part_rows: int, name: str, shift: int = 0) -> tuple[DataFrame, int]:
    """rows with `name`, a number from 0 for parts of about `part_rows` rows, and the number of parts.

    Rows of a cell (of 2^shift neighbouring cells) share a part; larger cells are dealt to several by a hash of the row.
    """
    cell = F.shiftright("cell", shift).alias("cell")
    counts = rows.groupBy("dim", cell).agg(F.count(F.lit(1)).alias("n")).withColumn("_parts", F.ceil(F.col("n") / part_rows))
    # a row for each leaf of the trees, which a bounded sample bounds
    first = F.sum("_parts").over(W.orderBy("dim", "cell").rowsBetween(W.unboundedPreceding, -1))
    counts = save(counts.select("dim", "cell", "_parts", F.coalesce(first, F.lit(0)).alias("_first")), "parts")
    total = counts.agg(F.sum("_parts")).first()[0] or 0
    placed = rows.withColumn("_cell", cell).join(maybe_broadcast(counts.withColumnRenamed("cell", "_cell"), 100_000), ["dim", "_cell"])
    return placed.withColumn(name, F.col("_first") + F.pmod(F.xxhash64("row"), F.col("_parts"))).drop("_cell", "_first", "_parts"), total


def meet(asked: DataFrame, rows: DataFrame, shards: int, groups: int) -> DataFrame:
    """Each chunk of asked rows (dim, chunk, ...) with each group of shards of all rows (dim, shard, ...), one sorted stream each.

    Columns: g (chunk and group), kind (0: asked, first; 1: rows, by shard and leaf), shard, and what either side has.
    """
    groups = max(1, min(groups, shards))
    ranges = save(asked.groupBy("dim").agg(F.min("chunk").alias("_from"), F.max("chunk").alias("_to")), "ranges")
    group = F.floor(F.col("shard") * groups / max(1, shards)).cast("long")
    rows = rows.withColumns({"kind": F.lit(1), "_group": group}).join(maybe_broadcast(ranges, 100_000), "dim")
    rows = rows.withColumn("chunk", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    asked = asked.withColumns({"kind": F.lit(0), "shard": F.lit(-1).cast("long"), "_group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))})
    both = asked.unionByName(rows, allowMissingColumns=True).withColumn("g", F.col("chunk").cast("long") * groups + F.col("_group")).drop("chunk", "_group")
    leaf = ["leaf"] if "leaf" in both.columns else []
    return both.repartition("g").sortWithinPartitions("g", "kind", "shard", *leaf)


def meetings(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[tuple[bool, int, int, pa.Table]]:
    """(asked?, g, dim, table) for what `meet` sorted: the asked rows of a meeting, then its shards one by one."""

    def keyed() -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, s = b.column("g").to_numpy(), b.column("shard").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g * (shards + 1) + s + 1)], [*b.schema.names, "key"])

    for t in sorted_groups(keyed(), "key"):
        t = t.combine_chunks()
        yield t.column("kind")[0].as_py() == 0, t.column("g")[0].as_py(), t.column("dim")[0].as_py(), t


def ids(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: its number, its vec_id (0 for none), whether it has none."""
    vec = t.column("vec_id").combine_chunks()
    return t.column("row").to_numpy(), vec.fill_null(0).to_numpy(), vec.is_null().to_numpy(zero_copy_only=False)


class Best:
    """The best k that each of n askers was offered: by score, then vec_id (none last), then row. kth: the score to reach."""

    def __init__(self, n: int, k: int, kth: np.ndarray | None = None):
        self.k, self.kth = k, np.full(n, -np.inf) if kth is None else kth.astype(np.float64)
        self.held = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]  # asker, score, row, vec_id, none

    def offer(self, *new: np.ndarray) -> None:
        at, score, row, vec, none = every = [np.concatenate(x) for x in zip(self.held, new)]
        order = np.lexsort((row, vec, none, ~score, at))
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        self.held = [x[order[place < self.k]] for x in every]
        full = place[place < self.k] == self.k - 1
        at, score = self.held[0][full], self.held[1][full].astype(np.float64)
        # beyond what doubles tell apart, a little below
        score = np.where(np.abs(score) < EXACT, score, np.nextafter(score, -np.inf))
        self.kth[at] = np.maximum(self.kth[at], score)


def best_first(k: int, *more: str) -> Column:
    """The best k of rows (score, vec_id, row) of a group, in order, as an aggregate."""
    order = F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), F.col("vec_id").isNull().alias("none"), "vec_id", "row", "score", *more)
    return F.slice(F.array_sort(F.collect_list(order)), 1, k)
