"""Exact top-k by inner product: branch and bound in a ball tree for each shard.

Components become whole numbers, floor(scale * x). Rows are dealt to shards, near rows together as far as a
bounded sample tells (`vectors.Cells`); a shard's rows are ordered as the leaves of a ball tree.

1. Each shard builds its tree and searches it for its own queries. That gives each query a k-th score to begin with, which
   is shared with all other shards.
2. Queries, in chunks, meet the shards, in groups; a task holds a chunk and streams its group's shards. In a shard, nodes
   whose bound (q . centre + |q| radius) is below the query's current k-th score are cut off; the leaves that are
   left are visited by falling bound, 1, 2, 4, ... at a time, and the k-th score rises from shard to shard.
3. A query's best of all groups are merged.

The search is exact: cells and shards only decide what is cut off early. Candidates: every row but the query's own.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
never meet; empty vectors score 0 with each other; components and scores beyond a long's range are its ends; equal scores
go by vec_id, null last, then by row; rows that repeat a vec_id are rows like others, each query row with its own answer;
an empty table gives none. Other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save
from .vectors import Best, best_first, dots, halve, ids, matrix, meet, meetings, norms, sorted_groups, whole, with_cells, with_parts

LEAF = 64
SLICE = 512  # queries whose bounds are held at once


def tree_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The leaf, from 0, of each row: halves of halves, until a part has `leaf` rows or fewer."""
    out, parts, size = np.zeros(len(x), np.int64), [np.arange(len(x))], len(x)
    x = x.astype(np.float64)
    while size > leaf:
        size = -(-size // 2)
        halved = []
        for own in parts:
            at = halve(x[own])[1] if x.shape[1] and len(own) > 1 else np.zeros(len(own))
            own = own[np.argsort(at, kind="stable")]
            halved += [own[: -(-len(own) // 2)], own[-(-len(own) // 2) :]]
        parts = halved
    for k, own in enumerate(parts):
        out[own] = k
    return out


class BallTree:
    """Balls around the leaves of a shard and, level by level, around pairs of balls. Rows come ordered by leaf."""

    def __init__(self, x: np.ndarray, leaf: np.ndarray):
        self.x = x
        starts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        self.starts = np.append(starts, len(x))
        f, size = x.astype(np.float64), np.diff(self.starts)
        center = np.add.reduceat(f, starts, axis=0) / size[:, None]
        radius = np.maximum.reduceat(np.sqrt(((f - np.repeat(center, size, axis=0)) ** 2).sum(1)), starts)
        self.levels = [(center, radius)]
        weight = size.astype(np.float64)
        while len(center) > 1:
            at = np.arange(0, len(center), 2)
            total = np.add.reduceat(weight, at)
            above = np.add.reduceat(center * weight[:, None], at, axis=0) / total[:, None]
            reach = np.sqrt(((center - above[np.arange(len(center)) // 2]) ** 2).sum(1)) + radius
            center, radius, weight = above, np.maximum.reduceat(reach, at), total
            self.levels.append((center, radius))

    def bounds(self, q: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and leaf: an upper bound of its scores, and whether the leaf can still matter."""
        n, open_ = norms(q), np.ones((len(q), 1), bool)
        for center, radius in reversed(self.levels):
            length = np.sqrt((center * center).sum(1)) + radius
            top = q @ center.T + n[:, None] * radius + 1e-9 * n[:, None] * length + 1e-6  # a little above any error of rounding
            open_ = np.repeat(open_, 2, axis=1)[:, : len(center)] if len(center) > 1 else open_
            open_ = open_ & (top >= kth[:, None])
        return top, open_


def search(best: Best, q: np.ndarray, own: np.ndarray, tree: BallTree, row: np.ndarray, vec: np.ndarray, none: np.ndarray) -> None:
    """Visit a shard's leaves for all queries (vectors q, rows own)."""
    for start in range(0, len(q), SLICE):
        some = slice(start, min(start + SLICE, len(q)))
        top, open_ = tree.bounds(q[some].astype(np.float64), best.kth[some])
        order = np.argsort(-np.where(open_, top, -np.inf), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
        done, width = 0, 1
        while done < top.shape[1]:
            turn = open_ & (rank >= done) & (rank < done + width) & (top >= best.kth[some][:, None])
            found = []
            for leaf in np.flatnonzero(turn.any(0)).tolist():
                at, span = np.flatnonzero(turn[:, leaf]) + start, slice(tree.starts[leaf], tree.starts[leaf + 1])
                score = dots(q[at], tree.x[span])
                i, j = np.nonzero((score >= best.kth[at][:, None]) & (own[at][:, None] != row[span][None, :]))
                found.append((at[i], score[i, j], row[span][j], vec[span][j], none[span][j]))
            if found:
                best.offer(*(np.concatenate(x) for x in zip(*found)))
            done, width = done + width, 2 * width


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, shard_rows: int = 2048, chunk: int = 4096, groups: int = 64, sample_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): the k best of each row of vectors (vec_id, embedding) where is_query."""
    rows = whole(vectors, scale, is_query=F.coalesce(is_query, F.lit(False)))
    sharded, shards = with_parts(with_cells(rows, shard_rows, sample_rows), shard_rows, "shard")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "shard"):
            t = t.combine_chunks()
            x = matrix(t.column("v"), t.column("dim")[0].as_py())
            leaf = tree_order(x)
            order = np.argsort(leaf, kind="stable")
            t, x, leaf = t.take(pa.array(order)), x[order], leaf[order]
            own, kth = np.flatnonzero(t.column("is_query").to_numpy()), np.full(len(x), -np.inf)
            if len(own):
                best, about = Best(len(own), k), ids(t)
                search(best, x[own], about[0][own], BallTree(x, leaf), *about)
                kth[own] = best.kth
            cols = [t.column(c).combine_chunks() for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(leaf), pa.array(kth)], [*names, "leaf", "kth"])

    names = ["dim", "shard", "row", "vec_id", "v", "is_query"]
    index = sharded.select(*names).repartition("shard").sortWithinPartitions("shard")
    index = save(index.mapInArrow(build, "dim int, shard long, row long, vec_id long, v array<long>, is_query boolean, leaf long, kth double"), "index")
    discard(rows)
    asked = index.where("is_query").withColumn("cell", F.col("shard"))
    # queries of so many neighbouring shards as fill a chunk are one
    shift = max(0, (shards * chunk // max(asked.count(), 1)).bit_length() - 1)
    asked = with_parts(asked, chunk, "chunk", shift)[0].select("dim", "chunk", "row", "vec_id", "v", "kth")
    met = meet(asked, index.select("dim", "shard", "leaf", "row", "vec_id", "v"), shards, groups)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> Iterator[pa.RecordBatch]:
            if best is not None:
                at, score, row, vec, none = best.held
                cols = [pa.array(own[at]), asking.take(pa.array(at)), pa.array(score), pa.array(vec, mask=none), pa.array(row)]
                yield pa.RecordBatch.from_arrays(cols, ["query_row", "query_id", "score", "vec_id", "row"])

        best = own = asking = q = now = None
        for is_asked, g, dim, t in meetings(batches, shards):
            if is_asked:
                yield from closed()
                now, q, own, asking = g, matrix(t.column("v"), dim), t.column("row").to_numpy(), t.column("vec_id").combine_chunks()
                best = Best(len(q), k, t.column("kth").to_numpy())
            elif g == now:
                search(best, q, own, BallTree(matrix(t.column("v"), dim), t.column("leaf").to_numpy()), *ids(t))
        yield from closed()

    found = met.mapInArrow(visit, "query_row long, query_id long, score long, vec_id long, row long")
    best = found.groupBy("query_row", "query_id").agg(best_first(k).alias("best"))
    out = best.select("query_row", "query_id", F.posexplode("best").alias("_at", "_b"))
    return out.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_b.vec_id").alias("vec_id"), F.col("_b.score").alias("score"), "query_row")
