"""Hard negatives of anchors, mined with bounds along a spanning tree of the anchors.

Components become whole numbers, floor(scale * x); a row's score is its inner product with the anchor. An anchor's
positives are its best rows of the same label. A positive's hard negatives are the best rows of other labels whose
score lies in its window: low % to high % of the positive's score.

Anchors go in chunks of near ones, rows in shards (`vectors.with_cells`); a task holds a chunk and streams a group of
shards, twice: for the positives, then, when windows are known, for the negatives. In a task the chunk's minimum
spanning tree is walked from its root. The root scores every row of a shard; a child's score of a row lies within
|child - parent| |row| of its parent's. Only rows whose interval overlaps what the child can still use (same label
and its k-th score so far; other labels and its windows) are scored anew; these are exact for its own children, the
others go on with their intervals. The bounds decide what is scored, never what is returned.

Defined cases: rows with a null label, a null vector, or null or non-finite components take no part; vectors of different
lengths never meet; a positive of negative score has an empty window; an anchor without others of its label has no
result; equal scores go by vec_id, null last, then by row; rows that repeat a vec_id are rows like others, each anchor
row with its own result; components and scores beyond a long's range are its ends. Other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save
from .vectors import EXACT, LONGS, Best, best_first, ids, matrix, meet, meetings, norms, whole, with_cells, with_parts


def spanning_tree(a: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of rows of doubles, by Prim's rule: an order with parents first, each row's parent (-1 at the root), the edge's length."""
    n = len(a)
    parent, edge = np.full(n, -1), np.full(n, np.inf)
    left, order = np.ones(n, bool), [0]
    left[0], edge[0] = False, 0.0
    while len(order) < n:
        away = np.sqrt(((a - a[order[-1]]) ** 2).sum(1))
        nearer = left & (away < edge)
        edge[nearer], parent[nearer] = away[nearer], order[-1]
        open_ = np.flatnonzero(left)
        order.append(int(open_[edge[open_].argmin()]))
        left[order[-1]] = False
    return order, parent, edge


class Chunk:
    """Anchors of a task with their spanning tree."""

    def __init__(self, a: np.ndarray):
        self.a, self.longest = a, norms(a).max()
        self.order, self.parent, self.edge = spanning_tree(a.astype(np.float64))

    def walk(self, x: np.ndarray, usable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, places, scores) for rows x: those that `usable(anchor)` = (mask, least, most) can't rule out by bounds."""
        n = norms(x)
        exact = self.longest * n.max() < EXACT
        kind = np.float64 if exact else object
        x, a = x.astype(kind), self.a.astype(kind)
        low, high = np.empty((len(a), len(x))), np.empty((len(a), len(x)))
        ends = [float(v) for v in LONGS]  # scores stop there

        def inside(i: int) -> np.ndarray:
            return (np.clip(high[i], *ends) >= least) & (np.clip(low[i], *ends) <= most)

        for i in self.order:
            mask, least, most = usable(i)
            up = self.parent[i]
            if up >= 0:
                reach = self.edge[i] * n * (1 + 1e-9) + 1e-9 * self.longest * n + 1e-6
                low[i], high[i] = low[up] - reach, high[up] + reach
                at = np.flatnonzero(mask & inside(i))
            if up < 0 or 2 * len(at) > len(x):  # as well all
                score = x @ a[i]
                low[i] = high[i] = score
                at = np.flatnonzero(mask & inside(i))
                score = score[at]
            else:
                score = x[at] @ a[i]
                low[i][at] = high[i][at] = score
            if len(at):
                yield i, at, score.astype(np.int64) if exact else np.clip(score, *LONGS).astype(np.int64)


def _first(k: int, score: np.ndarray, row: np.ndarray, vec: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Places of the best k, of more than that many."""
    at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((row[at], vec[at], none[at], ~score[at]))[:k]]


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, shard_rows: int = 2048, chunk: int = 512, groups: int = 64, sample_rows: int = 8192
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_row) from vectors (vec_id, embedding, label).

    label: a whole number.
    """
    labelled = vectors.where(F.col("label").isNotNull())
    rows = whole(labelled, scale, label=F.col("label").cast("long"), is_anchor=F.coalesce(is_anchor, F.lit(False)))
    celled = with_cells(rows, shard_rows, sample_rows)
    sharded, shards = with_parts(celled, shard_rows, "shard")
    sharded = save(sharded.select("dim", "cell", "shard", "row", "vec_id", "label", "v", "is_anchor"), "sharded")
    discard(rows)
    anchors = sharded.where("is_anchor")
    shift = max(0, (max(shards, 1) * chunk // max(anchors.count(), 1)).bit_length() - 1)
    anchors = save(with_parts(anchors, chunk, "chunk", shift)[0].select("dim", "chunk", "row", "vec_id", "label", "v"), "anchors")
    rows = sharded.select("dim", "shard", "row", "vec_id", "label", "v")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best rows of each anchor's label."""

        def closed() -> Iterator[pa.RecordBatch]:
            if best is not None:
                at, score, row, vec, none = best.held
                cols = [pa.array(own[at]), pa.array(score), pa.array(vec, mask=none), pa.array(row)]
                yield pa.RecordBatch.from_arrays(cols, ["anchor_row", "score", "vec_id", "row"])

        best = own = now = None
        for is_asked, g, dim, t in meetings(batches, shards):
            if is_asked:
                yield from closed()
                now, tree, own, label = g, Chunk(matrix(t.column("v"), dim)), t.column("row").to_numpy(), t.column("label").to_numpy()
                best = Best(len(own), positives)
            elif g == now:
                row, vec, none = ids(t)
                mine, found = t.column("label").to_numpy(), []
                for i, at, score in tree.walk(matrix(t.column("v"), dim), lambda i: ((mine == label[i]) & (row != own[i]), best.kth[i], np.inf)):
                    ok = score >= best.kth[i]
                    at, score = at[ok], score[ok]
                    if len(at) > 4 * positives:
                        top = _first(positives, score, row[at], vec[at], none[at])
                        at, score = at[top], score[top]
                    found.append((np.full(len(at), i), score, row[at], vec[at], none[at]))
                if found:
                    best.offer(*(np.concatenate(x) for x in zip(*found)))
        yield from closed()

    found = meet(anchors, rows, shards, groups).mapInArrow(near, "anchor_row long, score long, vec_id long, row long")
    known = found.groupBy("anchor_row").agg(best_first(positives).alias("p"))
    known = known.select(F.col("anchor_row").alias("row"), F.transform("p", lambda p: p["score"]).alias("p_score"), F.transform("p", lambda p: p["vec_id"]).alias("p_id"))
    anchors = save(anchors.join(known, "row"), "positives")

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each anchor and positive the best rows of other labels in the window."""

        def closed() -> Iterator[pa.RecordBatch]:
            if best is not None:
                at, score, row, vec, none = best.held
                cols = [pa.array(own[at // positives]), pa.array((at % positives).astype(np.int32)), pa.array(score), pa.array(vec, mask=none), pa.array(row)]
                yield pa.RecordBatch.from_arrays(cols, ["anchor_row", "place", "score", "vec_id", "row"])

        best = own = now = None
        for is_asked, g, dim, t in meetings(batches, shards):
            if is_asked:
                yield from closed()
                now, tree, own, label = g, Chunk(matrix(t.column("v"), dim)), t.column("row").to_numpy(), t.column("label").to_numpy()
                windows = [[(-(-low * p // 100), high * p // 100) for p in ps] for ps in t.column("p_score").to_pylist()]
                least = np.array([min((a for a, b in w if a <= b), default=np.inf) for w in windows], float)
                most = np.array([max((b for a, b in w if a <= b), default=-np.inf) for w in windows], float)
                # as doubles, a little wider: the windows themselves are whole numbers
                least, most = np.nextafter(least, -np.inf), np.nextafter(most, np.inf)
                best = Best(positives * len(own), negatives)
            elif g == now:
                row, vec, none = ids(t)
                mine, found = t.column("label").to_numpy(), []
                lack = best.kth.reshape(-1, positives)
                for i, at, score in tree.walk(matrix(t.column("v"), dim), lambda i: (mine != label[i], max(least[i], lack[i, : len(windows[i])].min()), most[i])):
                    for place, (a, b) in enumerate(windows[i]):
                        ok = np.flatnonzero((score >= max(a, lack[i, place])) & (score <= b))
                        if len(ok) > 4 * negatives:
                            ok = ok[_first(negatives, score[ok], row[at[ok]], vec[at[ok]], none[at[ok]])]
                        if len(ok):
                            found.append((np.full(len(ok), i * positives + place), score[ok], row[at[ok]], vec[at[ok]], none[at[ok]]))
                if found:
                    best.offer(*(np.concatenate(x) for x in zip(*found)))
        yield from closed()

    found = meet(anchors, rows, shards, groups).mapInArrow(hard, "anchor_row long, place int, score long, vec_id long, row long")
    best = found.groupBy("anchor_row", "place").agg(best_first(negatives).alias("n"))
    about = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("p_id", "p_score")).alias("place", "p"))
    out = best.join(about, ["anchor_row", "place"]).select("anchor_row", "anchor_id", "p", F.posexplode("n").alias("_at", "_n"))
    return out.select("anchor_id", F.col("p.p_id").alias("positive_id"), (F.col("_at") + 1).alias("rank"), F.col("_n.vec_id").alias("negative_id"), F.col("p.p_score").alias("positive_score"), F.col("_n.score").alias("negative_score"), "anchor_row")
