import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import hard_negatives, topk, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def rows(n=400, dim=12, seed=3):
    """Vectors around a few centres, with ties, copies, odd rows and two lengths."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(6, dim))
    x = np.float32(base[r.integers(0, 6, n)] + 0.2 * r.normal(size=(n, dim)))
    x[n // 3 : n // 3 + n // 5] = x[0]  # a group of copies
    out = [(i, x[i].tolist(), int(r.integers(0, 3))) for i in range(n)]
    out += [(0, out[7][1], 1), (0, out[0][1], 0), (None, out[3][1], 2), (None, None, 1), (n, None, 1), (n + 10, [float("nan")] + [1.0] * (dim - 1), 0), (n + 20, [None] * dim, 0), (n + 30, [float("inf")] * dim, 1)]
    out += [(1000 + 10 * i, [0.5, float(i)], i % 2) for i in range(20)] + [(2000, [], 1), (2010, [], 0), (3000, [1.0, 2.0, 3.0], 1), (4000, [0.0] * dim, None)]
    return out


def whole(data):
    ok = lambda e: e is not None and all(c is not None and np.isfinite(c) for c in e)
    return [(i, [int(np.floor(256.0 * float(np.float32(c)))) for c in e], l) for i, e, l in data if ok(e)]


def ranked(scored):
    """(score, vec_id, row) best first."""
    return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0, s[2]))


def score(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("shard_rows, chunk, groups", [(2048, 4096, 64), (40, 8, 3)])
def test_top_k(spark, shard_rows, chunk, groups):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumns({"row": F.lit("mine"), "v": F.lit(1), "score": F.lit("x"), "cell": F.lit(2)})
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 5, shard_rows=shard_rows, chunk=chunk, groups=groups).collect()
    own = {}
    for r in got:
        own.setdefault(r.query_row, [r.query_id]).append((r.rank, r.score, r.vec_id))
    have = sorted((x[0], sorted(x[1:])) for x in own.values())
    v, want = whole(data), []
    for k, (i, e, _) in enumerate(v):
        if i is not None and i % 10 == 0:
            best = ranked((score(e, b), j, m) for m, (j, b, _) in enumerate(v) if m != k and len(b) == len(e))[:5]
            if best:
                want.append((i, [(p, s, j) for p, (s, j, _) in enumerate(best, 1)]))
    assert have == sorted(want) and len(want) > 50
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_top_k_of_huge_components(spark):
    data = [(0, [1e30, 1.0], 0), (1, [3e8, -2e8], 0), (2, [-1e30, 5.0], 0), (3, [1e16, 1e15], 0), (4, [-1e16, 3.0], 0)]
    top, low = (1 << 63) - 1, -(1 << 63)
    v = [[min(top, max(low, int(np.floor(256.0 * float(np.float32(c)))))) for c in e] for _, e, _ in data]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(data, SCHEMA), F.lit(True), 4).collect()}
    for i in range(5):
        best = sorted(((-min(top, max(low, score(v[i], v[j]))), j) for j in range(5) if j != i))
        assert [got[i, p] for p in range(1, 5)] == [(j, -s) for s, j in best]


def test_hard_negatives_of_huge_components(spark):
    """Scores that doubles can't tell apart, and some beyond a long's range, which are its end."""
    r, top = np.random.default_rng(6), (1 << 63) - 1
    for scale in (2e6, 6e6):
        data = [(i, [float(np.float32(x)) for x in scale * (2 + r.uniform(size=3) * 1e-5)], i % 2) for i in range(40)]
        got = hard_negatives.hard_negatives(spark.createDataFrame(data, SCHEMA), F.col("vec_id") < 6, low=99, shard_rows=8, groups=3).collect()
        v, want = whole(data), []
        for i, e, l in v[:6]:
            near = [(min(top, score(e, b)), j, m) for j, b, m in v if j != i]
            for p, pid, _ in ranked(x for x in near if x[2] == l)[:5]:
                inside = ranked(x for x in near if x[2] != l and 99 * p <= 100 * x[0] <= 100 * p)[:5]
                want += [(i, pid, k, j, p, s) for k, (s, j, _) in enumerate(inside, 1)]
        assert max(x[5] for x in want) > 1 << 60 and len(want) > 60
        assert sorted((x.anchor_id, x.positive_id, x.rank, x.negative_id, x.positive_score, x.negative_score) for x in got) == sorted(want)


def test_bounds_hold_and_cut():
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 16)) * 400
    x = (base[r.integers(0, 40, 3000)] + 10 * r.normal(size=(3000, 16))).astype(np.int64)
    leaf = topk.tree_order(x)
    order = np.argsort(leaf, kind="stable")
    x, leaf = x[order], leaf[order]
    assert np.bincount(leaf).max() <= topk.LEAF
    tree, q = topk.BallTree(x, leaf), x[::100].astype(float)
    score = q @ x.T
    kth = -np.sort(-score, axis=1)[:, 4]
    top, open_ = tree.bounds(q, kth)
    for k, (a, b) in enumerate(zip(tree.starts, tree.starts[1:])):
        assert (top[:, k] >= score[:, a:b].max(1)).all() and (open_[:, k] | (score[:, a:b].max(1) < kth)).all()
    assert open_.mean() < 0.5


def plain_negatives(data, every, low, high, k=5):
    v, out = [x for x in whole(data) if x[2] is not None], []
    for at, (i, e, l) in enumerate(v):
        if i is None or i % every:
            continue
        scored = [(score(e, b), j, m, lab) for m, (j, b, lab) in enumerate(v) if m != at and len(b) == len(e)]
        for p, pid, *_ in ranked(s for s in scored if s[3] == l)[:k]:
            inside = ranked(s for s in scored if s[3] != l and low * p <= 100 * s[0] <= high * p)[:k]
            out += [(i, pid, n, s[1], p, s[0]) for n, s in enumerate(inside, 1)]
    return out


@pytest.mark.parametrize("shard_rows, chunk, groups, low, high", [(2048, 512, 64, 80, 100), (40, 6, 3, 80, 100), (64, 16, 5, 50, 120)])
def test_hard_negatives(spark, shard_rows, chunk, groups, low, high):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumns({"row": F.lit("mine"), "p_score": F.lit(1), "chunk": F.lit("x"), "n": F.lit(2)})
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, low=low, high=high, shard_rows=shard_rows, chunk=chunk, groups=groups).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(plain_negatives(data, 10, low, high), key=key)
    have = sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got), key=key)
    assert have == want and len(want) > 100
    assert hard_negatives.hard_negatives(df.where("false"), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_tree_bounds_spare_scores():
    """Near anchors: most rows are ruled out by the parent's scores."""
    r = np.random.default_rng(2)
    a = (r.normal(size=16) * 300 + r.normal(size=(30, 16))).astype(np.int64)
    x = (r.normal(size=(500, 16)) * 300).astype(np.int64)
    chunk = hard_negatives.Chunk(a)
    assert sorted(chunk.order) == list(range(30)) and (chunk.parent == -1).sum() == 1
    seen, exact = 0, a @ x.T
    for i, at, s in chunk.walk(x, lambda i: (np.ones(500, bool), np.sort(exact[i])[-10], np.inf)):
        assert (s == exact[i][at]).all() and set(np.flatnonzero(exact[i] >= np.sort(exact[i])[-10])) <= set(at)
        seen += len(at)
    assert seen < 0.2 * 30 * 500


def test_cells_deal_evenly(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 8))
    x[:1200] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    parts, n = vectors.with_parts(vectors.with_cells(vectors.whole(df, 256.0), 100, 2000, 16), 100, "part")
    sizes = [x["count"] for x in parts.groupBy("part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 200 and len(sizes) <= n
