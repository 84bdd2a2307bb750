import numpy as np
import pytest

from gleaner.llm import embedding_dedup
from .helpers import components

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def rows(n=300, dim=24, noise=0.05):
    r = np.random.default_rng(5)
    base = r.normal(size=(n // 6, dim))
    x = base[r.integers(0, len(base), n)] + noise * r.normal(size=(n, dim)) * r.uniform(0.2, 2.2, (n, 1))
    out = [(i, [float(v) for v in np.float32(x[i])], int(r.integers(0, 2))) for i in range(n)]
    out += [(n + 1, out[0][1], out[0][2]), (n + 2, out[0][1], out[0][2]), (n + 3, [2 * v for v in out[3][1]], out[3][2])]
    out += [(n + 10, None, 1), (n + 11, [0.0] * dim, 1), (n + 12, [float("nan")] + [1.0] * (dim - 1), 1), (n + 13, [None] + [1.0] * (dim - 1), 1), (n + 14, out[0][1], None), (n + 15, [], 1), (n + 16, [1.0, 2.0], 1), (n + 17, [1.0, 2.0], 1), (n + 18, [float("inf")] * dim, 1)]
    return out


def brute(data, threshold):
    ok = lambda e: bool(e) and all(v is not None and np.isfinite(v) for v in e) and any(e)
    links, n = [], {i: 0 for i, _, _ in data}
    for a in range(len(data)):
        for b in range(a):
            (i, x, p), (j, y, q) = data[a], data[b]
            if p is not None and p == q and ok(x) and ok(y) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links.append((i, j))
                    n[i], n[j] = n[i] + 1, n[j] + 1
    return n, components([i for i, _, _ in data], links), links


@pytest.mark.parametrize("block", [2048, 8])
def test_against_brute_force(spark, block):
    data = rows()
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, SCHEMA), block=block).collect()}
    n, comp, links = brute(data, 0.93)
    assert len(got) == len(data) and len(links) > 100
    found = sum(r.n_links for r in got.values())
    assert found >= 0.95 * 2 * len(links) and all(got[i].n_links <= n[i] for i in n)
    assert sum(got[i].component_id == comp[i] for i in comp) >= 0.95 * len(comp)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert got[300 + 16].n_links == 1 and all(got[300 + k].n_links == 0 for k in (10, 11, 12, 13, 14, 15, 18))


def test_recall_at_the_threshold():
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y
    h = embedding_dedup.CrossPolytope(64, 5, 2, 3, 11)
    a, b = h.buckets(x), h.buckets(y)
    met = ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).any(1)
    assert met.mean() >= 0.95
    z = h.buckets(r.permutation(x))
    assert ((a == z[:, :, :1]).any(2) | (z == a[:, :, :1]).any(2)).any(1).mean() < 0.02


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (None, [1.0, 0.0], 0)], SCHEMA)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, False)]
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_dense_clusters_of_two_dimensions(spark):
    r, data = np.random.default_rng(3), []
    for dim in (16, 96):
        x = r.normal(size=dim) + 0.22 * r.normal(size=(120, dim))
        data += [(len(data) + i, [float(v) for v in np.float32(row)], 1) for i, row in enumerate(x)]
    n, comp, links = brute(data, 0.93)
    assert len(links) > 5000
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'mine' as rep", "'mine' as codes", "'mine' as n_links", "'mine' as tab")
    for block in (8192, 50):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        assert all(got[i].n_links <= n[i] for i in n)  # none below the threshold
        assert sum(x.n_links for x in got.values()) >= 0.97 * sum(n.values())
        assert {i: x.component_id for i, x in got.items()} == comp


def test_vectors_of_one_vec_id(spark):
    """Different vectors that share a vec_id link with each other, and each counts its own links."""
    near = lambda k: [1.0, 0.01 * k, 0.0, 0.0]
    data = [(1, near(0), 0), (1, near(1), 0), (2, near(2), 0), (3, near(3), 0), (3, near(3), 0), (7, [0.0, 0.0, 1.0, 0.0], 0), (7, [0.0, 0.0, 0.0, 1.0], 0), (5, [0.0, 0.0, 1.0, 0.05], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, SCHEMA), tables=8).collect()
    assert sorted(tuple(r) for r in got) == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (7, 1, 5, False), (7, 0, 7, True), (5, 1, 5, True)])
