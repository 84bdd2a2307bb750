import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    said = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    d, s, l, n, t = row
    return H(*(said(x) for x in (d, s, l, n if n is None else n + more, t)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain(data, altered):
    langs = sorted({r[2] for r in data}, key=lambda l: (l is not None, (l or "").encode()))
    trees = {}
    for l in langs:
        own = sorted((r for r in data if r[2] == l), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[l] = (own, levels([leaf(r) for r in own]))
    top, out = levels([trees[l][1][-1][0] for l in langs]), []
    for p, l in enumerate(langs):
        own, tree = trees[l]
        for i, r in enumerate(own):
            node, proof = leaf(r, 1 if altered(r) else 0), []
            for lv, at in [(lv, i >> k) for k, lv in enumerate(tree[:-1])] + [(lv, p >> k) for k, lv in enumerate(top[:-1])]:
                other = lv[at ^ 1] if at ^ 1 < len(lv) else None
                proof += [other] if other else []
                node = H(node) if other is None else H(other, node) if at & 1 else H(node, other)
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], H(*proof), node, node == top[-1][0]))
    return out


def rows(n=150):
    out = [(i * 3, f"s{i % 4}", ["en", "de", None, "é", "正文"][i % 7 % 5], i if i % 9 else None, f"text {i} ünï 正文\n" * (i % 5)) for i in range(n)]
    out += [(None, None, None, None, None), (None, "x", "en", 3, "one"), (None, "x", "en", 3, "one"), (6, "x", "en", 3, "other"), (6, "x", "en", 3, "other"), (7, "", "solo", 0, ""), (8, "a", "", 1, "empty language"), (9, "a", "en", 1, "long " * 300_000)]
    return out


crc = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0


@pytest.mark.parametrize("height", [10, 2])
def test_manifest(spark, height):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumns({"tree": F.lit("mine"), "idx": F.lit(1), "leaf": F.lit("x"), "digest": F.lit("y")})
    altered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = merkle.manifest(df, altered, height).collect()
    want = plain(data, crc)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert any(not r.verified for r in got) and all(r.verified == (r.folded_root == r.root) for r in got)
    # rows without n_chars can't be altered
    assert all(r.verified for r in merkle.manifest(df, None, height).collect())


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "s", "en", 2, "ab")], SCHEMA)
    r = merkle.manifest(df).first()
    assert r.leaf == r.subroot == r.root == leaf((1, "s", "en", 2, "ab")) and r.proof_sha256 == H() and r.verified
    assert merkle.manifest(df.where("false")).count() == 0


def test_places_are_a_postorder():
    for n in [1, 2, 3, 5, 8, 13, 31, 64, 77]:
        order = []

        def visit(level, i):
            if level:
                for c in (2 * i, 2 * i + 1):
                    if c < merkle.nodes_at(n, level - 1):
                        visit(level - 1, c)
            order.append((level, i))

        visit(merkle.height_of(n), 0)
        assert [merkle.place(n, *x) for x in order] == list(range(len(order)))


def test_log_is_in_order_of_completion(spark):
    df = spark.createDataFrame([(i, None, "en", i, "t") for i in range(45)], SCHEMA)
    leaves = merkle.numbered(df.select(F.lit("t").alias("tree"), F.sha2("text", 256).alias("digest"), "doc_id"), ["doc_id"])
    assert sorted((r.idx, r.doc_id, r.n) for r in leaves.collect()) == [(i, i, 45) for i in range(45)]
    segments, above, tops = merkle.grow(leaves.select("tree", "idx", "n", "digest"), 3)
    taken = [p for r in segments.collect() for p in range(r.first, r.first + len(r.nodes) // 32)]
    upper = {r.place for r in above.collect()}
    size = sum(merkle.nodes_at(45, l) for l in range(merkle.height_of(45) + 1))
    assert len(taken) == len(set(taken)) and set(taken) | upper == set(range(size)) and tops.first().root == levels([H("t")] * 45)[-1][0]
