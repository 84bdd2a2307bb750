import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import quality
from .helpers import SCHEMA

LABELS = "doc_id bigint, quality int, toxic int"


def data(n=400):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        words = [word() for _ in range(r.randrange(20, 120))]
        text = " ".join(words).capitalize() + "." if good else "$$$ ".join(words[:3] * 20).upper()
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_sum_of_squares_equals_all_pairs():
    r = np.random.default_rng(0)
    m = quality.Model(0.3, r.normal(size=12), r.normal(size=(12, 3)))
    row, at, x = np.array([0, 0, 0, 1, 1]), np.array([1, 4, 7, 0, 11]), r.normal(size=5)
    for k in (0, 1):
        a, v = at[row == k], x[row == k]
        pairs = sum(m.factor[a[i]] @ m.factor[a[j]] * v[i] * v[j] for i in range(len(a)) for j in range(i))
        assert m.raw(at, x, row, 2)[k] == pytest.approx(0.3 + m.weight[a] @ v + pairs)


def test_features_do_not_depend_on_the_batch():
    texts = [t for _, t in data(30)[0]] + [None, "", "\n\n", "é 正文 　", "x" * 5000]
    row, at, x = quality.features(pa.array(texts))
    assert set(row) == set(range(len(texts))) and at.max() < quality.SIZE and np.isfinite(x).all()
    for i, t in enumerate(texts):
        _, a, v = quality.features(pa.array([t], pa.string()))
        assert (a == at[row == i]).all() and np.allclose(v, x[row == i])


def test_held_out_accuracy(spark):
    docs, labels = data()
    df = spark.createDataFrame(docs + [(900, None), (901, ""), (None, "Some text.")], SCHEMA).withColumns({"score": F.lit("mine"), "keep": F.lit("me")})
    model = quality.fit(df, spark.createDataFrame(labels + [(900, None, 0), (None, 1, 0), (7777, 1, 1)], LABELS))
    out = quality.score(df, model)
    got = {r.doc_id: r for r in out.withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()}
    assert len(got) == len(docs) + 3 and got[0].keep == "me" and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(bool(got[i].held_out) == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in labels)
    assert np.mean([p == y for p, y in held]) > 0.95 and len(held) > 50
    again = quality.fit(df.repartition(5), spark.createDataFrame(labels, LABELS))
    assert np.allclose(model.weight, again.weight, atol=1e-5)


def test_sample_is_bounded_in_bytes(spark):
    docs, labels = data(60)
    docs[7] = (7, "long words " * 50_000)
    df, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    sample = quality._sample(df, known, 8_000)
    rows = sorted(sample.collect(), key=lambda r: (r["at"], r["name"]))
    room, beyond = 3_000, []
    for r in rows:
        if len(r.text) <= room:
            room -= len(r.text)
        else:
            beyond.append(r["name"])
    assert quality._beyond(sample, 3_000) == beyond and f"7:{labels[7][1]}" in beyond and len(beyond) < len(rows)
    assert quality._beyond(sample, 64 << 20) == []
    # what is passed over teaches nothing
    left = {int(k.split(":")[0]) for k in beyond}
    fewer = known.where(~F.col("doc_id").isin(*left))
    assert np.allclose(quality.fit(df, known, max_bytes=3_000).weight, quality.fit(df, fewer).weight, atol=1e-6)


def test_rows_without_doc_id_are_held_out(spark):
    df = spark.createDataFrame([(None, "a"), (3, "b")], SCHEMA)
    assert {r.doc_id: r.h for r in df.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}[None] is True


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    for rows in ([], [(1, 1, 0), (2, 1, 0)]):
        model = quality.fit(df, spark.createDataFrame(rows, LABELS))
        assert len({r.score for r in quality.score(df, model).collect()}) == 1
    assert quality.score(df.where("false"), model).count() == 0
