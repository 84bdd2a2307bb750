import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import suffix_dedup
from .helpers import SCHEMA, corpus, frame


def brute(rows, length):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for k, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    out = []
    for k, b in enumerate(texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if len(seen[b[i : i + length]]) > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((rows[k][0], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def run(df, **how):
    out = suffix_dedup.remove_repeats(df, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("max_group", [4096, 3, 1])
def test_against_brute_force(spark, max_group):
    rows = corpus() + [(3, corpus()[0][1]), (None, corpus()[1][1]), (None, None)]
    assert run(frame(spark, rows, ["spans", "kept", "rk", "n_bytes"]), length=60, gram=8, max_group=max_group) == brute(rows, 60)


def test_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    r = random.Random(2)
    unit = "".join(r.choice("ab") for _ in range(300))
    rows = [(1, "".join(r.choice("abc") for _ in range(1700)) + unit), (2, unit + "".join(r.choice("abc") for _ in range(2100)) + unit), (3, "ab" * 700), (4, "q" * 900)]
    assert run(frame(spark, rows), length=60, gram=8) == brute(rows, 60)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(df).count() == 0


def test_range_min():
    x = np.random.default_rng(0).integers(0, 99, 500)
    lo = np.random.default_rng(1).integers(0, 499, 300)
    hi = np.minimum(499, lo + np.random.default_rng(2).integers(0, 300, 300))
    assert (suffix_dedup._range_min(x, lo, hi) == [x[a : b + 1].min() for a, b in zip(lo, hi)]).all()


def test_repeated_rows_enter_a_collection_once(spark, monkeypatch):
    r = random.Random(8)
    text = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows = [(1, text)] * 300 + [(2, text[:450] + "#" + text[450:]), (2, text[:450] + "#" + text[450:])]
    counts, keep = [], suffix_dedup.save

    def save(df, name):
        out = keep(df, name)
        if name == "cut":
            counts.append(out.groupBy("g").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(suffix_dedup, "save", save)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    assert counts == [2] or counts == []
    assert got == {(1, 900, 1, b""), (2, 901, 1, b"")}
