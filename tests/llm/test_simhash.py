import re

import numpy as np
import pytest
import xxhash

from gleaner.llm import simhash
from .helpers import SCHEMA, components, corpus, frame, long_texts


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(rows):
    fp = {i: plain(t) for i, t in rows}
    ids = list(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 4]
    return fp, components(ids, links)


@pytest.mark.parametrize("max_group", [200_000, 1])
def test_against_brute_force(spark, max_group):
    base = "the quick brown Fox jumps over lazy dogs and runs " * 12
    near = [(5000 + i, base + f" end{i}") for i in range(12)]
    rows = corpus() + near + [(5100, "A b C d e"), (5101, "a\tB\x0bc  D\ne"), (5102, "a b")]
    got = simhash.near_duplicates(frame(spark, rows, ["fp", "component_id", "rep"]), max_group=max_group).collect()
    fp, comp = brute(rows)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fp.items()}
    assert {r.doc_id: r.component_id for r in got} == comp


def test_trie_pairs():
    r = np.random.default_rng(3)
    fp = np.unique(np.concatenate([r.integers(0, 1 << 63, 40).astype(np.uint64)[:, None] ^ (np.uint64(1) << r.integers(0, 64, (40, 5)).astype(np.uint64))], axis=None))
    group = np.zeros(len(fp), np.int64)
    got = {(int(min(x, y)), int(max(x, y))) for a, b in simhash.trie_pairs(group, fp, 4) for x, y in zip(a, b)}
    want = {(i, j) for j in range(len(fp)) for i in range(j) if int(fp[i] ^ fp[j]).bit_count() <= 4}
    assert got == want and len(want) > 40


def test_random_fingerprints_against_all_pairs(spark):
    r = np.random.default_rng(8)
    base = [int(x) for x in r.integers(0, 1 << 62, 60)]
    fps = {b ^ sum(1 << int(k) for k in r.choice(63, m, replace=False)) for b in base for m in (0, 2, 4, 5, 7)}
    rows = [(f, i) for i, f in enumerate(sorted(fps))]
    for limit in (1000, 1):
        links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp bigint, rep bigint"), 4, limit).collect()
        want = components([i for _, i in rows], [(j, i) for f, i in rows for g, j in rows if j < i and (f ^ g).bit_count() <= 4])
        assert components([i for _, i in rows], [tuple(x) for x in links]) == want


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "a b c d"), (9, None), (8, "")], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, None), (4, 2), (4, 2), (2, 2), (9, 8), (8, 8)], key=repr)
    kept = simhash.keep_representatives(df.withColumnRenamed("text", "text")).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted([None, 2, 8], key=repr)
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_texts_of_several_megabytes(spark):
    rows = long_texts()
    assert len(rows[0][1].encode()) > 3_000_000
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{plain(t):016x}" for i, t in rows}
    assert [got[i][1] for i in (1, 2, 3, 4)] == [1, 2, 1, 4]
