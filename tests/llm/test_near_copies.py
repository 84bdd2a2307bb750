import random

import numpy as np
import pytest

import corpus_pipeline
from gleaner.llm import near_copies, simhash
from .helpers import components, corpus, frame


def shingles(text):
    w = (text or "").lower().split(" ")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def copies(n=60, seed=5):
    """Texts with copies of 2 to 9 changed words of 200, and chains of copies."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        body = [r.choice(words) for _ in range(200)]
        rows.append((len(rows), " ".join(body)))
        for _ in range(3):
            body = list(body) if i % 3 == 0 else rows[-1][1].split(" ")
            for at in r.sample(range(200), r.randrange(2, 10)):
                body[at] = r.choice(words)
            rows.append((len(rows), " ".join(body)))
    return rows


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    pairs = [(i, j, similarity(a, b)) for k, (i, a) in enumerate(sets) for j, b in sets[:k]]
    return [(i, j) for i, j, x in pairs if x >= 0.8], pairs


@pytest.mark.parametrize("block", [4000, 2])
def test_against_brute_force(spark, block):
    rows = copies()
    links, pairs = brute(rows)
    far = [(i, j) for i, j, x in pairs if 0.8 <= x < 0.9]
    fp = {i: simhash.fingerprint(t) for i, t in rows}
    missed = [p for p in far if (fp[p[0]] ^ fp[p[1]]).bit_count() > 4]
    assert len(missed) > 20  # what four differing bits of op3 don't link
    want = {i for i, c in components([i for i, _ in rows], links).items() if i == c}
    got = near_copies.keep_representatives(frame(spark, rows, ["row", "fp"]), block=block)
    assert got.columns == ["doc_id", "text", "row", "fp"] and {r.doc_id for r in got.collect()} == want


def test_forest_spans_all_links():
    rows = copies(30, 8)
    names = {}
    sets = [np.array([names.setdefault(s, len(names)) for s in shingles(t)]) for _, t in rows]
    ids = [i for i, _ in rows]
    links, _ = brute(rows)
    assert components(ids, near_copies.similar_pairs(sets, 0.8)) == components(ids, links)
    one = [np.arange(k, k + 40) for k in (0, 4, 5, 60)]
    assert components(range(4), near_copies.similar_pairs(one, 0.8)) == {0: 0, 1: 0, 2: 0, 3: 3}


def test_forest_goes_on_from_what_is_known():
    rows = copies(30, 8)
    names = {}
    sets = [np.array([names.setdefault(s, len(names)) for s in shingles(t)]) for _, t in rows]
    ids = list(range(len(rows)))
    links, _ = brute(rows)
    some = links[::2]
    low = components(ids, some)
    more = near_copies.similar_pairs(sets, 0.8, np.array([low[i] for i in ids]))
    assert components(ids, some + more) == components(ids, links) and len(more) < len(near_copies.similar_pairs(sets, 0.8))


def test_bands_of_many_components(spark):
    """Texts that share much, in bands with others that aren't their copies: pairs that no first document joins are found."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(12):
        own = [f"o{k}x{i}" for i in range(55)]
        for j in range(3):
            body = base + own
            body = [w if r.random() > 0.008 else f"n{k}{j}{r.random()}" for w in body]
            rows.append((len(rows), " ".join(body)))
    r.shuffle(rows)
    links, pairs = brute(rows)
    assert sum(0.4 < x < 0.8 for *_, x in pairs) > 300 and len(links) > 10
    want = {i for i, c in components([i for i, _ in rows], links).items() if i == c}
    assert {x.doc_id for x in near_copies.keep_representatives(frame(spark, rows)).collect()} == want


def test_edges(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "A b\tc d"), (2, "a b c d"), (None, "other words"), (9, None), (8, ""), (7, "a b c e")]
    got = near_copies.keep_representatives(frame(spark, rows)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted([2, None, 8, 7], key=repr)
    assert near_copies.keep_representatives(frame(spark, corpus()).where("false")).count() == 0


def test_stage_drops_near_copies(spark):
    body = [f"word{i}" for i in range(200)]
    links = []
    for k in range(40):
        mine = [f"{w}of{k}" for w in body]
        links += [(2 * k, " ".join(mine)), (2 * k + 1, " ".join("new" if i in (30, 80, 130, 180) else w for i, w in enumerate(mine)))]
    df = frame(spark, links).selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in got.collect()} == set(range(0, 80, 2))
