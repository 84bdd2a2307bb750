import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import batches, ordered, overview
from gleaner.jobs import screen


def plain(rows, limit):
    """rows of one target in order: (key, n) -> batch numbers from 1."""
    out, batch, filled, now = [], 0, 0, None
    for key, n in rows:
        if key != now or filled + max(1, n) > limit:
            batch, filled, now = batch + 1, 0, key
        filled += max(1, n)
        out.append(batch)
    return out


def test_greedy():
    assert batches.greedy([280, 250], 500) == [0, 1]
    assert batches.greedy([200, 300, 1, 900, 1], 500) == [0, 0, 1, 2, 3]
    assert batches.greedy([], 500) == []


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_assign_against_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    r = random.Random(block)
    rows = [(t, i * 3 + 1, r.choice("ab"), "d", r.randrange(0, 700)) for t in ("x", "y", "z") for i in range(60)]
    df = spark.createDataFrame(rows, "target string, ord bigint, source_file string, repo_dir string, n int")
    got = {(x.target, x.ord): x.batch_ord for x in batches.assign_batches(df.repartition(3)).collect()}
    want = {}
    for t in "xyz":
        own = [x for x in rows if x[0] == t]
        want |= {(t, x[1]): b for x, b in zip(own, plain([(x[2:4], x[4]) for x in own], 500))}
    assert got == want


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_a_long_run_spreads_over_tasks(spark, parts):
    """One run with most of the rows, dealt to many ranges: numbered as by a plain loop."""
    r = random.Random(parts)
    rows = [("x", i, "a", "d", r.choice([0, 1, 40, 250, 250, 499, 500, 501, 900])) for i in range(300)] + [(t, i, r.choice("ab"), "d", r.randrange(0, 700)) for t in ("w", "y") for i in range(40)]
    rows += [("z", i, "a", "d", 250) for i in range(61)] + [("zz", 5, None, None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "target string, ord bigint, source_file string, repo_dir string, n int")
    got = {(x.target, x.ord): x.batch_ord for x in batches.assign_batches(df, keep=("n",), parts=parts).collect()}
    want = {}
    for t in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == t), key=lambda x: x[1])
        want |= {(t, x[1]): b for x, b in zip(own, plain([(x[2:4], x[4] or 0) for x in own], 500))}
    assert got == want
    assert batches.assign_batches(df.where("false"), keep=(), parts=parts).count() == 0


def test_transitions_against_a_plain_loop():
    r = random.Random(3)
    for _ in range(60):
        limit, n = r.randrange(1, 30), [r.randrange(0, 40) for _ in range(r.randrange(1, 25))]
        first, opened, left = batches.transitions(np.array(n), limit)
        for entry in range(limit + 1):
            fill, count, where = entry, 0, len(n)
            for i, x in enumerate(n):
                x = max(1, x)
                if fill + x > limit:
                    fill, count, where = 0, count + 1, min(where, i)
                fill += x
            assert (first[entry], opened[entry], left[entry]) == (where, count, min(fill, limit))


def test_batch_count(spark):
    rows = [([],), ([280, 250],), ([200, 300, 1, 900, 1],), ([0, None, 500],), (None,)]
    got = spark.createDataFrame(rows, "n array<int>").select(batches.batch_count(F.col("n")).alias("k"), batches.batch_numbers(F.col("n")).alias("b")).collect()
    assert [r.k for r in got] == [0, 2, 4, 2, None] and [r.b for r in got][:3] == [[], [0, 1], [0, 0, 1, 2, 3]] and got[4].b == []


def test_batch_rows(spark):
    f = spark.createDataFrame([("t", 1, "p1", "甲", 280, 1), ("t", 2, "p2", "乙", 250, 2), ("t", 3, "p3", "丙", 9, 2)], "target string, ord bigint, piece_id string, original_text string, n int, batch_ord bigint")
    got = batches.batch_rows(f, ["target"], "ord").orderBy("batch_ord").collect()
    assert [(r.batch_id, r.piece_ids, r.batch_text, r.char_count) for r in got] == [("batch_000001", ["p1"], "甲", 280), ("batch_000002", ["p2", "p3"], "乙\n\n丙", 259)]


def test_document_batches_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n"), (4, "x" * 600 + "\ny\nz")], "doc_id bigint, text string")
    got = screen.document_batches(docs).orderBy("doc_id", "batch").collect()
    assert [(r.doc_id, r.batch, [p.pos for p in r.pieces], r.char_count) for r in got] == [(4, 0, [0], 600), (4, 1, [1, 2], 2)]


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_ordered(spark, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    rows = [("a", 0, "s", 1), ("a", 1, None, 2), ("a", 5, None, 3), ("a", 9, "u", 4), ("b", 3, None, 5)]
    df = spark.createDataFrame(rows, "g string, o bigint, v string, n int")
    one = {(r.g, r.o): r.x for r in ordered.running_sum(df, ["g"], "o", "n", "x").collect()}
    assert one == {("a", 0): 1, ("a", 1): 3, ("a", 5): 6, ("a", 9): 10, ("b", 3): 5}
    two = {(r.g, r.o): r.prev_n for r in ordered.previous(df, ["g"], "o", ["n"]).collect()}
    assert two == {("a", 0): None, ("a", 1): 1, ("a", 5): 2, ("a", 9): 3, ("b", 3): None}
    three = {(r.g, r.o): r.x for r in ordered.carry_forward(df, ["g"], "o", "v", "x").collect()}
    assert three == {("a", 0): "s", ("a", 1): "s", ("a", 5): "s", ("a", 9): "u", ("b", 3): None}


def test_overview_of_two_pages(spark):
    f = spark.createDataFrame([("f", 0, "春风池馆闲写花光"), ("f", 1, "冬雷忽作诗\n人惊而")], "text_file string, pos int, original_text string")
    got = overview.measure_files(f, ["text_file"], "pos").first()
    assert (got.chars, got.fragments, got.batches) == (16, 2, 1)
    targets = spark.createDataFrame([("KR1a", "family", ["KR1a0001"]), ("KR2a", "family", ["KR2a0001"])], "token string, level string, repo_dirs array<string>")
    files = spark.createDataFrame([("KR1a0001", "f", 16, 2, 1)], "repo_dir string, text_file string, chars bigint, fragments bigint, batches bigint")
    o = overview.target_overview(targets, files)
    assert {r.token: tuple(r)[2:] for r in o.collect()} == {"KR1a": (1, 1, 16, 2, 1), "KR2a": (1, 0, 0, 0, 0)}
    assert tuple(overview.overview_total(o, targets).first()) == (2, 1, 16, 2, 1)


def test_timing(spark):
    o = spark.createDataFrame([("KR1a", "family", 1, 1, 1, 2400, 1000)], "token string, level string, repo_dir_count bigint, text_file_count bigint, text_char_count bigint, fragment_count bigint, batch_count bigint")
    e = overview.timing(o, 10, 10)
    assert (e.first().targeted_batch_count, e.first().lower_bound_seconds) == (10, 4040)
    assert overview.timing_total(e).first().upper_bound_seconds == 6060
    none = o.withColumn("batch_count", F.lit(0).cast("bigint")).withColumn("text_char_count", F.lit(1201).cast("bigint"))
    assert overview.timing(none, 10, 10).first().batch_count == 3


def test_merge_overviews(spark):
    schema = "token string, level string, repo_dir_count bigint, text_file_count bigint, text_char_count bigint, fragment_count bigint, batch_count bigint"
    a = spark.createDataFrame([("KR1a", "family", 1, 1, 10, 1, 1), ("KR3j", "family", 1, 1, 7, 1, 1)], schema)
    b = spark.createDataFrame([("KR3j", "family", 1, 1, 40, 2, 1)], schema)
    m = overview.merge_overviews(a, b)
    assert {r.token: r.text_char_count for r in m.collect()} == {"KR1a": 10, "KR3j": 40}
    assert overview.merged_total(m).first().text_char_count == 50
