import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import chat, decontam, line_dedup, sharding
from .helpers import SCHEMA, corpus, frame


# ---- sharding


def test_shards(spark):
    rows = corpus(200) + [(None, "x"), (2000, "again")]
    got = sharding.shard(frame(spark, rows, ["shard", "slot", "mine", "_bucket"]), [1.0] * 24, buckets=4).collect()
    assert len(got) == len(rows) and got[0].mine == "mine"
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 24) for r in got) and any(r.grown_shard == 24 for r in got)
    text = dict(rows[:-1])
    assert all(r["size"] == 8 + len((text[r.doc_id] or "").encode()) and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got if r.doc_id not in (None, 2000))
    again = {r.doc_id: r.shard for r in sharding.shard(frame(spark, rows).repartition(3), [1.0] * 24).collect()}
    assert again == {r.doc_id: r.shard for r in got}


def test_weights(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = Counter(r.shard for r in sharding.shard(df, [1.0, 3.0, 0.0]).collect())
    assert n[2] == 0 and 2.6 < n[1] / n[0] < 3.4
    assert sharding.shard(df.where("false"), [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df, [0.0])


# ---- chat

TURNS = "conv_id bigint, turn int, role string, text string"


def test_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "more")]
    rows = [(1, i, *t) for i, t in enumerate(a[:1])] + [(2, i, *t) for i, t in enumerate(a)] + [(3, i, *t) for i, t in enumerate(a)]
    rows += [(4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 0, None, None), (6, 0, "", ""), (None, 0, "user", "alone"), (7, 0, "assistant", "yo")]
    got = {r.conv_id: r for r in chat.collapse_and_render(spark.createDataFrame(rows, TURNS).withColumn("n", F.lit(1))).collect()}
    assert set(got) == {2, 4, 5, None, 7}
    assert got[2].n_copies == 2 and got[5].n_copies == 2 and got[2].n_turns == 3
    assert got[4].chat == "<|user|>\nhi\n<|end|>\n<|assistant|>\nother\n<|end|>\n"
    assert got[5].chat == "<|unknown|>\n\n<|end|>\n"
    assert chat.collapse_and_render(spark.createDataFrame([], TURNS)).count() == 0


def test_long_and_nameless_conversations(spark):
    long = spark.range(200_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    start = long.where("turn < 150000").withColumn("conv_id", F.lit(2).cast("bigint"))
    lone = long.withColumn("conv_id", F.lit(None).cast("bigint")).withColumn("text", F.concat(F.lit("x"), F.col("turn") % 50_000))
    first = spark.createDataFrame([(None, 5, "user", "t0")], TURNS)  # the long conversation begins with it
    got = chat.collapse_and_render(long.unionByName(start).unionByName(lone).unionByName(first).withColumn("h1", F.lit("mine")))
    rows = got.groupBy(F.col("conv_id").isNull().alias("lone")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_copies").alias("n"), F.max("n_turns").alias("t"), F.max(F.length("chat")).alias("m")).collect()
    assert {(r.lone, r.c, r.n, r.t) for r in rows} == {(False, 1, 1, 200_000), (True, 50_000, 200_000, 1)}
    assert max(r.m for r in rows) == 200_000 * len("<|user|>\nt0\n<|end|>\n")


def test_repeated_turn_numbers(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (1, None, "system", "s"), (2, None, "system", "s")]
    got = chat.collapse_and_render(spark.createDataFrame(rows, TURNS)).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in got] == [(1, 3, 2)]


# ---- decontamination


def test_contained_items(spark):
    item = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, ""), (5, "-- !"), (1, item), (None, "w1 w2 w3 w4 w5")], "item_id bigint, text string")
    filler = " ".join(f"f{i}" for i in range(3000))
    rows = [(10, f"{filler} {item.upper()}! {filler}"), (11, item.replace("w7", "x")), (12, item.replace("w14", "x").replace(" ", ", ")), (13, "a short one"), (14, "Short... one"), (15, None), (16, ""), (None, item), (17, item), (17, item)]
    docs = frame(spark, rows, ["h", "s", "w"])
    for limit in (1_000_000, 0):
        got = {(r.doc_id, r.item_id): r.containment for r in decontam.contained_items(docs, items, max_broadcast=limit).collect()}
        assert got == {(10, 1): 1.0, (12, 1): 0.9, (14, 2): 1.0, (17, 1): 1.0}
    kept = decontam.clean_documents(docs, items).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted([11, 13, 15, 16, None], key=repr) and kept[0].h == "mine"
    assert decontam.contained_items(docs.where("false"), items).count() == 0
    assert decontam.contained_items(docs, items.where("false")).count() == 0


def test_signatures_lose_no_pair(spark):
    import random

    r = random.Random(6)
    items = [(i, " ".join(r.choice("abcdefghijkl") + r.choice("xyz") for _ in range(r.randrange(5, 60)))) for i in range(40)]
    docs = []
    for i, t in items:
        w = t.split()
        for k in range(4):
            v = list(w)
            for _ in range(k):
                v[r.randrange(len(v))] = "changed"
            docs.append((i * 10 + k, " ".join(["pad"] * r.randrange(50) + v)))

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    want = {(d, i) for d, t in docs for i, u in items if len(grams(u) & grams(t)) >= 0.8 * len(grams(u)) - 1e-9}
    got = decontam.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 50


def test_signatures_avoid_what_items_share(spark):
    prompt = "read the passage below and answer the question that follows it"
    items = [(i, f"{prompt} " + " ".join(f"own{i}x{k}" for k in range(30))) for i in range(25)] + [(99, prompt)]
    frame_of = spark.createDataFrame(items, "item_id bigint, text string")
    sig = {}
    for limit in (1_000_000, 0):
        sig = {i: {r.h for r in decontam.signatures(frame_of, max_broadcast=limit).where(F.col("item_id") == i).collect()} for i in (0, 1, 99)}
        assert len(sig[0]) == len(sig[1]) and not sig[0] & sig[1] and not sig[0] & sig[99] and sig[99]
    # a document that holds the prompt alone is a candidate for the item that is the prompt, and found to contain it
    docs = frame(spark, [(1, f"so {prompt} please"), (2, f"well {items[3][1]}")])
    got = {(r.doc_id, r.item_id) for r in decontam.contained_items(docs, frame_of).collect()}
    assert got == {(1, 99), (2, 99), (2, 3)}


def test_rows_of_one_item_are_one_item(spark):
    parts = [" ".join(f"{c}{k}" for k in range(12)) for c in "ab"]
    items = spark.createDataFrame([(1, parts[0]), (1, parts[1])], "item_id bigint, text string")
    docs = frame(spark, [(1, parts[0]), (2, parts[1]), (3, " ".join(parts))])
    assert {(r.doc_id, r.item_id, r.n_shingles) for r in decontam.contained_items(docs, items).collect()} == {(3, 1, 16)}


# ---- line dedup


def plain_lines(rows, window=3):
    seen, gone = set(), {}
    for d, t in sorted((x for x in rows if x[1] is not None), key=lambda x: x[0]):
        l = t.split("\n")
        for i in range(len(l) - window + 1):
            k = tuple(l[i : i + window])
            if not "".join(k).strip(" "):
                continue
            if k in seen:
                gone.setdefault(d, set()).update(range(i, i + window))
            seen.add(k)
    return {d: (t if t is None or d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(gone.get(d, ()))) for d, t in rows}


def test_line_windows(spark):
    rows = corpus(80)
    got = line_dedup.dedup_lines(frame(spark, rows, ["runs", "lines", "n_lines", "mine"])).collect()
    want = plain_lines(rows)
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == want
    assert sum(n > 0 for _, n in want.values()) > 15 and got[0].mine == "mine"
    assert all(r.n_lines == (0 if r.text is None and not r.n_removed else len(dict(rows)[r.doc_id].split("\n"))) for r in got if r.doc_id != 2000)


def test_line_edges(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd"), (2, "a\nb"), (3, "x\na\nb\nc\ny")], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()), key=repr)
    # rows that share a doc_id are one document; the row without doc_id comes first of all
    assert got == sorted([(1, ""), (1, ""), (None, "a\nb\nc\nd"), (2, "a\nb"), (3, "x\ny")], key=repr)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def plain_rows(rows, window=3):
    """Line dedup of rows, each a document of its own, in the order of doc_id (null first) and then as given."""
    seen, out = set(), list(rows)
    for at in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        d, t = rows[at]
        if t is None:
            continue
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - window + 1):
            k = tuple(lines[i : i + window])
            if "".join(k).strip(" "):
                gone |= set(range(i, i + window)) if k in seen else set()
                seen.add(k)
        out[at] = (d, "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_lines_of_rows_that_share_a_doc_id(spark):
    cases = [
        [(1, "x1\nx2\nx3"), (5, "x1\nx2\nx3\ny"), (5, "p\nq\nr\ns")],
        [(None, "d1\nd2\nd3"), (None, "z0\nd1\nd2\nd3"), (None, "u1\nu2\nu3\nu4\nu5")],
        [(2, "a\nb\nc"), (2, "a\nb\nc"), (None, "a\nb"), (None, "b\na\nb\nc\nd"), (None, None), (2, "")],
    ]
    for rows in cases:
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(plain_rows(rows), key=repr)
        assert sum(r.n_removed for r in got) > 0
