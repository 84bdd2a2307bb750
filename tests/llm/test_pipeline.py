import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from gleaner.llm import packing, queries
from .test_quality import data


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs, labels = data(300)
    item = "benchmark question number one asks what the answer of this long test item may be today"
    docs += [(500, "Some clean text. " + item + " And more clean text after it."), (501, docs[0][1]), (502, "First line here.\nSecond line here.\nThird line here.\nOwn ending."), (503, "First line here.\nSecond line here.\nThird line here.\nOther ending of its own."), (504, None), (505, "")]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": [t for _, t in docs], "lang": ["en"] * len(docs), "source": ["s"] * len(docs), "n_chars": pa.array([len(t or "") for _, t in docs], pa.int64())}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _, _ in labels], pa.int64()), "quality": pa.array([q for _, q, _ in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), d / "benchmark.parquet")
    return str(d), dict(docs), {i: q for i, q, _ in labels}


def test_stages(spark, tables):
    d, docs, good = tables
    df = spark.read.parquet(os.path.join(d, "documents.parquet"))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, d)
        df.write.parquet(f"{d}/out{k}")
        df = spark.read.parquet(f"{d}/out{k}")
        if k < 4:
            assert df.columns == corpus_pipeline.COLUMNS
            left[name] = {r.doc_id: r.text for r in df.collect()}
    first = left["quality_classifier"]
    assert sum(bool(good[i]) == (i in first) for i in good) > 0.97 * len(good) and {500, 502, 503} <= set(first)
    assert left["line_dedup"][503] == "Other ending of its own." and left["line_dedup"][502] == docs[502]
    assert (0 in left["simhash_near_dedup"]) == (0 in first) and 501 not in left["simhash_near_dedup"]
    assert 500 not in left["benchmark_decontamination"] and len(left["benchmark_decontamination"]) == len(left["simhash_near_dedup"]) - 1
    pieces = df.collect()
    assert {r.doc_id for r in pieces} == set(left["benchmark_decontamination"])
    bound = packing.lower_bound(__import__("numpy").array([r.length for r in pieces]), 2048)
    assert len({r.sequence_id for r in pieces}) == bound


def test_run_gives_the_last_stage(spark, tables):
    got = corpus_pipeline.run(spark, tables[0])
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_leaks_and_copies_without_doc_id_go(spark, tables):
    item = "benchmark question number one asks what the answer of this long test item may be today"
    rows = [(None, "Before it. " + item + " After it."), (None, "a clean text of its own"), (7, "another clean text here"), (None, "another clean text here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    got = corpus_pipeline.drop_benchmark_leaks(spark, df, tables[0])
    assert got.columns == corpus_pipeline.COLUMNS and sorted(r.text for r in got.collect()) == sorted(t for _, t in rows[1:])
    got = corpus_pipeline.drop_near_duplicates(spark, df, tables[0]).collect()
    assert sorted((r.text, r.doc_id) for r in got) == sorted([(rows[0][1], None), (rows[1][1], None), (rows[2][1], 7)])
