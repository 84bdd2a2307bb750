import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from gleaner.operators import citations, ordered
from gleaner.sinks import corpus_yaml, record_files
from gleaner.sources import corpus, work_pages


def joined(folder):
    return "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))


def test_ranked(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a string, b int, i int").repartition(7)
    got = sorted(((x.n, x.a, x.b) for x in ordered.ranked(df, ["a", "b"], "n").collect()))
    assert [x[0] for x in got] == list(range(1, 501))
    assert [x[1:] for x in got] == sorted((x[:2] for x in rows), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert ordered.ranked(df.where("false"), ["a"], "n").count() == 0


def test_answers_in_work_order(spark):
    work = spark.createDataFrame([("k2", 1), ("k1", 2), ("k9", 3)], "key string, ord int")
    answers = spark.createDataFrame([("k1", "x"), ("k2", "y"), ("stale", "z")], "key string, payload string")
    got = sorted((r.place, r.key, r.payload) for r in ordered.in_work_order(answers, work, "key", ["ord"]).collect())
    assert got == [(1, "k2", "y"), (2, "k1", "x")]


ENTRY = "manual_review_key string, manual_review_stage string, piece_id string, source_file string, matched_theme string, candidate_themes array<string>, manual_review_reason string, original_text string, repo_dir string, batch_id string"


def test_review_report(spark, tmp_path):
    rows = [(f"k{i:02}", "coarse" if i % 2 else "targeted", f"p{i}" if i else "", "book", "" if i % 2 else "rain", ["a", "b"] if i % 2 else [], "why", f"text\n{i}", "dir", f"batch_{i}") for i in range(25)]
    df = spark.createDataFrame(rows, ENTRY).repartition(5)
    corpus_yaml.write_review(df, str(tmp_path / "review"))
    text = joined(tmp_path / "review")
    heads = [line for line in text.split("\n") if line.startswith("## ")]
    assert text.startswith("# Manual Review Required\n") and heads[:2] == ["## 1. 未知 piece_id | targeted | rain", "## 2. p1 | coarse | a / b"] and len(heads) == 25
    assert [int(h.split()[1].rstrip(".")) for h in heads] == list(range(1, 26))
    assert "- 文献: book\n- 目录: dir\n- 批次: batch_1\n- 原因: why\n- 候选主题: a; b\n\n```text\ntext\n1\n```" in text
    corpus_yaml.write_review(df.where("false"), str(tmp_path / "none"))
    assert corpus_yaml.NOTHING.strip() in joined(tmp_path / "none")


def test_wrapped_and_sorted_records(spark, tmp_path):
    rows = [(f"T{i % 3}", f"p{i * 37 % 100:02}", "rain", "正文") for i in range(100)]
    df = spark.createDataFrame(rows, "target string, piece_id string, matched_theme string, original_text string").repartition(6)
    record_files.write_wrapped(df, str(tmp_path / "all"), project="x")
    found = json.loads(joined(tmp_path / "all"))
    assert found["record_count"] == 100 and found["project"] == "x" and [r["piece_id"] for r in found["records"]] == sorted(r[1] for r in rows)
    record_files.write_wrapped(df.where("false"), str(tmp_path / "none"))
    assert json.loads(joined(tmp_path / "none")) == {"record_count": 0, "records": []}
    record_files.write_records(df, str(tmp_path / "by"))
    own = [json.loads(line)["piece_id"] for line in joined(tmp_path / "by" / "target=T1").splitlines()]
    assert own == sorted(own) and len(own) == 33


def test_expansion_envelope(spark, tmp_path):
    seeds = spark.createDataFrame([(1, "W123"), (2, "W456")], "seed_ord int, seed string")
    edges = spark.createDataFrame([("W900", "W123"), ("W900", "W456"), ("W901", "W456"), ("W1", "W2")], "citing string, cited string")
    record_files.write_expansion(citations.expand(seeds, edges, 2, "cited_by"), str(tmp_path / "e"), "rain", "cited_by", ["W123", "W456"])
    found = json.loads(joined(tmp_path / "e"))
    assert (found["provider"], found["expand_mode"], found["query"], found["params"], len(found["fetches"]), found["record_count"]) == ("openalex-expand", "cited_by", "rain", {"seed_ids": ["W123", "W456"]}, 2, 2)
    assert [(r["work"], r["parents"], r["discovered_round"]) for r in found["records"]] == [("W900", ["W123", "W456"], 2), ("W901", ["W456"], 2)]


# ---- early stop


def tree(root):
    """Two repositories; files of 3, 0, 2 and 4 pages."""
    for name, pages in (("KR1a0001/a.txt", 3), ("KR1a0001/b.txt", 0), ("KR1a0002/a.txt", 2), ("KR1a0002/z.txt", 4), ("KR3j0001/a.txt", 1)):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        open(f"{root}/{name}", "w").write("#+TITLE: t\n" + "".join(f"<pb:{name}-{i}>\ntext {i}\n" for i in range(pages)) + ("" if pages else "# KR1a0001_001\n"))


@pytest.mark.parametrize("limit, files, n", [(0, 1, 0), (2, 1, 2), (3, 1, 3), (4, 3, 4), (6, 4, 6), (50, 4, 9)])
def test_first_fragments_scan_only_their_files(spark, tmp_path, limit, files, n):
    tree(tmp_path)
    targets = spark.createDataFrame([("KR1a", ["KR1a0002", "KR1a0001"]), ("KR9", ["KR9z0001"])], "token string, repo_dirs array<string>")
    chosen = corpus.chosen_files(spark, str(tmp_path), targets, limit)
    assert chosen == {"KR1a": ["KR1a0001/a.txt", "KR1a0001/b.txt", "KR1a0002/a.txt", "KR1a0002/z.txt"][:files], "KR9": []}
    got = corpus.first_fragments_of_tree(spark, str(tmp_path), targets, limit)
    # none at all where no fragment is wanted: the first file was only counted
    assert {f.split("/KR1a")[1] for f in got.inputFiles()} == ({f.split("KR1a")[1] for f in chosen["KR1a"]} if limit else set())
    rows = sorted((r.repo_dir, r.text_file, r.pos) for r in got.collect())
    every = [("KR1a0001", "a.txt", i) for i in range(3)] + [("KR1a0002", "a.txt", i) for i in range(2)] + [("KR1a0002", "z.txt", i) for i in range(4)]
    assert rows == every[:limit] and len(rows) == n


# ---- pages of works


class Works(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Works.asked.append(q)
        n, page, per = {"cites:W1": 120, "cites:W2": 50}.get(q["filter"], 0), int(q["page"]), int(q["per-page"])
        some = range((page - 1) * per, min(n, page * per))
        out = json.dumps({"meta": {"count": n}, "results": [{"id": f"https://openalex.org/W{i}", "display_name": f"{q['filter']} {i}"} for i in some]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *a):
        pass


def test_pages_from_a_service_and_their_replay(spark, tmp_path):
    spark.dataSource.register(work_pages.WorkPages)
    server = HTTPServer(("127.0.0.1", 0), Works)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    filters = json.dumps(["cites:W1", "cites:W2", "cites:W9", "cites:W1"])
    try:
        url = f"http://127.0.0.1:{server.server_port}/works"
        live = spark.read.format("work_pages").options(filters=filters, url=url, pages_per_partition="2", mailto="me").load()
        rows = live.collect()
    finally:
        server.shutdown()
        server.server_close()
    assert len(rows) == 170 and all(q["mailto"] == "me" for q in Works.asked)
    assert sorted({(r["filter"], r.page) for r in rows}) == [("cites:W1", 1), ("cites:W1", 2), ("cites:W1", 3), ("cites:W2", 1)]
    folder = str(tmp_path / "recorded")
    kept = spark.createDataFrame(rows).select("filter", ((F.col("page") - 1) * 50 + F.col("pos")).alias("at"), "payload")
    work_pages.record(kept, folder)
    again = spark.read.format("work_pages").options(filters=filters, replay=folder).load()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    some = spark.read.format("work_pages").options(filters='["cites:W2"]', replay=folder).load()
    assert {r.openalex_id for r in citations.normalize_works(some).collect()} == {f"W{i}" for i in range(50)}
    assert spark.read.format("work_pages").options(filters='["none"]', replay=folder).load().count() == 0
