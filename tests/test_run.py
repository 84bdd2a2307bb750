import json
import os
import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from gleaner.jobs import catalogue, screen
from gleaner.jobs import run as job
from gleaner.jobs.state import read_json, write_json
from gleaner.jobs.log import ResponseLog
from gleaner.operators.screening import FormatError, RemoteScreener, RequestError, RuleScreener
from gleaner.sinks import record_files
from gleaner.sources.chat_client import MAX_TOKENS, ChatClient

THEMES = ["唐宋冬雷题咏", " ", "other"]
SCHEMA = "target string, ord bigint, piece_id string, source_file string, repo_dir string, original_text string"


def corpus(spark):
    rows = [("KR4c", 1, "1a", "测试唐诗", "KR4c0001", "冬雷忽作，诗人惊而有咏。"), ("KR4c", 2, "1b", "测试唐诗", "KR4c0001", "春风池馆，闲写花光。"), ("KR4d", 1, "2a", "别集", "KR4d0001", "无关文字")]
    return spark.createDataFrame(rows, SCHEMA)


def model(folder, kept, down=(), broken=()):
    """A client that notes its calls: coarse prompts with 忽作 are relevant, targeted ones keep `kept`, arbiters refuse."""

    def make():
        def call(prompt, key):
            with open(os.path.join(folder, f"{os.getpid()}.txt"), "a") as f:
                f.write(prompt.replace("\n", "|") + "\n")
            if any(d in prompt for d in down):
                raise OSError("down")
            if any(d in prompt for d in broken):
                return "no json"
            if prompt.startswith("1: "):
                return json.dumps({"1": "T" if "忽作" in prompt else "F", "3": "F"})
            if prompt.startswith("{"):
                return json.dumps({"is_relevant": False, "reason": "no"})
            return json.dumps({"results": [{"piece_id": p, "reason": "r"} for p in kept]})

        return call

    return make


def calls(folder):
    return sum(len(open(os.path.join(folder, f)).read().splitlines()) for f in os.listdir(folder))


def screeners(folder, one=(), two=(), **how):
    s = lambda kept, **more: RemoteScreener(model(folder, kept, **more), partitions=1, network_retries=0, **how)
    return {"llm1": s(["1a"], **dict(one)), "llm2": s(["1a", "1b"], **dict(two)), "llm3": s([])}


def test_dual_screening_reuse_and_resume(spark, tmp_path):
    log, work = str(tmp_path / "calls"), str(tmp_path / "work")
    os.mkdir(log)
    told = []
    with pytest.raises(job.Paused):
        job.run(spark, corpus(spark), THEMES, screeners(log, two={"down": ["忽作"]}), work)
    assert read_json(spark, f"{work}/run_state.json")["phase"] == "failed" and "llm2" in read_json(spark, f"{work}/run_state.json")["last_error"]
    before = calls(log)
    out = job.run(spark, corpus(spark), THEMES, screeners(log), work, tell=lambda kind, what: told.append(what))
    # llm1 isn't asked again, llm2 once for the failed batch; one pair for both, one dispute
    assert calls(log) - before == 1 + 2 + 1
    (r,) = out.records.collect()
    assert (r.target, r.piece_id, r.matched_theme, r.judgment, r.note, r.source_file) == ("KR4c", "1a", "唐宋冬雷题咏", "consensus", "llm1: r | llm2: r", "测试唐诗")
    assert out.review.count() == 0 and told[-1] == {"phase": "completed"}
    s = {r.target: r for r in out.summary.collect()}
    assert s["KR4c"].asDict() | {"updated_at": None} == {"target": "KR4c", "repo_dir_count": 1, "fragment_count": 2, "batch_count": 1, "candidate_pair_count": 1, "consensus_count": 1, "dispute_count": 1, "manual_review_count": 0, "final_record_count": 1, "final_piece_count": 1, "arbitrated_keep_count": 0, "is_completed": True, "updated_at": None}
    assert s["KR4d"].fragment_count == 1 and s["KR4d"].final_record_count == 0
    assert [(r.piece_id, r.target) for r in out.disputes.collect()] == [("1b", "KR4c")]
    stored = record_files.project_records(spark, f"{work}/records", "piece_id string, matched_theme string, judgment string").collect()
    assert [(r.target, r.piece_id, r.judgment) for r in stored] == [("KR4c", "1a", "consensus")]
    n = calls(log)
    assert job.run(spark, corpus(spark), THEMES, screeners(log), work).records.count() == 1 and calls(log) == n
    changed = corpus(spark).withColumn("original_text", F.concat("original_text", F.lit("。")))
    job.run(spark, changed, THEMES, screeners(log), work)
    assert calls(log) > n
    # a text that changes in one target asks for that target's batch alone, of either screener
    n = calls(log)
    job.run(spark, changed.withColumn("original_text", F.when(F.col("target") == "KR4d", "another").otherwise(F.col("original_text"))), THEMES, screeners(log), work)
    assert calls(log) - n == 2
    # another model is asked anew
    n, other = calls(log), screeners(log)
    other["llm1"] = replace(other["llm1"], model="another")
    job.run(spark, changed, THEMES, other, work)
    assert calls(log) - n == 3


def test_answers_are_kept_slice_by_slice(spark, tmp_path):
    log, todo = ResponseLog(spark, str(tmp_path / "log")), spark.range(40).select(F.col("id").cast("string").alias("key"), F.lit("p").alias("prompt"))

    class Dies:
        left = 2

        def screen(self, requests):
            if not self.left:
                raise RuntimeError("killed")
            self.left -= 1
            return RuleScreener(F.lit("{}")).screen(requests)

    with pytest.raises(RuntimeError):
        log.ask(Dies(), todo, "coarse", "llm1", "m", slice_rows=10)
    left = log.pending(todo, "coarse", "llm1", "m").count()
    assert 0 < left < 40
    assert log.ask(RuleScreener(F.lit("{}")), todo, "coarse", "llm1", "m", slice_rows=10).count() == 40


class Noting:
    """A rule that notes how many requests each call brings."""

    def __init__(self, local):
        self.local, self.calls = local, []

    def screen(self, requests):
        self.calls.append(requests.count())
        return RuleScreener(F.lit("{}")).screen(requests)


def test_rules_are_asked_at_once(spark, tmp_path):
    todo = spark.range(40).select(F.col("id").cast("string").alias("key"), F.lit("p").alias("prompt"))
    rule, remote = Noting(True), Noting(False)
    assert ResponseLog(spark, str(tmp_path / "a")).ask(rule, todo, "coarse", "llm1", "m", slice_rows=10).count() == 40 and rule.calls == [40]
    assert ResponseLog(spark, str(tmp_path / "b")).ask(remote, todo, "coarse", "llm1", "m", slice_rows=10).count() == 40
    # in slices, whose folder is gone afterwards
    assert len(remote.calls) == 4 and sum(remote.calls) == 40 and sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_repeated_pieces_waves_and_tables_left(spark, tmp_path):
    said = [("A", 1, "p1", "f1", "der one"), ("A", 2, "p2", "f1", "by the way"), ("A", 3, "p1", "f2", "under two"), ("B", 1, "p1", "f3", "der of B"), ("C", 1, "p3", "f4", "nothing")]
    f = spark.createDataFrame([(t, o, p, s, "dir", x) for t, o, p, s, x in said], SCHEMA)
    out = job.run(spark, f, [t for _, t in screen.THEMES], {f"llm{i}": catalogue._Rules(i) for i in (1, 2, 3)}, str(tmp_path), wave_fragments=2)
    # a piece's last text counts, within its target; the other judge wants longer texts, the arbiter even lengths
    assert {(r.target, r.piece_id, r.matched_theme, r.source_file, r.original_text, r.judgment) for r in out.records.collect()} == {("A", "p2", "by the", "f1", "by the way", "arbitrated"), ("B", "p1", "der", "f3", "der of B", "arbitrated")}
    got = {r.target: (r.fragment_count, r.batch_count, r.candidate_pair_count, r.dispute_count, r.manual_review_count) for r in out.summary.collect()}
    assert got == {"A": (3, 2, 3, 2, 0), "B": (1, 1, 1, 1, 0), "C": (1, 1, 0, 0, 0)}
    # of a wave's own tables no snapshot is left, and of the dealt fragments none
    left = {n: [d for d in os.listdir(tmp_path / n) if not d.startswith((".", "_"))] for n in ("file_runs", "batches", "pairs", "verdicts", "dealt")}
    assert not any(left.values()), left


class Service(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append((body, self.headers["Authorization"]))
        prompt = body["messages"][0]["content"]
        code = 422 if "response_format" in body and prompt == "plain" else 500 if prompt == "fail" else 200
        content = [{"type": "text", "text": '{"a"'}, {"text": ": 1}"}] if prompt == "parts" else '{"a": 1}'
        out = json.dumps({"choices": [] if prompt == "none" else [{"message": {"content": content}}]}).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *a):
        pass


def test_client():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = ChatClient(f"http://127.0.0.1:{server.server_port}", "m", MAX_TOKENS["coarse"])
        assert ask("x", "k1") == '{"a": 1}' and ask("parts", "k2") == '{"a": 1}'
        assert Service.seen[-1][1] == "Bearer k2" and Service.seen[-1][0]["max_tokens"] == 400 and Service.seen[-1][0]["temperature"] == 0
        n = len(Service.seen)
        assert ask("plain", "k") == '{"a": 1}' and len(Service.seen) == n + 2 and "response_format" not in Service.seen[-1][0]
        with pytest.raises(RequestError, match="HTTP 500"):
            ask("fail", "k")
        with pytest.raises(FormatError):
            ask("none", "k")
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(OSError):
        ask("x", "k")


def test_exhausted_fallback_keeps_pieces_for_review(spark, tmp_path):
    log, work = str(tmp_path / "calls"), str(tmp_path / "work")
    os.mkdir(log)
    s = screeners(log, two={"broken": ["### 1a"]}, make_fallback=lambda: lambda p, k: "still no json", retries=2)
    out = job.run(spark, corpus(spark), THEMES, s, work)
    got = {r.piece_id: r for r in out.records.collect()}
    assert set(got) == {"1a"} and got["1a"].needs_manual_review
    entries = out.review.collect()
    assert {(e.piece_id, e.manual_review_stage, e.matched_theme) for e in entries} == {(p, "targeted", "唐宋冬雷题咏") for p in ("1a", "1b")}


def test_state(spark, tmp_path):
    path = str(tmp_path / "s.json")
    assert read_json(spark, path, {"a": 1}) == {"a": 1}
    write_json(spark, path, {"é": "正文"})
    assert read_json(spark, path)["é"] == "正文" and "updated_at" in read_json(spark, path)
    open(path, "w").write("{")
    os.path.exists(str(tmp_path / ".s.json.crc")) and os.remove(tmp_path / ".s.json.crc")
    assert read_json(spark, path, {"b": 2}) == {"b": 2}
