import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from gleaner.jobs import run as job
from gleaner.jobs.commits import Commits, Conflict, expand_counts
from gleaner.jobs.log import ResponseLog
from gleaner.operators.screening import Busy, RemoteScreener, Reply
from gleaner.sources.chat_client import ChatClient, answer_text
from gleaner.sources.pacing import Pace, seconds_of
from .test_run import SCHEMA, calls


def test_commits_compare_and_swap(spark, tmp_path):
    c = Commits(spark, str(tmp_path / "commits"))
    assert c.version() == -1 and c.current().count() == 0
    at = c.commit([{"target": "a", "phase": "x"}, {"target": "b", "phase": "x"}], -1)
    # another target may move meanwhile, the same may not
    assert c.commit([{"target": "c", "phase": "x"}], -1) == at + 1
    with pytest.raises(Conflict):
        c.commit([{"target": "b", "phase": "y"}], -1)
    assert c.commit([{"target": "b", "phase": "done", "is_completed": True, "counts": {"n": 3}, "snapshot": "s", "epoch": 2}], at) == at + 2
    got = {r.target: (r.phase, r.version, r.is_completed) for r in c.current().collect()}
    assert got == {"a": ("x", 0, False), "b": ("done", 2, True), "c": ("x", 1, False)}
    assert {(r.target, r.n, r.m) for r in expand_counts(c.current(), ("n", "m")).collect()} == {("a", 0, 0), ("b", 3, 0), ("c", 0, 0)}
    assert c.history().count() == 4


def test_one_of_many_writers_wins_each_version(spark, tmp_path):
    c, out = Commits(spark, str(tmp_path / "commits")), []
    work = [threading.Thread(target=lambda i=i: out.append(c.commit([{"target": f"t{i}"}], -1))) for i in range(8)]
    [w.start() for w in work]
    [w.join() for w in work]
    assert sorted(out) == list(range(8)) and c.current().count() == 8


THEMES = ["rain"]


def targets(spark, n, changed=()):
    """n targets of three files with two fragments each."""
    rows = [(f"T{t:02}", 10 * f + k, f"{t}-{f}-{k}", f"file{f}", "dir", ("new " if (t, f) in changed else "") + f"rain in target {t} file {f} piece {k}") for t in range(n) for f in range(3) for k in range(2)]
    return spark.createDataFrame(rows, SCHEMA)


def model(folder, dies=None):
    def make():
        def call(prompt, key):
            if dies and dies in prompt:
                raise KeyError("killed")
            with open(os.path.join(folder, f"{os.getpid()}.txt"), "a") as f:
                f.write(prompt.replace("\n", "|") + "\n")
            if prompt.startswith("1: "):
                return json.dumps({"1": "T"})
            if prompt.startswith("{"):
                return json.dumps({"is_relevant": True, "reason": "r"})
            return json.dumps({"results": [{"piece_id": x.split("\n")[0], "reason": "r"} for x in prompt.split("### ")[1:]]})

        return call

    return make


def judges(folder, dies=None):
    s = lambda which: RemoteScreener(model(folder, dies if which == 1 else None), partitions=1, threads=1, network_retries=0, model=f"m{which}")
    return {"llm1": s(1), "llm2": s(2), "llm3": s(3)}


def test_killed_run_goes_on_target_by_target(spark, tmp_path):
    log, work = str(tmp_path / "calls"), str(tmp_path / "work")
    os.mkdir(log)
    f = targets(spark, 20)
    with pytest.raises(Exception, match="killed"):
        job.run(spark, f, THEMES, judges(log, "target 1 file 1"), work, wave_targets=10)
    commits = Commits(spark, f"{work}/commits")
    before = {r.target: r for r in commits.current().collect()}
    done = {t for t, r in before.items() if r.is_completed}
    n = calls(log)
    assert 0 < len(done) < 20 and "killed" in before["T01"].error and not before["T01"].is_completed
    told = []
    out = job.run(spark, f, THEMES, judges(log), work, wave_targets=10, tell=lambda kind, what: told.append((kind, what)))
    assert told[0] == ("targets", {"reused": len(done), "to_do": 20 - len(done)})
    after = {r.target: r for r in commits.current().collect()}
    assert all(after[t].version == before[t].version for t in done) and all(r.is_completed for r in after.values())
    # each batch and pair was asked for once by either judge, in both runs together
    assert calls(log) == 20 * 3 * 2 * 2 and n < calls(log)
    assert out.records.count() == 120 and {r.final_record_count for r in out.summary.collect()} == {6}

    # one changed text: one target, and of its batches only those of the changed file
    n = calls(log)
    out = job.run(spark, targets(spark, 20, {(2, 1)}), THEMES, judges(log), work)
    packs = sorted(os.listdir(f"{work}/packs"))
    assert [spark.read.parquet(f"{work}/packs/{p}").count() for p in packs][-1] == 1 and calls(log) - n == 4
    now = {r.target: r.version for r in commits.current().collect()}
    assert {t for t in now if now[t] != after[t].version} == {"T02"}
    assert out.records.count() == 120 and out.records.where("original_text like 'new %'").count() == 2

    # forced: all of the named target's requests are asked anew, of no other's
    n = calls(log)
    out = job.run(spark, targets(spark, 20, {(2, 1)}), THEMES, judges(log), work, force={"T05"})
    assert calls(log) - n == 3 * 2 * 2 and out.records.count() == 120


def test_no_fragments(spark, tmp_path):
    out = job.run(spark, targets(spark, 1).where("false"), THEMES, judges(str(tmp_path)), str(tmp_path / "work"))
    assert out.records is None and out.review is None and out.summary.count() == 0


def test_a_change_before_a_run_keeps_its_mark(spark):
    f = targets(spark, 1)
    more = f.unionByName(spark.createDataFrame([("T00", -5, "x", "file9", "dir", "first")], SCHEMA)).withColumn("ord", F.col("ord") + 100)
    marks = lambda d: {(r.source_file, r.occurrence): r.run_mark for r in job.run_marks(job.file_runs(d)).collect()}
    a, b = marks(f), marks(more)
    assert len(a) == 3 and len(b) == 4 and all(b[k] == v for k, v in a.items())


def test_killed_tasks_answers_are_not_asked_again(spark, tmp_path):
    folder, calls_at = str(tmp_path / "log"), str(tmp_path / "calls")
    os.mkdir(calls_at)
    todo = spark.range(30).select(F.format_string("k%02d", "id").alias("key"), F.concat(F.lit("p"), "id").alias("prompt"))

    def make(dies):
        def client():
            def call(prompt, key):
                if dies and sum(1 for f in os.listdir(calls_at) for _ in open(f"{calls_at}/{f}")) >= 11:
                    os._exit(9)
                with open(f"{calls_at}/{os.getpid()}", "a") as f:
                    f.write(prompt + "\n")
                return Reply("{}", {"total_tokens": 12}, "m-1", "prov")

            return call

        return client

    log = ResponseLog(spark, folder)
    with pytest.raises(Exception):
        log.ask(RemoteScreener(make(True), partitions=1, threads=1), todo, "coarse", "llm1", "m")
    seen = [x for f in os.listdir(calls_at) for x in open(f"{calls_at}/{f}").read().split()]
    assert len(seen) == 11
    # a line that the kill cut off counts for nothing
    (cut,) = [os.path.join(d, f) for d, _, fs in os.walk(f"{folder}-journal") for f in fs if f.endswith(".jsonl")]
    open(cut, "a").write('{"key": "k29", "asked": "x", "sta')
    got = log.ask(RemoteScreener(make(False), partitions=2), todo, "coarse", "llm1", "m").collect()
    every = [x for f in os.listdir(calls_at) for x in open(f"{calls_at}/{f}").read().split()]
    assert len(got) == 30 and len(every) == 30 == len(set(every)) and not os.path.exists(f"{folder}-journal/coarse-llm1-m/0")
    assert {(r.model, r.provider, json.loads(r.usage)["total_tokens"], r.status) for r in got} == {("m-1", "prov", 12, "ok")}


class Limited(BaseHTTPRequestHandler):
    """Answers each prompt with what its name says: 429 or 503 twice, then 200."""

    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt, key = body["messages"][0]["content"], self.headers["Authorization"][7:]
        before = sum(p == prompt for p, _ in Limited.seen)
        Limited.seen.append((prompt, key))
        code = int(prompt) if before < 2 else 200
        out = json.dumps({"model": "served", "choices": [{"message": {"content": '{"a": 1}'}}], "usage": {"total_tokens": 7}}).encode()
        self.send_response(code)
        if code == 429:
            self.send_header("Retry-After", "0.2")
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *a):
        pass


def test_busy_services_are_asked_again_with_the_next_key(spark):
    server = HTTPServer(("127.0.0.1", 0), Limited)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        todo = spark.createDataFrame([("a", "429"), ("b", "503"), ("c", "401")], "key string, prompt string")
        s = RemoteScreener(lambda: ChatClient(url, "m", 10), api_keys=("k1", "k2"), partitions=1, threads=1, network_retries=3)
        got = {r.key: r for r in s.screen(todo).collect()}
    finally:
        server.shutdown()
        server.server_close()
    assert (got["a"].status, got["b"].status, got["c"].status) == ("ok", "ok", "error") and "HTTP 401" in got["c"].error
    keys = lambda p: [k for q, k in Limited.seen if q == p]
    assert len(keys("429")) == 3 and len(keys("503")) == 3 and len(keys("401")) == 1 and set(keys("429")) == {"k1", "k2"}
    assert got["a"].model == "served" and json.loads(got["a"].usage) == {"total_tokens": 7}
    assert s.name == f"m@{url}" and RemoteScreener(lambda: ChatClient(url, "other", 10)).name != s.name


def test_exhausted_retries_are_errors(spark):
    def busy(prompt, key):
        raise Busy("HTTP 429", 0.0)

    (r,) = RemoteScreener(lambda: busy, partitions=1, network_retries=2).screen(spark.createDataFrame([("a", "p")], "key string, prompt string")).collect()
    assert r.status == "error" and r.error == "request: HTTP 429"


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def test_pace():
    c = Clock()
    p = Pace(requests=60, shares=2, clock=c, sleep=c.sleep)
    assert [p.take(("a",), 0) for _ in range(30)] == ["a"] * 30 and c.now == 0  # a minute's share at once
    p.take(("a",), 0)
    assert c.now == pytest.approx(2.0)  # then one every two seconds
    assert p.take(("a", "b"), 0) == "b" and c.now == pytest.approx(2.0)
    c = Clock()
    p = Pace(tokens=600, clock=c, sleep=c.sleep)
    p.take(("a",), 0, 600)
    p.take(("a",), 0, 100)
    assert c.now == pytest.approx(10.0)
    p.take(("a",), 0, 10_000)  # above a whole bucket: when it is full
    assert c.now == pytest.approx(70.0)
    c = Clock()
    p = Pace(clock=c, sleep=c.sleep)
    p.block("a", 5.0)
    assert [p.take(("a", "b"), 0), p.take(("a", "b"), 1)] == ["b", "b"] and p.take(("a",), 0) == "a" and c.now == pytest.approx(5.0)


def test_retry_after():
    assert seconds_of("3", 0) == 3 and seconds_of(None, 0) is None and seconds_of(" ", 0) is None and seconds_of("soon", 0) is None
    assert seconds_of("Thu, 01 Jan 1970 00:01:00 GMT", 50) == 10 and seconds_of("Thu, 01 Jan 1970 00:01:00 GMT", 90) == 0


def test_answer_text():
    say = lambda c: {"choices": [{"message": {"content": c}}]}
    assert answer_text(say("x")) == "x" and answer_text(say([{"text": "a"}, "odd", {"text": None}, {"text": "b"}])) == "ab"
    assert answer_text(say(None)) == answer_text({"choices": [{}]}) == ""
