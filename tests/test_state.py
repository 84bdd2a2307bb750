import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from gleaner.jobs.log import ResponseLog, fingerprint
from gleaner.operators import progress, screening, workspace
from gleaner.operators.progress import Progress, ProgressError, reconcile, step
from gleaner.sinks import corpus_yaml
from gleaner.sources import control, corpus, records

TARGETS = ("KR3j", "KR3j0160")


def test_progress():
    p = step(Progress(targets=TARGETS), "start", "KR3j")
    assert (p.status, p.run_count, p.pending) == ("running", 1, ("KR3j0160",))
    p = step(p, "checkpoint", cursor="c", piece="p", delta=3)
    assert (p.piece_count, p.cursor, p.last_piece) == (3, "c", "p")
    p = step(p, "complete")
    assert (p.status, p.pending, p.current) == ("paused", ("KR3j0160",), "")
    assert step(step(p, "start"), "complete").status == "completed"
    assert step(p, "reset", note=" n ") == Progress(note="n")
    assert step(step(p, "start"), "pause").status == "paused"


@pytest.mark.parametrize("p, action, more", [(Progress(), "start", {}), (Progress(targets=TARGETS), "start", {"target": "KR9"}), (Progress(targets=TARGETS), "checkpoint", {}), (Progress(targets=TARGETS), "pause", {"delta": -1}), (Progress(targets=TARGETS, completed=TARGETS), "start", {}), (Progress(targets=TARGETS), "jump", {})])
def test_progress_refuses(p, action, more):
    with pytest.raises(ProgressError):
        step(p, action, **more)


def test_reconcile():
    p = Progress("running", ("KR3j", "gone"), "gone", targets=TARGETS)
    assert reconcile(p, TARGETS) == Progress("running", ("KR3j",))
    assert reconcile(p, ("KR3j",)).status == "completed"
    assert reconcile(Progress("odd", cursor="c"), TARGETS).status == "paused"
    assert reconcile(Progress("odd"), TARGETS).status == "pending"


def test_replay_equals_steps(spark):
    rows = [(k, i, a, t, 1) for k in (1, 2, 3) for i, (a, t) in enumerate([("start", ""), ("checkpoint", ""), ("jump", ""), ("complete", ""), ("start", "KR3j" if k == 2 else ""), ("complete", "")])]
    df = spark.createDataFrame(rows, "project bigint, seq int, action string, target string, delta int")
    for r in progress.replay(df.repartition(2), TARGETS).collect():
        p, errors = Progress(targets=TARGETS), 0
        for _, _, a, t, d in [x for x in rows if x[0] == r.project]:
            try:
                p = step(p, a, t, delta=d)
            except ProgressError:
                errors += 1
        assert (r.status, r.n_completed, r.run_count, r.piece_count, r.errors) == (p.status, len(p.completed), p.run_count, p.piece_count, errors)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_replay_of_a_long_log_in_ranges(spark, parts):
    """One project with most of the log, dealt to many ranges, equals single steps; every field, resets included."""
    import random

    r, rows = random.Random(parts), []
    for k, n in ((1, 6), (2, 150), (3, 5), (4, 3), (9, 40)):
        for i in range(n):
            action = r.choice(["start", "start", "checkpoint", "pause", "complete", "jump"] + ["reset"] * (r.random() < 0.2))
            rows.append((k, i * 2, action, r.choice(["", "", "KR3j", "KR3j0160", "KR1a", "KR9"]), r.choice([0, 1, 5, -1]), r.choice([None, f"c{i}"]), r.choice([None, f"p{i}", ""]), r.choice([None, None, f" n{i} "])))
    shuffled = list(rows)
    r.shuffle(shuffled)
    df, targets = spark.createDataFrame(shuffled, "project bigint, seq int, action string, target string, delta int, cursor string, piece string, note string"), ("KR3j", "KR3j0160", "KR1a")
    got = {x.project: x for x in progress.replay(df, targets, parts).collect()}
    assert len(got) == 5 and progress.replay(df.where("false"), targets, parts).count() == 0
    for k, x in got.items():
        p, errors = Progress(targets=targets), 0
        for _, _, a, t, d, c, piece, note in (y for y in rows if y[0] == k):
            try:
                p = step(p, a, t, c, piece, note, d)
            except ProgressError:
                errors += 1
        assert tuple(x) == (k, p.status, p.current, len(p.completed), p.cursor, p.last_piece, p.note, p.run_count, p.piece_count, errors)


def test_replay_of_many_targets(spark):
    targets = tuple(f"T{i}" for i in range(12))
    rows = [(1, i, a, "", 1) for i, a in enumerate(["start", "complete"] * 12)]
    (x,) = progress.replay(spark.createDataFrame(rows, "project bigint, seq int, action string, target string, delta int"), targets).collect()
    assert (x.status, x.n_completed, x.run_count, x.piece_count) == ("completed", 12, 12, 24)


def requests(spark, n):
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("p"), "id").alias("prompt"))


def counting(folder, fail=()):
    def make():
        def call(prompt, name):
            with open(f"{folder}/{os.getpid()}-{threading.get_ident()}", "a") as f:
                f.write(f"{prompt} {name}\n")
            if prompt in fail:
                raise OSError("down")
            return json.dumps({"p": prompt})

        return call

    return make


def calls(folder):
    return sorted(x for f in os.listdir(folder) for x in open(f"{folder}/{f}").read().splitlines())


def test_resume_makes_no_call_twice(spark, tmp_path):
    os.mkdir(tmp_path / "calls")
    log = ResponseLog(spark, str(tmp_path / "log"))
    mark = fingerprint(themes=["a"])
    bad = screening.RemoteScreener(counting(tmp_path / "calls", fail={"p3"}), api_keys=("key-a", "key-b"), partitions=2, network_retries=0)
    first = log.ask(bad, requests(spark, 5), "coarse", "llm1", mark, 0)
    assert {r.key for r in first.collect()} == {"k0", "k1", "k2", "k4"}
    good = screening.RemoteScreener(counting(tmp_path / "calls"), partitions=2)
    assert log.ask(good, requests(spark, 5), "coarse", "llm1", mark, 1).count() == 5
    n = len(calls(tmp_path / "calls"))
    assert n == 6 and log.ask(good, requests(spark, 5), "coarse", "llm1", mark, 2).count() == 5 and len(calls(tmp_path / "calls")) == n
    assert log.pending(requests(spark, 5), "coarse", "llm1", fingerprint(themes=["b"])).count() == 5
    assert {c.split()[1] for c in calls(tmp_path / "calls")} >= {"key-a", "key-b"}


def test_fallback_and_manual(spark):
    s = screening.RemoteScreener(lambda: lambda p, k: "not json" if p != "p0" else "{}", make_fallback=lambda: lambda p, k: "{}" if p == "p1" else "no", partitions=1, retries=2)
    got = {r.key: (r.status, r.attempts) for r in s.screen(requests(spark, 3)).collect()}
    assert got == {"k0": ("ok", 1), "k1": ("fallback", 2), "k2": ("manual", 3)}
    s = screening.RemoteScreener(lambda: lambda p, k: "no", partitions=1)
    assert {r.status for r in s.screen(requests(spark, 2)).collect()} == {"format_error"}


def test_manual_answers_count_as_relevant(spark):
    df = spark.createDataFrame([(1, "manual", [("a", False), ("b", False)]), (2, "ok", [("a", True), ("b", False)])], "d int, status string, themes array<struct<theme:string,is_relevant:boolean>>")
    assert {tuple(r) for r in screening.coarse_positives(df, ["d"]).collect()} == {(1, "a"), (1, "b"), (2, "a")}


def test_tree(spark, tmp_path):
    for name, data in (("KR4c0001/KR4c0001_001.txt", "#+TITLE: 测试唐诗\r\n<pb:KR4c0001_000-1a>\n冬雷".encode() + b"\xff\n"), ("KR4c0001/notes.md", b"x"), ("KR4c0002/sub/a.txt", b"deep"), ("KR-Catalog/KR/KR1.txt", b""), ("other/a.txt", b"x")):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    dirs = corpus.scope_dirs(spark, str(tmp_path))
    assert sorted(r[0] for r in dirs.collect()) == ["KR4c0001", "KR4c0002"]
    assert corpus.scope_dirs(spark, str(tmp_path / "none")).count() == 0
    targets = spark.createDataFrame([("KR4c", ["KR4c0001"])], "token string, repo_dirs array<string>")
    (r,) = corpus.page_marked_tree(spark, str(tmp_path), targets).collect()
    assert (r.source_file, r.text_file, r.fallback_piece_id) == ("测试唐诗", "KR4c0001_001.txt", "KR4c0001_001_fallback_0001")
    assert r.raw_text == "#+TITLE: 测试唐诗\n<pb:KR4c0001_000-1a>\n冬雷\n"


def test_catalog(spark):
    files = spark.createDataFrame([(1, "* KR1 經部\n** [[file:KR1a.txt][易類]]\nx\n** [[file:KR1b.txt][書類]]"), (2, "** [[file:KR1a.txt][again]]\n** [[file:KR2a.txt][史]]")], "file_no int, text string")
    e = corpus.catalog_entries(files)
    assert {(r.code, r.section, r.label) for r in e.collect()} == {("KR1a", "經部", "易類"), ("KR1b", "經部", "書類"), ("KR2a", "KR2", "史")}
    dirs = spark.createDataFrame([("KR3j0160",)], "repo_dir string")
    assert "經部 [易類]" in {r.display_label for r in corpus.scope_options(e, dirs).collect()}
    assert [(r.code, r.section) for r in corpus.scope_options(e.where("false"), dirs).collect()] == [("KR3j", "未分类")]


@pytest.mark.parametrize("text, want", [('{"records": [{"a": 1}, {"a": 2}]}', {1, 2}), ('[{"a": 3}]', {3}), ('{"a": 4}', {4}), ('{"a": 5}\nbad\n{"a": 6}', {5, 6}), ("", set()), ("bad", set())])
def test_record_shapes(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert {r.a for r in records.parse_records(df, "struct<a:int>").collect()} == want


def test_control_files():
    assert control.front_matter('---\na: "x"\nthemes:\n- 甲\n- "乙"\nb: 2\n---\nc: 3') == {"a": "x", "themes": ["甲", "乙"], "b": "2"}
    assert control.front_matter("a: 1") == {}
    assert control.first_sentence("---\na: 1\n---\n# h\n\nbody\n") == "body"
    assert control.theme_names('["a", "b", "a"]') == ["a", "b"] and control.theme_names("one") == ["one"]
    assert control.key_pool("key-a,key-b,key-a", "legacy-key") == ("key-a", "key-b", "legacy-key")
    assert control.base_url("https://x/v1/chat/completions/") == "https://x/v1"
    s = control.Slot("llm1", "m", ("secret", "b"))
    assert s.workers == 140 and "secret" not in repr(s)
    assert control.duration(90) == "1分30秒" and control.duration(0) == "0秒"


def test_workspace(spark):
    required = spark.createDataFrame([(s, p) for s, p in workspace.REQUIRED], "stage int, path string")
    paths = [p for s, p in workspace.REQUIRED if s < 3] + ["3a_deepened_thinking.md"]
    every = [p + "core.pdf" if p.endswith("/") else p for _, p in workspace.REQUIRED]
    present = spark.createDataFrame([("half", p) for p in paths] + [("full", p) for p in every], "project string, path string")
    status = workspace.stage_status(required, present)
    assert {r.status for r in status.where("project = 'half' and stage = 3").collect()} == {"partial"}
    got = {r.project: (r.highest_completed_stage, r.next_stage) for r in workspace.next_stage(status).collect()}
    assert got == {"half": (2, 3), "full": (6, None)}


def test_yaml(spark, tmp_path):
    df = spark.createDataFrame([("p/1", "t", "two\nlines", 'say "x"', None), ("p2", "u v", "", "a\\b", None)], "piece_id string, matched_theme string, original_text string, note string, none string")
    fields = ["piece_id", "matched_theme", "original_text", "note", "none"]
    got = {r.piece_id: r.yaml for r in corpus_yaml.record_yaml(df, fields).collect()}
    assert got["p/1"] == '  - piece_id: p/1\n    matched_theme: t\n    original_text: |\n      two\n      lines\n    note: "say \\"x\\""\n    none: ""'
    assert got["p2"].endswith('original_text: ""\n    note: "a\\\\b"\n    none: ""')
    full = df.withColumns({"source_file": F.lit("s"), "needs_manual_review": F.lit(False), "manual_review_reason": F.lit("")})
    corpus_yaml.write_corpus(full, str(tmp_path / "yaml"))
    text = "".join(open(tmp_path / "yaml" / f).read() for f in sorted(os.listdir(tmp_path / "yaml")) if f.startswith("part"))
    assert text.startswith("piece_count: 2\nrecords:\n  - piece_id: p/1") and text.count("  - piece_id") == 2


def test_pause_follows_the_scope():
    """Pausing neither opens an untouched project nor keeps a target that is done."""
    p = Progress(targets=TARGETS)
    assert step(p, "pause").status == "pending"
    p = step(step(p, "start", "KR3j"), "complete")
    assert (step(p, "pause", "KR3j").current, step(p, "pause", "KR3j").status) == ("", "paused")
    p = step(step(p, "start"), "complete")
    assert p.status == step(p, "pause").status == "completed"


def plain_step(s, targets, action, target, delta):
    """The rules over a plain dictionary; None where an action is refused."""
    known = [t for t in s["completed"] if t in targets]
    if delta < 0 or (target and target not in targets) or action not in ("start", "checkpoint", "pause", "complete", "reset"):
        return None
    if action == "reset":
        return {"status": "pending", "completed": [], "current": "", "runs": 0, "pieces": 0}
    open_ = [t for t in targets if t not in known and t != s["current"]]
    chosen = target or s["current"] or (open_[0] if open_ and action == "start" else "")
    new = dict(s, completed=list(known), pieces=s["pieces"] + delta)
    if action in ("start", "checkpoint"):
        if not chosen or chosen in known:
            return None
        new["runs"] += action == "start" and chosen != s["current"]
        new["status"], new["current"] = "running", chosen
    elif action == "pause":
        new["status"], new["current"] = "paused", chosen
    else:
        if not chosen:
            return None
        new["completed"] += [] if chosen in known else [chosen]
        new["status"], new["current"] = "paused", ""
    if new["current"] in new["completed"]:
        new["current"] = ""
    if len(new["completed"]) == len(targets):
        new["status"] = "completed"
    elif new["current"]:
        new["status"] = "paused" if new["status"] == "paused" else "running"
    elif not new["completed"]:
        new["status"] = "pending"
    return new


def test_steps_on_random_logs():
    import random

    r, targets = random.Random(4), ("A", "B", "C")
    for _ in range(400):
        p, s = Progress(targets=targets), {"status": "pending", "completed": [], "current": "", "runs": 0, "pieces": 0}
        for _ in range(r.randrange(1, 15)):
            action, target, delta = r.choice(["start", "checkpoint", "pause", "complete", "complete", "reset", "jump"]), r.choice(["", "", "A", "B", "C", "Z"]), r.choice([0, 2, -1])
            want = plain_step(s, targets, action, target, delta)
            try:
                p = step(p, action, target, delta=delta)
                assert want is not None
                s = want
            except ProgressError:
                assert want is None
            assert (p.status, list(p.completed), p.current, p.run_count, p.piece_count) == (s["status"], s["completed"], s["current"], s["runs"], s["pieces"])


def test_manifest(spark, tmp_path):
    from gleaner.jobs import manifest

    path = str(tmp_path / "manifest.json")
    assert manifest.read_manifest(spark, path) == {}
    json.dump({"analysis_targets": ["kr3J", "KR3j", "", "KR3j0160"], "status": " ", "last_run_note": "  ", "last_run_at": "x", "other": 1, "retrieval_progress": {"completed_targets": ["KR3J", "gone"], "current_target": "KR3j", "run_count": "-2", "completed_piece_count": "7"}}, open(path, "w"))
    m = manifest.read_manifest(spark, path)
    assert m["analysis_targets"] == ["KR3j", "KR3j0160"] and m["status"] == "configured" and m["stage2_manifest_version"] == 2 and m["other"] == 1 and m["last_run_at"] == "x" and "last_run_note" not in m
    p = m["retrieval_progress"]
    assert (p["status"], p["completed_targets"], p["pending_targets"], p["current_target"], p["run_count"], p["completed_piece_count"]) == ("paused", ["KR3j"], ["KR3j0160"], "", 0, 7)
    m = manifest.advance(spark, path, "start", target="kr3j0160", note=" go ")
    assert (m["retrieval_progress"]["current_target"], m["retrieval_progress"]["run_count"], m["retrieval_progress"]["notes"], m["retrieval_progress"]["status"]) == ("KR3j0160", 1, "go", "running")
    m = manifest.advance(spark, path, "complete", delta=3)
    assert m["retrieval_progress"]["status"] == "completed" and manifest.read_manifest(spark, path)["retrieval_progress"]["completed_piece_count"] == 10
    assert "retrieval_progress" not in manifest.normalized({"retrieval_progress": "odd", "analysis_targets": "odd"})


def test_projects(spark, tmp_path):
    root = tmp_path / "outputs"
    for f in ("a-project/1_journal_targeting.md", "a-project/1_research_proposal.md", "a-project/_stage3b/papers/x.pdf", ".hidden/y.md", "b/z.md"):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("t")
    assert workspace.project_names(spark, str(root)) == ["a-project", "b"] and workspace.project_names(spark, str(tmp_path / "none")) == []
    present = workspace.present_files(spark, str(root))
    assert sorted(map(tuple, present.collect())) == [("a-project", "1_journal_targeting.md"), ("a-project", "1_research_proposal.md"), ("a-project", "_stage3b/papers/x.pdf"), ("b", "z.md")]
    required = spark.createDataFrame(workspace.REQUIRED, "stage int, path string")
    got = {(r.project, r.stage): r.status for r in workspace.stage_status(required, present).collect()}
    assert got["a-project", 1] == "complete" and got["a-project", 3] == "partial" and got["b", 1] == "missing"
