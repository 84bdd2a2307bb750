"""The retrieval progress of a project: a state machine over actions, replayed from an action log.

`step` is one transition; `replay` folds whole logs, of many projects or of one, range by range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.state import scratch_dir


@dataclass(frozen=True)
class Progress:
    status: str = "pending"
    completed: tuple[str, ...] = ()
    current: str = ""
    cursor: str = ""
    last_piece: str = ""
    note: str = ""
    run_count: int = 0
    piece_count: int = 0
    targets: tuple[str, ...] = field(default=(), compare=False)

    @property
    def pending(self) -> tuple[str, ...]:
        return tuple(t for t in self.targets if t not in self.completed and t != self.current)


class ProgressError(ValueError):
    pass


def reconcile(p: Progress, targets: tuple[str, ...]) -> Progress:
    """p after a change of scope: what lies outside it goes, the status follows."""
    done = tuple(t for t in p.completed if t in targets)
    current = p.current if p.current in targets and p.current not in done else ""
    if targets and len(done) == len(targets):
        status = "completed"
    elif current:
        status = "paused" if p.status == "paused" else "running"
    elif done or p.cursor or p.last_piece:
        status = p.status if p.status in ("running", "paused") else "paused"
    else:
        status = "pending"
    return replace(p, completed=done, current=current, status=status, targets=targets)


def step(p: Progress, action: str, target: str = "", cursor: str | None = None, piece: str | None = None, note: str | None = None, delta: int = 0) -> Progress:
    if delta < 0:
        raise ProgressError("a negative number of pieces")
    if not p.targets and action != "reset":
        raise ProgressError("no targets")
    if target and target not in p.targets:
        raise ProgressError("target outside the scope")
    kept = {"cursor": cursor, "last_piece": piece, "note": note.strip() if note is not None else None}
    p = replace(p, **{k: v for k, v in kept.items() if v is not None})
    if action == "reset":
        return Progress(targets=p.targets, note=kept["note"] or "")
    p = replace(p, piece_count=p.piece_count + delta)
    if action == "start":
        open_ = p.pending
        chosen = target or p.current or (open_[0] if open_ else "")
        if not chosen or chosen in p.completed:
            raise ProgressError("nothing left to start")
        p = replace(p, current=chosen, run_count=p.run_count + (chosen != p.current), status="running")
    elif action == "checkpoint":
        chosen = target or p.current
        if not chosen or chosen in p.completed:
            raise ProgressError("no open target")
        p = replace(p, current=chosen, status="running")
    elif action == "pause":
        p = replace(p, current=target or p.current, status="paused")
    elif action == "complete":
        chosen = target or p.current
        if not chosen:
            raise ProgressError("no target")
        p = replace(p, completed=p.completed if chosen in p.completed else (*p.completed, chosen), current="", status="paused")
    else:
        raise ProgressError(f"unknown action {action}")
    # what an action leaves is what the scope makes of it: pausing can't open, close or keep a target
    return reconcile(p, p.targets)


ACTIONS = ("start", "checkpoint", "pause", "complete")
#: as many states of (completed, current) a summary may tell apart: 8 targets make 1280
MAX_STATES = 2000


class Rules:
    """What actions make of every state (completed, current), as arrays over the states. `step` is asked once for each."""

    def __init__(self, targets: tuple[str, ...]):
        self.targets, n = targets, len(targets)
        self.states = [(c, t) for c in range(1 << n) for t in (-1, *(i for i in range(n) if not c >> i & 1))]
        self.at = {x: i for i, x in enumerate(self.states)}
        self.ops: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for action in ACTIONS:
            for target in ("", *targets):
                self.ops[action, target] = self._table(action, target)

    @staticmethod
    def count(n: int) -> int:
        return (1 << n) + n * (1 << n >> 1)

    def index(self, p: Progress) -> int:
        return self.at[sum(1 << i for i, t in enumerate(self.targets) if t in p.completed), self.targets.index(p.current) if p.current else -1]

    def progress(self, state: int) -> Progress:
        c, t = self.states[state]
        return Progress("running", tuple(x for i, x in enumerate(self.targets) if c >> i & 1), "" if t < 0 else self.targets[t], targets=self.targets)

    def _table(self, action: str, target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(accepted, next state, whether a run begins) for each state."""
        ok, then, run = np.zeros(len(self.states), bool), np.arange(len(self.states)), np.zeros(len(self.states), np.int64)
        for i in range(len(self.states)):
            try:
                p = step(self.progress(i), action, target)
            except ProgressError:
                continue
            ok[i], then[i], run[i] = True, self.index(p), p.run_count
        return ok, then, run


_AFTER = {"start": 1, "checkpoint": 1, "pause": 2, "complete": 2}  # what is left of a status: 1 running, 2 paused, 0 as it was


class Summary:
    """What a stretch of a log makes of every state that it could begin in. Summaries of neighbours compose."""

    def __init__(self, rules: Rules):
        n = len(rules.states)
        self.rules, self.state = rules, np.arange(n)
        self.errors, self.runs, self.pieces, self.after = (np.zeros(n, np.int64) for _ in range(4))
        self.reset = False
        self.said = {c: [None] * n for c in ("cursor", "last_piece", "note")}

    def add(self, action: str, target: str, cursor: str | None, piece: str | None, note: str | None, delta: int) -> None:
        if delta < 0 or (target and target not in self.rules.targets) or (action != "reset" and (action, target) not in self.rules.ops) or (action != "reset" and not self.rules.targets):
            self.errors += 1
            return
        kept = {"cursor": cursor, "last_piece": piece, "note": note.strip() if note is not None else None}
        if action == "reset":
            self.state = np.full_like(self.state, self.rules.at[0, -1])
            self.runs, self.pieces, self.after = (np.zeros_like(self.runs) for _ in range(3))
            self.reset = True
            self.said = {c: [(kept["note"] or "") if c == "note" else ""] * len(self.state) for c in self.said}
            return
        ok, then, run = (x[self.state] for x in self.rules.ops[action, target])
        self.state, self.runs, self.pieces, self.errors = then, self.runs + run, self.pieces + ok * delta, self.errors + ~ok
        self.after = np.where(ok, _AFTER[action], self.after)
        for c, v in kept.items():
            if v is not None:
                self.said[c] = [v if yes else old for yes, old in zip(ok.tolist(), self.said[c])]

    def told(self) -> str:
        return json.dumps({"state": self.state.tolist(), "errors": self.errors.tolist(), "runs": self.runs.tolist(), "pieces": self.pieces.tolist(), "after": self.after.tolist(), "reset": self.reset, "said": self.said}, ensure_ascii=False)


def follow(rules: Rules, told: str, p: Progress, errors: int) -> tuple[Progress, int]:
    """The progress, and errors, after the stretch that a summary tells of, from p."""
    x, i = json.loads(told), rules.index(p)
    now = rules.progress(x["state"][i])
    status = {0: "pending" if x["reset"] else p.status, 1: "running", 2: "paused"}[x["after"][i]]
    base = Progress(targets=p.targets) if x["reset"] else p
    said = {c: v[i] if v[i] is not None else getattr(base, c) for c, v in x["said"].items()}
    out = replace(now, status=status, run_count=base.run_count + x["runs"][i], piece_count=base.piece_count + x["pieces"][i], **said)
    return reconcile(out, rules.targets), errors + x["errors"][i]


_ROW = "project long, status string, current string, n_completed long, cursor string, last_piece string, note string, run_count long, piece_count long, errors long"

_FOUND = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _ROW.split(", ")] + [("part", pa.int64()), ("summary", pa.string()), ("completed", pa.list_(pa.string())), ("last", pa.bool_())])


def _row(project, p: Progress, errors: int) -> dict:
    return {"project": project, "status": p.status, "current": p.current, "n_completed": len(p.completed), "cursor": p.cursor, "last_piece": p.last_piece, "note": p.note, "run_count": p.run_count, "piece_count": p.piece_count, "errors": errors}


def replay(actions: DataFrame, targets: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """(project, status, current, n_completed, cursor, last_piece, note, run_count, piece_count, errors) from actions.

    actions: project, seq, action, target, delta; cursor, piece and note where there are such columns (null: unchanged).
    A refused action changes nothing and counts as an error.

    The log is sorted into ranges, so one project with most of it spreads over tasks. A task folds the projects that begin in
    its range; what it holds of the one before, it tells as a `Summary`, for every state that one may be in. Summaries, one for
    each range, are followed in order on the driver. Above MAX_STATES states a project is one task's stream instead.
    """
    more = [F.col(c) if c in actions.columns else F.lit(None).cast("string").alias(c) for c in ("cursor", "piece", "note")]
    log = actions.select("project", "seq", "action", "target", "delta", *more)
    spark, few = actions.sparkSession, Rules.count(len(targets)) <= MAX_STATES
    if few:
        log = log.repartitionByRange(parts, "project", "seq") if parts else log.repartitionByRange("project", "seq")
    else:
        log = log.repartition("project")
    fields = [c.split()[0] for c in _ROW.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        rules = Rules(targets) if few else None
        now, p, errors, first = None, None, 0, None
        begun = False

        def closed(last: bool) -> dict:
            own = _row(now, p, errors) if first is None else {"project": now}
            # what may go on in the next range, or has come from the one before, is put together later
            return own | {"part": part if few and (last or first is not None) else -1, "summary": None if first is None else first.told(), "completed": [] if p is None else list(p.completed), "last": last}

        for b in batches:
            for project, action, target, delta, *kept in zip(*(b.column(c).to_pylist() for c in ("project", "action", "target", "delta", "cursor", "piece", "note"))):
                if not begun or project != now:
                    if begun:
                        out.append(closed(False))
                    first = Summary(rules) if few and not begun else None
                    now, p, errors, begun = project, None if first is not None else Progress(targets=targets), 0, True
                if first is not None:
                    first.add(action, target or "", *kept, int(delta))
                    continue
                try:
                    p = step(p, action, target or "", *kept, delta=int(delta))
                except ProgressError:
                    errors += 1
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND)
                out = []
        if begun:
            out.append(closed(True))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    found = log.sortWithinPartitions("project", "seq").mapInArrow(fold, f"{_ROW}, part long, summary string, completed array<string>, last boolean")
    if not few:
        return found.select(*fields)
    path = scratch_dir(spark)
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    rules, done, at, state = Rules(targets), [], None, None
    for r in found.where("part >= 0").orderBy("part", "last").toLocalIterator():  # two rows a range at most
        if r.summary is not None:
            if state is None or at != r.project:
                if state is not None:
                    done.append(_row(at, *state))
                at, state = r.project, (Progress(targets=targets), 0)
            state = follow(rules, r.summary, *state)
        else:
            if state is not None:
                done.append(_row(at, *state))
            at, state = r.project, (Progress(r.status, tuple(r.completed), r.current, r.cursor, r.last_piece, r.note, r.run_count, r.piece_count, targets), r.errors)
    if state is not None:
        done.append(_row(at, *state))
    whole = found.where("part < 0").select(*fields)
    return whole.unionByName(spark.createDataFrame([tuple(d[c] for c in fields) for d in done], _ROW)) if done else whole


