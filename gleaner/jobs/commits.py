"""The state of each target of a run, as a table of commits over immutable snapshots.

A commit is one file of JSON lines, a row for each target that it moves; versions count up. The last row of a target is its
state: phase, what it was made from (fingerprint), where its rows are (snapshot), counts, error. Writers compare and
swap: a commit fails if another one moved any of its targets after the version it builds on, and a version is written
once. So targets finish, fail and resume apart, and two runs can't both finish one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import last_wins
from .state import names, no_rows, put_new, read_text

SCHEMA = "version bigint, target string, phase string, is_completed boolean, fingerprint string, snapshot string, epoch int, counts map<string, bigint>, error string, updated_at timestamp"


class Conflict(RuntimeError):
    """Another run moved one of the targets meanwhile."""


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, version: int) -> str:
        return f"{self.path}/{version:020d}.json"

    def version(self) -> int:
        """The last version; -1 before the first."""
        return max((int(n[:-5]) for n in names(self.spark, self.path) if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def history(self) -> DataFrame:
        if self.version() < 0:
            return no_rows(self.spark, SCHEMA)
        return self.spark.read.schema(SCHEMA).option("pathGlobFilter", "*.json").json(self.path)

    def current(self) -> DataFrame:
        """The last row of each target."""
        return last_wins(self.history().select("*"), ["target"], ["version"])

    def commit(self, rows: Iterable[dict], since: int) -> int:
        """Write rows (target and columns of SCHEMA) as the next version; since: the version that the writer has read."""
        now = datetime.now(timezone.utc).isoformat(timespec="milliseconds")
        rows = [{"phase": "", "is_completed": False, "epoch": 0, "updated_at": now} | r for r in rows]
        mine = {r["target"] for r in rows}
        while True:
            head = self.version()
            for v in range(since + 1, head + 1):
                moved = mine & {json.loads(x)["target"] for x in read_text(self.spark, self._file(v)).splitlines()}
                if moved:
                    raise Conflict(f"version {v} moved {sorted(moved)[:5]}")
            text = "".join(json.dumps(r | {"version": head + 1}, ensure_ascii=False) + "\n" for r in rows)
            if put_new(self.spark, self._file(head + 1), text):
                return head + 1
            since = head  # someone was faster: what they moved decides


def expand_counts(current: DataFrame, counts: Iterable[str]) -> DataFrame:
    """(target, a column for each count, is_completed, updated_at); a count that a row lacks is 0."""
    return current.select("target", *(F.coalesce(F.try_element_at("counts", F.lit(c)), F.lit(0)).alias(c) for c in counts), "is_completed", "updated_at")
