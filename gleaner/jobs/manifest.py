"""A project's manifest: a small JSON object with its targets and how far it has come. What it lacks or holds amiss is put right when it is read."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ..operators.progress import Progress, reconcile, step
from .state import read_json, write_json

# fixed values
VERSION, PROGRESS_VERSION = 2, 1
NEW = "configured"
TEXTS = ("last_run_note", "last_run_at", "updated_at")


def target_names(value: object) -> tuple[str, ...]:
    """Names of scopes, each once: "kr3J" is "KR3j"."""
    said = [str(x).strip() for x in value] if isinstance(value, (list, tuple)) else []
    return tuple(dict.fromkeys("KR" + s[2:].lower() if s[:2].lower() == "kr" and len(s) > 2 else s for s in said if s))


def _count(value: object) -> int:
    try:
        return max(0, int(value))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return 0


def read_progress(targets: tuple[str, ...], stored: dict) -> Progress:
    """The progress that an object tells of, as far as it lies within the targets."""
    said = lambda k: str(stored.get(k) or "")
    current = (*target_names([said("current_target")]), "")[0]
    p = Progress(said("status").strip().lower(), target_names(stored.get("completed_targets")), current, said("current_cursor"), said("last_piece_id"), said("notes"), _count(stored.get("run_count")), _count(stored.get("completed_piece_count")))
    return reconcile(p, targets)


def told(p: Progress, updated_at: str) -> dict:
    """A progress as it is stored."""
    return {
        "version": PROGRESS_VERSION, "status": p.status, "analysis_targets": list(p.targets), "total_targets": len(p.targets), "completed_targets": list(p.completed),
        "pending_targets": list(p.pending), "current_target": p.current, "current_cursor": p.cursor, "last_piece_id": p.last_piece,
        "completed_piece_count": p.piece_count, "run_count": p.run_count, "notes": p.note, "updated_at": updated_at,
    }


def normalized(found: dict) -> dict:
    """A manifest with its version, a status, targets each once, progress within them, and no blank notes or times."""
    targets, stored = target_names(found.get("analysis_targets")), found.get("retrieval_progress")
    out = {k: v for k, v in found.items() if k not in ("analysis_targets", "retrieval_progress", *TEXTS)}
    out |= {"stage2_manifest_version": VERSION, "status": str(found.get("status") or "").strip() or NEW}
    if targets:
        out["analysis_targets"] = list(targets)
    if targets or isinstance(stored, dict):
        stored = stored if isinstance(stored, dict) else {}
        out["retrieval_progress"] = told(read_progress(targets, stored), str(stored.get("updated_at") or ""))
    return out | {k: s for k in TEXTS if (s := str(found.get(k) or "").strip())}


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest, put right; empty where there is none."""
    found = read_json(spark, path)
    return normalized(found) if found else {}


def advance(spark: SparkSession, path: str, action: str, **how) -> dict:
    """Apply an action (`progress.step`) to a stored manifest."""
    m = read_manifest(spark, path)
    targets = tuple(m.get("analysis_targets") or ())
    if how.get("target"):
        how["target"] = target_names([how["target"]])[0]
    p = step(read_progress(targets, m.get("retrieval_progress") or {}), action, **how)
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    return write_json(spark, path, m | {"retrieval_progress": told(replace(p, targets=targets), now)})
