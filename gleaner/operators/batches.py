"""Greedy batches: fragments in order, a new batch when the next would pass the limit or the work changes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..jobs.state import lean_shuffles, scratch_dir

LIMIT = 500


def greedy(lengths: Iterable[int], limit: int) -> list[int]:
    """The batch, from 0, of each length; a length above the limit is a batch of its own."""
    n = np.fromiter(lengths, np.int64)
    return (np.cumsum(starts(n, np.full(len(n), len(n)), limit)) - 1).tolist()


def following(n: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """Where the next batch begins if one begins at each place; end: where the place's run ends."""
    filled = np.cumsum(np.maximum(n, 1))
    before = filled - np.maximum(n, 1)
    return np.maximum(np.minimum(np.searchsorted(filled, before + limit, "right"), end), np.arange(1, len(n) + 1))


def starts(n: np.ndarray, end: np.ndarray, limit: int, first: int = 0) -> np.ndarray:
    """Whether a batch begins at each place, if the first one does at `first`."""
    jump, out, at = following(n, end, limit).tolist(), np.zeros(len(n), bool), first
    while at < len(n):
        out[at] = True
        at = jump[at]
    return out


def transitions(n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths that go on a run of which a batch is filled by 0, 1, ..., limit: where the first new batch begins, how many
    begin, and how full the last one is (limit: full, which a run that begins here is like).
    """
    size, n = len(n), np.maximum(n, 1)
    filled = np.cumsum(n)
    jump = following(n, np.full(size, size), limit).tolist()
    depth, last = [0] * (size + 1), [size] * (size + 1)
    for i in range(size - 1, -1, -1):
        depth[i] = depth[jump[i]] + 1
        last[i] = i if jump[i] == size else last[jump[i]]
    entry = np.arange(limit + 1)
    first = np.searchsorted(filled, limit - entry, "right")
    final = np.array(last)[first]
    rest = filled[-1] - np.append(0, filled)[np.minimum(final, size)]
    return first, np.array(depth)[first], np.minimum(np.where(first == size, entry + filled[-1], rest), limit)


def batch_numbers(lengths: Column, limit: int = LIMIT) -> Column:
    """Batch numbers, from 0, for an array of lengths in one row. Only the lengths go to Python, all rows of a task's batch at once."""

    @F.pandas_udf("array<int>")
    def number(rows: pd.Series) -> pd.Series:
        sizes = rows.map(lambda r: 0 if r is None else len(r)).to_numpy(np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *(r for r in rows if r is not None and len(r))]).astype(np.int64)
        ends = np.cumsum(sizes)
        number = np.cumsum(starts(flat, np.repeat(ends, sizes), limit))
        return pd.Series([(number[e - k : e] - number[e - k]).astype(np.int32) if k else [] for k, e in zip(sizes.tolist(), ends.tolist())])

    return number(lengths)


def batch_count(lengths: Column, limit: int = LIMIT) -> Column:
    """How many batches an array of lengths makes."""

    def add(a: Column, n: Column) -> Column:
        n = F.greatest(F.coalesce(n.cast("bigint"), F.lit(0)), F.lit(1).cast("bigint"))
        new = (a["k"] == 0) | (a["filled"] + n > limit)
        return F.struct((a["k"] + new.cast("bigint")).alias("k"), F.when(new, n).otherwise(a["filled"] + n).alias("filled"))

    zero = F.lit(0).cast("bigint")
    return F.aggregate(lengths, F.struct(zero.alias("k"), zero.alias("filled")), add, lambda a: a["k"])


def _joined(batches: Iterator[pa.RecordBatch]) -> tuple[list[int], dict[str, np.ndarray]] | None:
    """A task's rows as arrays: sizes of its batches, and the columns _t, _k (target, run; as hashes) and _n."""
    sizes, parts = [], []
    for b in batches:
        if b.num_rows:
            sizes.append(b.num_rows)
            parts.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("_t", "_k", "_n")])
    return (sizes, dict(zip(("t", "k", "n"), map(np.concatenate, zip(*parts))))) if parts else None


def _run_ends(t: np.ndarray, k: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
    edge = np.append(edge, len(t))
    return np.repeat(edge, np.diff(np.append(0, edge)))


def assign_batches(
    fragments: DataFrame, target: str = "target", order: str = "ord", same: tuple[str, ...] = ("source_file", "repo_dir"), length: str = "n", limit: int = LIMIT, keep: tuple[str, ...] | None = None, parts: int | None = None
) -> DataFrame:
    """fragments with batch_ord, from 1 within the target. order: a whole number, unique in a target.

    Lengths are sorted into ranges of (target, order), whatever run they belong to, so a run of any length spreads over
    tasks. A task can't know how full the batch is that the range before leaves open; so it first says for every filling, 0 to
    limit, what its first run would make of it (`transitions`). These answers, one for each range, are put together in order
    on the driver; then all ranges are numbered at once. keep: columns that go along; by default the others are joined again.
    """
    along = keep if keep is not None else ()
    key = (F.xxhash64(target).alias("_t"), F.xxhash64(F.lit(0), *same).alias("_k"), F.coalesce(F.col(length).cast("bigint"), F.lit(0)).alias("_n"))
    names = [target, order, *along]
    rows = fragments.select(*names, *key)
    ranged = (rows.repartitionByRange(parts, target, order) if parts else rows.repartitionByRange(target, order)).sortWithinPartitions(target, order)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int64))], [*b.schema.names, "_part"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    path = scratch_dir(fragments.sparkSession)
    with lean_shuffles(fragments.sparkSession):
        ranged.mapInArrow(place, f"{schema}, _part long").write.parquet(path)
    saved = fragments.sparkSession.read.parquet(path)

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(part: int, own: list[pa.RecordBatch]) -> dict:
            _, d = _joined(iter(own))
            t, k, n = d["t"], d["k"], d["n"]
            end = _run_ends(t, k)
            _, opened, left = transitions(n[: end[0]], limit)
            begins = starts(n, end, limit, int(end[0]))  # of the runs after the first
            tail = int(np.flatnonzero(begins)[-1]) if end[0] < len(n) else 0
            return {
                "part": part, "t0": int(t[0]), "k0": int(k[0]), "t1": int(t[-1]), "k1": int(k[-1]), "one": bool(end[0] == len(n)),
                "opened": opened.tolist(), "left": left.tolist(), "more": int(begins[t == t[0]].sum()), "last": int(begins[t == t[-1]].sum()), "fill": int(min(np.maximum(n[tail:], 1).sum(), limit)),
            }

        for part, own in _parts(batches):
            yield pa.RecordBatch.from_pylist([one(part, own)], schema=_SAID)

    sorted_ = saved.repartition("_part").sortWithinPartitions("_part", target, order)
    said = sorted_.select("_part", "_t", "_k", "_n").mapInArrow(say, "part long, t0 long, k0 long, t1 long, k1 long, one boolean, opened array<long>, left array<long>, more long, last long, fill long")
    entries, state = {}, None  # state: target, run, filling of its open batch, batches of the target
    for r in said.orderBy("part").toLocalIterator():
        runs_on = state is not None and state[:2] == (r.t0, r.k0)
        fill, base = state[2] if runs_on else limit, state[3] if state is not None and state[0] == r.t0 else 0
        entries[r.part] = (fill, base)
        count = base + r.opened[fill]
        if r.one:
            state = (r.t1, r.k1, r.left[fill], count)
        else:
            state = (r.t1, r.k1, r.fill, count + r.more if r.t0 == r.t1 else r.last)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _parts(batches):
            sizes, d = _joined(iter(own))
            t, n = d["t"], d["n"]
            end = _run_ends(t, d["k"])
            fill, base = entries[part]
            begins = starts(n, end, limit, int(min(np.searchsorted(np.cumsum(np.maximum(n[: end[0]], 1)), limit - fill, "right"), end[0])))
            total = np.cumsum(begins)
            new = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            number = total - np.repeat(total[new] - begins[new], np.diff(np.append(new, len(t)))) + np.where(t == t[0], base, 0)
            at = 0
            for b in own:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(number[at : at + b.num_rows])], [*names, "batch_ord"])
                at += b.num_rows

    kinds = dict(rows.dtypes)
    numbered = sorted_.select("_part", *names, "_t", "_k", "_n").mapInArrow(number, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", batch_ord long")
    return numbered if keep is not None else fragments.join(numbered, [target, order])


_SAID = pa.schema([(c, pa.int64()) for c in ("part", "t0", "k0", "t1", "k1")] + [("one", pa.bool_()), ("opened", pa.list_(pa.int64())), ("left", pa.list_(pa.int64()))] + [(c, pa.int64()) for c in ("more", "last", "fill")])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The record batches of each range in a sorted stream."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        p = b.column("_part").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
        for i, j in zip(cut, cut[1:]):
            if held and p[i] != now:
                yield now, held
                held = []
            now = int(p[i])
            held.append(b.slice(i, j - i))
    if held:
        yield now, held


def batch_rows(assigned: DataFrame, by: list[str], order: str, batch: str = "batch_ord", length: str = "n") -> DataFrame:
    """One row for each batch: id, ids of its pieces in order, text, char_count, pieces with their texts. A batch is bounded by the limit."""
    one = F.array_sort(F.collect_list(F.struct(order, "piece_id", "original_text")))
    out = assigned.groupBy(*by, batch).agg(one.alias("_p"), F.sum(length).cast("bigint").alias("char_count"))
    return out.select(
        *by, batch, F.format_string("batch_%06d", F.col(batch)).alias("batch_id"), F.transform("_p", lambda x: x["piece_id"]).alias("piece_ids"),
        F.array_join(F.transform("_p", lambda x: x["original_text"]), "\n\n").alias("batch_text"), "char_count",
        F.transform("_p", lambda x: F.struct(x["piece_id"].alias("piece_id"), x["original_text"].alias("original_text"))).alias("pieces"),
    )
