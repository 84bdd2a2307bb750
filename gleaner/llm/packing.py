"""Best-fit packing with bounds: documents into as few sequences of at most `capacity` tokens as can be.

Documents are tokenized where they are read; from then on only pieces (lengths, checksums) move. Pieces go to
groups of about `group_rows` by a stored salt. A group is packed by best-fit decreasing and certified by
lower bounds from dual feasible functions. A group whose bins exceed its bound gives up the pieces of all bins
that aren't full, a certified one those of its emptiest bin (what rounding up cost it). What is given up
meets in new groups and is packed again, until one group has packed all that was left or a round needs as many
bins for it as before.

Only documents longer than the capacity are cut: the first piece takes the remainder, the others are full.
Null and empty texts are one end id. Repeated rows are packed each on its own; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .tokens import pieces_of
from .tokens import tokenizer as encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, salt long, sequence_id long, offset long, given_up boolean, group_bins long, group_bound long"


def lower_bound(lengths: np.ndarray, capacity: int, ks: int = 40) -> int:
    """The best of the bounds by dual feasible functions: large-item functions for each threshold, steps for each k."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    some, total = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(1, capacity // 2 + 1)
    # items over capacity - t fill a bin, items under t count nothing, the others count their length
    large = (some[-1] - some[capacity - t]) * capacity + total[capacity - t] - total[t - 1]
    best = max(-(-int(total[-1]) // capacity), int(-(-large.max() // capacity)) if len(t) else 0)
    for k in range(1, ks):
        exact = (k + 1) * x % capacity == 0
        value = np.where(exact, k * x, (k + 1) * x // capacity * capacity)  # k * capacity times the function
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each item's bin and its place there, and the number of bins."""
    bins, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, n = 0, 0  # bit r of `there`: a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = there >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                there &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        bins[i], place[i] = b, capacity - r
        if r > size:
            room[r - size].append(b)
            there |= 1 << (r - size)
    return bins, place, n


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece, with a salt that spreads rows evenly whatever they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            for b in pieces_of(batch, 1):
                ids, n = tok.encode(b.column(1))
                ids, n = np.insert(ids, np.cumsum(n), end_id).astype("<u4"), n + 1
                k = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                head = (n - (k - 1) * capacity)[doc]
                start = np.where(piece > 0, head + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head)
                at = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(at.tolist(), (at + length).tolist())]
                salt = (np.arange(seen, seen + len(doc), dtype=np.uint64) + np.uint64(part << 40)) * np.uint64(0x9E3779B97F4A7C15)
                seen += len(doc)
                cols = [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array((salt >> np.uint64(1)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{PIECES}, salt long")


def _pack_groups(capacity: int, turn: int, last: bool):
    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        group, every = t.column("g").to_numpy(), t.drop_columns(["g"])
        for g in np.unique(group):
            own = every.take(pa.array(np.flatnonzero(group == g)))
            length = own.column("length").to_numpy()
            bins, place, n = best_fit_decreasing(length, capacity)
            bound = lower_bound(length, capacity)
            fill = np.bincount(bins, length, n)
            if last:
                loose = np.zeros(n, bool)
            elif n > bound:
                loose = fill < capacity
            else:
                loose = (np.arange(n) == fill.argmin()) & (fill < capacity)
            seq = (turn << 57) + (int(g) << 28) + bins
            cols = [*(c.combine_chunks() for c in own.columns), pa.array(seq), pa.array(place), pa.array(loose[bins]), pa.array(np.full(len(bins), n)), pa.array(np.full(len(bins), bound))]
            yield from pa.table(cols, names=names).to_batches()

    return run


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 40_000) -> DataFrame:
    """pieces with sequence_id and offset, and the bins and bound of the group that packed them."""
    left, done, before = save(pieces, "pieces"), [], None
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(64):  # a sequence's id has six bits for it
        groups = max(1, -(-left.count() // group_rows))
        last = groups == 1 or turn == 63
        mixed = F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(groups)).alias("g")
        # some groups share a task once there are many
        dealt = left.select("*", mixed).repartition(min(groups, max(tasks, -(-groups // 8))), "g")
        out = save(dealt.mapInArrow(_pack_groups(capacity, turn, last), PACKED), "packed")
        # each bin has one piece at its start
        first = F.col("offset") == 0
        bins, loose = out.agg(F.count_if(first), F.count_if(first & F.col("given_up"))).first()
        if last or not loose or (before is not None and bins >= before):
            done.append(out)
            break
        done.append(out.where("not given_up"))
        left, before = out.where("given_up").select(*left.columns), loose
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    return packed.drop("salt", "given_up")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, **how) -> DataFrame:
    return pack(document_pieces(docs, tokenizer, capacity), capacity, **how)
