"""Removal of long repeated byte strings by column-wise construction of a collection's BWT and common prefixes.

A byte goes if a string of `length` bytes that covers it also starts elsewhere, in any document or its own.

1. Anchors. Each string (window) of `length` bytes picks the gram of `gram` bytes with the smallest hash in it, the
   last such one. Equal windows pick the same gram at the same place, so a repeat shows as two anchors of equal
   gram. Neighbouring windows share anchors: a piece is a run of windows with one anchor, a few hundred bytes.
   Pieces move as hashes, one row for about 180 bytes of text.
   Pieces whose gram occurs only once are done with.
2. Of pieces with the same content (128-bit hash) one goes on, with its number of copies. Where a gram has one content only,
   there is nothing to compare: its copies are repeats throughout.
3. Pieces with one gram, lined up at their anchors, form a collection, and its sorted order is built column by column from
   the right (`repeated_windows`): a round inserts one symbol of each piece before its suffix, which updates the order (the
   BWT's LF step: a stable sort by symbol) and the common prefixes of neighbours (1 + the smallest between them, or 0).
   Symbols come from a sequential external file, a table in the shared folder that holds them column by column. A window
   repeats if its piece has copies or its suffix has a neighbour with a common prefix of `length` or more. As windows only
   match at equal distance from their anchors, columns hold all comparisons that the order of the whole collection would.
4. A collection above `max_group` pieces is divided, again and again, by what its windows have in common (`_divide`): windows
   that start in the left or the right half of a collection's range of starts all cover the bytes from the
   half's last start to its first end. Equal windows agree there, so they stay together. Where one start is left, those
   bytes are the window itself and its pieces are repeats there.
5. Repeated windows become spans of their documents, and the spans' bytes go.

Documents are named by two 64-bit hashes of doc_id and text. Defined cases: null texts count as empty, texts shorter than
`length` stay whole; rows that repeat doc_id and text are documents of their own and repeat each other; a null doc_id is a
document like others; other columns pass through, but for columns named like the result's, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, save
from .tokens import pieces_of

SLICE = 1 << 20  # bytes of text handled at once; longer documents go in overlapping slices
_POS = (1 << 21) - 1
_BASE = 0x9E3779B97F4A7C15
_KEY = ["ah", "p1", "p2", "d0"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


class Anchors:
    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.window = length, gram, length - gram + 1
        self.power, self.inverse = _powers(SLICE + 2 * length)

    def of(self, s: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs (lo, hi) of window starts, their anchor, its hash. part: the text of each byte; windows stay inside."""
        n = len(s) - self.length + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 4
        prefix = np.zeros(len(s) + 1, np.uint64)
        np.cumsum((s.astype(np.uint64) + np.uint64(1)) * self.power[: len(s)], out=prefix[1:])
        grams = _mix((prefix[self.gram :] - prefix[: -self.gram]) * self.inverse[: len(s) - self.gram + 1])
        ranked = (grams & np.uint64(~_POS & (1 << 64) - 1)) | np.uint64(_POS) - np.arange(len(grams), dtype=np.uint64)
        at = _POS - (_sliding_min(ranked, self.window) & np.uint64(_POS)).astype(np.int64)
        inside = np.flatnonzero(part[:n] == part[self.length - 1 :])
        if not len(inside):
            return (np.zeros(0, np.int64),) * 4
        at = at[inside]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return inside[first], inside[np.append(first[1:], len(at)) - 1], at[first], grams[at[first]].view(np.int64)


def _slices(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about SLICE bytes; long texts in slices that overlap by length - 1."""
    held, size = [], 0
    for row, t in enumerate(texts):
        for off in range(0, max(1, len(t) - length + 1), SLICE):
            part = t[off : off + SLICE + length - 1]
            if len(part) < length:
                continue
            if held and size + len(part) > SLICE + length:
                yield held
                held, size = [], 0
            held.append((row, off, part))
            size += len(part)
    if held:
        yield held


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, lo, hi, d0, ah, p1, p2): one row per piece. docs: k1, k2, which name the document, and text."""
    schema = "k1 long, k2 long, lo int, hi int, d0 int, ah long, p1 long, p2 long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, digest = Anchors(length, gram), xxhash.xxh3_128_digest
        for batch in batches:
            for b in pieces_of(batch, 2, 8 << 20):
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(2).cast(pa.binary())]
                for held in _slices(texts, length):
                    body = b"".join(x[2] for x in held)
                    sizes = [len(x[2]) for x in held]
                    part = np.repeat(np.arange(len(held)), sizes)
                    lo, hi, at, ah = anchors.of(np.frombuffer(body, np.uint8), part)
                    view = memoryview(body)
                    p = np.frombuffer(b"".join([digest(view[i:j]) for i, j in zip(lo.tolist(), (hi + length).tolist())]), np.int64).reshape(-1, 2)
                    which = part[lo]
                    shift = (np.array([x[1] for x in held]) - (np.cumsum(sizes) - sizes))[which]
                    row = pa.array(np.array([x[0] for x in held])[which])
                    cols = [b.column(0).take(row), b.column(1).take(row), *(pa.array(x.astype(np.int32)) for x in (lo + shift, hi + shift, at - lo)), pa.array(ah), pa.array(p[:, 0]), pa.array(p[:, 1])]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("k1", "k2", "text").mapInArrow(run, schema)


def columns_of(pieces: list[bytes], d0: np.ndarray) -> tuple[int, int, bytes]:
    """The pieces lined up at their anchors: bytes left of the anchors, width, and the symbols, last column first; 0: nothing there."""
    left = int(d0.max())
    width = left + int(max(len(p) - d for p, d in zip(pieces, d0)))
    kind = np.uint16 if any(b"\xff" in p for p in pieces) else np.uint8
    symbols = np.zeros((len(pieces), width), kind)
    for i, (p, d) in enumerate(zip(pieces, d0)):
        own = symbols[i, left - d : left - d + len(p)]
        own[:] = np.frombuffer(p, np.uint8)
        own += kind(1)
    return left, width, np.ascontiguousarray(symbols.T[::-1]).tobytes()


def repeated_windows(left: int, width: int, columns: bytes, d0: np.ndarray, copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece the starts, from the piece's start, of windows that another piece or a copy of it has at the same distance from its anchor."""
    m = len(d0)
    symbols = np.frombuffer(columns, np.uint8 if len(columns) == m * width else np.uint16)
    hits: list[tuple[np.ndarray, int]] = []
    order, common = np.arange(m), np.zeros(m, np.int32)  # common[i]: of the suffixes at i - 1 and i of the order
    many = copies > 1
    for c in range(width - 1, -1, -1):
        column = symbols[(width - 1 - c) * m : (width - c) * m]
        by_order = column[order]
        move = np.argsort(by_order, kind="stable")
        before, symbol = np.empty(m, np.int64), by_order[move]
        before[0], before[1:] = -1, move[:-1]
        same = np.zeros(m, bool)
        same[1:] = (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)
        fresh = np.zeros(m, np.int32)
        if same.any():
            fresh[same] = 1 + _range_min(common, before[same] + 1, move[same])
        order, common = order[move], fresh
        if c + length <= width:
            full = common >= length
            full[:-1] |= full[1:]
            full &= ~many[order]
            if full.any():
                hits.append((order[full], c))
    out: list[list[int]] = [[] for _ in range(m)]
    for who, c in hits:
        for i in who.tolist():
            out[i].append(c - left + int(d0[i]))
    return [np.array(x[::-1], np.int64) for x in out]


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo..hi]), ends included, by doubling."""
    span = hi - lo + 1
    level = np.frexp(span)[1] - 1
    out, table = np.empty(len(lo), x.dtype), x
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[lo[own]], table[hi[own] + 1 - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


_CUT = "g long, r0 int, r1 int, ah long, p1 long, p2 long, d0 int, copies long, off int, body binary"
_COLUMNS = "ah array<long>, p1 array<long>, p2 array<long>, d0 array<int>, at array<int>, off array<int>, copies array<long>, left int, width int, symbols binary"
_VERDICT = "ah long, p1 long, p2 long, d0 int, s int, e int"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _fields(schema: str) -> tuple[list[str], list[pa.DataType]]:
    each = [c.split() for c in schema.split(", ")]
    return [n for n, _ in each], [pa.list_(_KINDS[k[6:-1]]) if k.startswith("array<") else _KINDS[k] for _, k in each]


def _batches(schema: str, rows: Iterator[tuple], at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    names, kinds = _fields(schema)
    while held := list(islice(rows, at_once)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _pieces_with_text(length: int, gram: int):
    """(body, want) -> rows of _CUT: the pieces of each text. r0 to r1: where a piece's windows may start, counted from the anchor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for text, want in zip(batch.column("body"), batch.column("want")):
                body = text.as_buffer().to_pybytes()
                for p in want.as_py():
                    yield p["ah"], gram - length, 0, p["ah"], p["p1"], p["p2"], p["d0"], p["n"], 0, body[p["lo"] : p["hi"] + length]

    return lambda batches: _batches(_CUT, rows(batches))


def _divide(length: int):
    """Rows of _CUT -> rows for the left and the right half of the range of starts; g: the hash of the bytes that all the half's windows cover."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                middle, body, d0 = (r["r0"] + r["r1"]) // 2, r["body"], r["d0"]
                for r0, r1 in ((r["r0"], middle), (middle + 1, r["r1"])):
                    a, b = max(0, d0 + r0), min(len(body) - length, d0 + r1)
                    if a <= b:
                        g = xxhash.xxh3_64_intdigest(body[d0 + r1 : d0 + r0 + length], r["g"] & (1 << 64) - 1) - (1 << 63)
                        yield g, r0, r1, r["ah"], r["p1"], r["p2"], d0 - a, r["copies"], r["off"] + a, body[a : b + length]

    return lambda batches: _batches(_CUT, rows(batches), 500)


def _in_columns(at_once: int):
    """Rows of _CUT, sorted by g -> rows of _COLUMNS: collections of about at_once pieces; those with one g are never parted."""

    def collection(held: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(held).combine_chunks()
        d0, off, body = t.column("d0").to_numpy(), t.column("off").to_numpy(), t.column("body").to_pylist()
        left, width, symbols = columns_of(body, d0)
        key = [t.column(c).to_pylist() for c in ("ah", "p1", "p2")]
        # a piece's place from its own start, whatever part of it this is
        return *key, (d0 + off).tolist(), d0.tolist(), off.tolist(), t.column("copies").to_pylist(), left, width, symbols

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, n, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)]
            for i, j in zip(cut, cut[1:]):
                if n >= at_once and g[i] != last:
                    yield collection(held)
                    held, n = [], 0
                held.append(b.slice(i, j - i))
                n, last = n + j - i, g[i]
        if held:
            yield collection(held)

    return lambda batches: _batches(_COLUMNS, rows(batches), 1)


def _construct(length: int):
    """Rows of _COLUMNS -> runs of windows (s to e, counted from the piece's start) that repeat."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k] for c in batch.schema.names}
                ah, p1, p2, d0, at, off, copies = (one[c].as_py() for c in ("ah", "p1", "p2", "d0", "at", "off", "copies"))
                found = repeated_windows(one["left"].as_py(), one["width"].as_py(), one["symbols"].as_buffer(), np.array(at), np.array(copies), length)
                for i, starts in enumerate(found):
                    if len(starts):
                        edge = np.flatnonzero(np.diff(starts) > 1)
                        for s, e in zip(starts[np.append(0, edge + 1)].tolist(), starts[np.append(edge, len(starts) - 1)].tolist()):
                            yield ah[i], p1[i], p2[i], d0[i], off[i] + s, off[i] + e

    return lambda batches: _batches(_VERDICT, rows(batches), 20_000)


def _split_collections(cut: DataFrame, length: int, max_group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Collections above max_group pieces -> (rows of _CUT in smaller collections, runs of windows that turned out equal on the way)."""
    small, runs = [], []
    names = _fields(_CUT)[0]
    while True:
        content = (F.xxhash64("d0", "body").alias("c1"), F.xxhash64(F.lit(1), "d0", "body").alias("c2"))
        rows = cut.select("*", *content)
        kinds = save(rows.groupBy("g", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*names)).alias("one")), "kinds")
        # parts of the same content are repeats throughout; one of them goes on, as a piece with copies
        same = rows.join(kinds.where("n > 1").select("g", "c1", "c2"), ["g", "c1", "c2"], "left_semi")
        runs.append(save(same.select("ah", "p1", "p2", (F.col("d0") + F.col("off")).alias("d0"), F.col("off").alias("s"), (F.col("off") + F.length("body") - length).alias("e")), "runs"))
        discard(cut)
        sizes = save(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "sizes")
        one = [F.greatest("one.copies", "n").alias("copies") if c == "copies" else F.col(f"one.{c}") for c in names]
        left = kinds.select("g", "n", "one").join(sizes, "g").select("k", *one)
        small.append(left.where(F.col("k") <= max_group).drop("k"))
        hot = left.where((F.col("k") > max_group) & (F.col("r0") < F.col("r1"))).drop("k")  # different windows of one start never match
        cut = save(hot.mapInArrow(_divide(length), _CUT), "divided")
        if not cut.limit(1).count():
            return small, runs


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 32, max_group: int = 4096) -> DataFrame:
    """(k1, k2, spans): the windows of each document that repeat, as runs [start, end) of bytes that may touch.

    docs: k1, k2, text.
    """
    every = save(anchor_rows(docs, length, gram), "anchors")
    # the counts are written first, so that the join on a very common gram can be split
    grams = save(every.groupBy("ah").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("ah"), "grams")
    # most grams occur once: from here on only pieces with a shared one take part
    anchors = save(every.join(grams, "ah", "left_semi"), "shared")
    discard(every)
    discard(grams)
    pieces = anchors.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("at"))
    pieces = save(pieces, "pieces")
    many = save(pieces.groupBy("ah").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "contents")
    mixed = save(pieces.join(many, "ah").select(*_KEY, "n", "k", "at"), "mixed")
    discard(many)

    def with_text(some: DataFrame) -> DataFrame:
        want = some.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(F.collect_list(F.struct(*_KEY, "n", "at.lo", "at.hi")).alias("want"))
        texts = docs.select("k1", "k2", F.col("text").cast("binary").alias("body"))
        # of rows that repeat doc_id and text one gives the text: a piece enters a collection once
        one = texts.join(want, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("body").alias("body"), F.first("want").alias("want"))
        return one.select("body", "want").mapInArrow(_pieces_with_text(length, gram), _CUT)

    cut, runs = with_text(mixed.where(F.col("k") <= max_group)), []
    if mixed.where(F.col("k") > max_group).limit(1).count():
        small, runs = _split_collections(save(with_text(mixed.where(F.col("k") > max_group)), "cut"), length, max_group)
        for part in small:
            cut = cut.unionByName(part)
    # written before it is dealt: the texts' shuffle files go first
    cut = save(cut, "cut")
    columns = save(cut.repartition("g").sortWithinPartitions("g").mapInArrow(_in_columns(2048), _COLUMNS), "columns")
    discard(cut)
    verdicts = columns.mapInArrow(_construct(length), _VERDICT)
    for part in runs:
        verdicts = verdicts.unionByName(part)
    verdicts = verdicts.unionByName(pieces.where("n > 1").select(*_KEY, F.lit(0).alias("s"), (F.col("at.hi") - F.col("at.lo")).alias("e")))
    verdicts = save(verdicts, "verdicts")
    spans = anchors.join(verdicts, _KEY).select("k1", "k2", F.struct((F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e") + length).alias("e")).alias("span"))
    # rows that repeat doc_id and text share their spans
    spans = save(spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("span")).alias("spans")), "spans")
    for done in (anchors, pieces, mixed, columns, verdicts):
        discard(done)
    return spans


def remove_repeats(docs: DataFrame, length: int = 400, **how) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (longs), spans (merged, array of start and end), kept (binary)."""
    added = {"n_bytes", "n_removed", "n_spans", "spans", "kept", "k1", "k2"}
    names = (F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    docs = docs.select(*(c for c in docs.columns if c not in added), *names)
    spans = repeated_spans(docs.select("k1", "k2", "text"), length, **how)
    out = docs.join(spans, ["k1", "k2"], "left").drop("k1", "k2")
    span = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
    more = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("spans", span), T.StructField("kept", T.BinaryType())]
    base = [f for f in out.schema.fields if f.name != "spans"]
    names, text, last = [f.name for f in base], [f.name for f in base].index("text"), len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for b in batches:
            n, gone, merged, kept = [], [], [], []
            for t, found in zip(b.column(text).cast(pa.binary()), b.column(last)):
                body = t.as_buffer().to_pybytes() if t.is_valid else b""
                runs: list[dict] = []
                for x in found.as_py() or []:
                    if runs and x["s"] <= runs[-1]["e"]:
                        runs[-1]["e"] = max(runs[-1]["e"], x["e"])
                    else:
                        runs.append(x)
                edges = [0, *(v for r in runs for v in (r["s"], r["e"])), len(body)]
                n.append(len(body))
                gone.append(sum(r["e"] - r["s"] for r in runs))
                merged.append(runs)
                kept.append(b"".join(body[i:j] for i, j in zip(edges[::2], edges[1::2])))
            cols = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in merged], pa.int64()), pa.array(merged, arrow), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:last], *cols], [*names, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return out.select(*names, "spans").mapInArrow(run, T.StructType(base + more))
