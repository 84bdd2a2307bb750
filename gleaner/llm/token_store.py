"""Token ids as a concatenated binary array with Elias-Fano document boundaries.

Format: a table of segments in the shared storage, each a self-contained blob (`pack` / `unpack`):

    magic b"GTOK2\\0", id width in bytes (u8), whether keys are plain (u8), documents (u64), of them without doc_id (u64), ids (u64),
    smallest doc_id (i64), bytes of the keys (u64), bytes of the boundaries (u64),
    keys: doc_id - smallest doc_id of each document that has one, as Elias-Fano (or i64 each, where they lie 2^62 apart),
    boundaries: Elias-Fano, ids (little-endian)

The boundaries are documents + 1 numbers of 2 + log2(ids / documents) bits each with select samples, so
`EliasFano.access` (`between` for a run of documents) finds starts without a table of 64-bit offsets; keys are read the
same way. Documents are in ascending doc_id order over the segments (nulls first, rows of equal doc_id by a hash of the
text), in ranges of about `part_bytes` of text, so a doc_id with many rows spreads over ranges; a segment's place follows from
the counts of the segments before it. Null texts are empty: just the end id. Other columns are not stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import maybe_broadcast, save
from .tokens import pieces_of
from .tokens import tokenizer as encoder

_HEAD, _EF = struct.Struct("<6sBBQQQqQQ"), struct.Struct("<QBQQ")
_MAGIC = b"GTOK2\0"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        width = max(0, int(values[-1] // n).bit_length() - 1)
        parts = [((values[i : i + 8192, None] >> np.arange(width)) & 1).astype(np.uint8) for i in range(0, n, 8192)]
        at = (values >> width) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(n, width, np.concatenate([np.packbits(p.ravel(), bitorder="little") for p in parts]), np.packbits(bits, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, a, b = _EF.unpack_from(data)
        raw = np.frombuffer(data, np.uint8, offset=_EF.size)
        return cls(n, width, raw[:a], raw[a : a + b], np.frombuffer(raw[a + b :].tobytes(), "<u4"))

    def select(self, i: int) -> int:
        """The position of one bit number i among the high bits: from its sample, block by block."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        while True:
            block = np.unpackbits(self.high[byte : byte + 128], bitorder="little")
            if byte == at // 8:
                block[: at % 8] = 0
            ones = np.flatnonzero(block)
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left, byte = left - len(ones), byte + 128

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.width
        bits = np.unpackbits(self.low[first // 8 : (first + self.width + 7) // 8], bitorder="little")[first % 8 :][: self.width]
        return (self.select(i) - i << self.width) | int((bits.astype(np.int64) << np.arange(self.width)).sum())

    def between(self, i: int, j: int) -> np.ndarray:
        """Elements i to j - 1: `select` and the low bits for a run, read from the samples around it alone."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        at, after = int(self.samples[i // SAMPLE]), (j - 1) // SAMPLE + 1
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at // 8 : (end + 7) // 8], bitorder="little")
        bits[: at % 8] = 0
        high = np.flatnonzero(bits)[i % SAMPLE :][: j - i] + at // 8 * 8 - np.arange(i, j)
        first = i * self.width
        bits = np.unpackbits(self.low[first // 8 : (j * self.width + 7) // 8], bitorder="little")[first % 8 :][: (j - i) * self.width]
        return (high << self.width) | (bits.reshape(j - i, self.width).astype(np.int64) << np.arange(self.width)).sum(1)

    def decode(self) -> np.ndarray:
        return self.between(0, self.n)


class Keys:
    """The doc_ids of a segment: nulls first, then ascending."""

    def __init__(self, nulls: int, smallest: int, values: EliasFano | np.ndarray):
        self.nulls, self.smallest, self.values = nulls, smallest, values

    def between(self, i: int, j: int) -> list[int | None]:
        a, b = max(0, i - self.nulls), max(0, j - self.nulls)
        if isinstance(self.values, EliasFano):
            own = (self.values.between(a, b) + self.smallest).tolist()
        else:
            own = self.values[a:b].tolist()
        return [None] * (j - i - len(own)) + own


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """doc_ids: nulls first, then ascending."""
    nulls = sum(d is None for d in doc_ids)
    keys = np.array(doc_ids[nulls:], np.int64)
    if None in doc_ids[nulls:] or (keys[1:] < keys[:-1]).any():
        raise ValueError("doc_ids are not in order")
    smallest = int(keys[0]) if len(keys) else 0
    plain = bool(len(keys)) and int(keys[-1]) - smallest >= 1 << 62
    named = keys.astype("<i8").tobytes() if plain else EliasFano.of(keys - smallest).to_bytes()
    edges = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])).to_bytes()
    head = _HEAD.pack(_MAGIC, width, plain, len(doc_ids), nulls, len(ids), smallest, len(named), len(edges))
    return b"".join([head, named, edges, ids.astype(f"<u{width}").tobytes()])


def unpack(data: bytes) -> tuple[Keys, EliasFano, np.ndarray]:
    """Document ids, boundaries, ids."""
    magic, width, plain, n, nulls, n_ids, smallest, n_keys, n_edges = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a token segment")
    at = _HEAD.size
    named = np.frombuffer(data, "<i8", n - nulls, at) if plain else EliasFano.from_bytes(data[at : at + n_keys])
    at += n_keys
    return Keys(nulls, smallest, named), EliasFano.from_bytes(data[at : at + n_edges]), np.frombuffer(data, f"<u{width}", n_ids, at + n_edges)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, segment_ids: int = 1 << 20, part_bytes: int = 64 << 20) -> DataFrame:
    """The written table (part, seg, first_doc, n_ids, data). Ranges of doc_id are encoded in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seg = encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = 2 if len(tok.n_bytes) <= 1 << 16 else 4
        keys, lengths, parts, held = [], [], [], 0

        def out():
            ids = np.concatenate(parts)
            row = [[part], [seg], [keys[0]], [len(ids)], [pack(keys, np.concatenate(lengths), ids, width)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["part", "seg", "first_doc", "n_ids", "data"])

        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for b in pieces_of(batch, 1):
                ids, n = tok.encode(b.column(1))
                keys += b.column(0).to_pylist()
                lengths.append(n + 1)
                parts.append(np.insert(ids, np.cumsum(n), end_id))
                held += len(parts[-1])
                if held >= segment_ids:
                    yield out()
                    keys, lengths, parts, held, seg = [], [], [], 0, seg + 1
        if keys:
            yield out()

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = d.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    ranges = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    order = ["doc_id", F.xxhash64("text")]
    d = d.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return save(d.mapInArrow(run, "part int, seg int, first_doc long, n_ids long, data binary"), "tokens")


def segment_documents(base: int, data: bytes) -> pa.RecordBatch:
    """The rows of one segment whose first id is number base; keys and boundaries are read as many as a sample covers at once."""
    keys, edges, ids = unpack(data)
    ids, start, size, crc, doc = ids.astype("<u4"), [], [], [], []
    for k in range(0, edges.n - 1, SAMPLE):
        end = min(k + SAMPLE, edges.n - 1)
        own = edges.between(k, end + 1)
        doc += keys.between(k, end)
        start.append(base + own[:-1])
        size.append(np.diff(own))
        at = own.tolist()
        crc += [zlib.crc32(ids[i:j]) for i, j in zip(at, at[1:])]
    cols = [pa.array(doc, pa.int64()), pa.array(np.concatenate(start)), pa.array(np.concatenate(size)), pa.array(crc, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the written segments alone."""
    before = (W.unboundedPreceding, -1)
    # parts are ranges in order; one row for each
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    in_part = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seg").rowsBetween(*before)), F.lit(0))
    placed = segments.select("part", "seg", in_part.alias("off")).join(parts, "part").select("part", "seg", (F.col("base") + F.col("off")).alias("base"))
    # a row for each segment: where they can be broadcast, the ids stay where they are read
    placed = segments.select("part", "seg", "data").join(maybe_broadcast(placed, 1_000_000), ["part", "seg"]).select("base", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1)):
                yield segment_documents(base, data.as_py())

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
