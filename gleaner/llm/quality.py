"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

the sum-of-squares form, linear in the number of features. Features: counts of hashed words (damped by the logarithm,
then of one length), and one bin for each structure statistic of the text (length as its metadata, shares of
letters, digits, capitals, marks and white space, length of words and lines, distinct words and lines). The
score reads nothing but the text.

The model is fitted on a bounded sample: at most `max_rows` labelled rows, those of smallest hash of doc_id among rows
that aren't held out, and of these, in the same order, as many as have `max_bytes` of text together (a text that would go
beyond is passed over, later ones may still fit). A feature takes two bytes of text at least, so both bound what the fit
holds. Everything is scored. Held out: crc32(doc_id as text) mod 5 = 0, a null doc_id counting as empty text, so held
out. Null texts count as empty and get a score like others. Different labels of one doc_id each count; of rows that repeat a doc_id the one whose text
has the smallest hash is learnt from. Labels that are null, or of unknown documents, teach nothing. Without both labels in the sample the score is a constant, the share of ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, save
from .tokens import pieces_of

WORD_BITS, BINS = 15, 16
#: the length of a text's vector of words, and the value of each of its structure bins
WORD_SCALE, BIN_VALUE = 0.3, 0.5
#: characters counted by class; each is a share of the text's characters
_CLASSES = (r"\p{Lu}", r"\p{L}", r"\p{N}", r"\s", r"[.,;:!?]", r"[^\p{L}\p{N}\s.,;:!?]", r"\n")
#: upper edges of the bins: lengths by powers of two, shares by a square-root scale
_LENGTH_EDGES, _SHARE_EDGES = 2.0 ** np.arange(1, BINS), (np.arange(1, BINS) / BINS) ** 2
N_STATS = 6 + len(_CLASSES) - 1
SIZE = (1 << WORD_BITS) + N_STATS * BINS


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Scores before the sigmoid; (row, at, x) lists the features of each row, rows in order."""
        starts = np.searchsorted(row, np.arange(rows))
        add = lambda v: np.add.reduceat(v, starts)  # noqa: E731  every row has features
        vx = self.factor[at] * x[:, None]
        return self.bias + add(self.weight[at] * x) + 0.5 * (add(vx) ** 2 - add(vx * vx)).sum(1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), by row. Each row has its structure bins, so none is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")
    words, n_words = cut.flatten(), np.diff(cut.offsets.to_numpy())
    coded = words.dictionary_encode()
    code = np.fromiter((zlib.crc32(w.encode()) & ((1 << WORD_BITS) - 1) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    picked = coded.indices.to_numpy()
    row = np.repeat(np.arange(n), n_words)
    pair, times = np.unique((row << WORD_BITS) | code[picked], return_counts=True)
    row, at, x = pair >> WORD_BITS, pair & ((1 << WORD_BITS) - 1), np.log1p(times)
    x *= WORD_SCALE / np.sqrt(np.maximum(np.bincount(row, x * x, n), 1e-12))[row]

    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
    counts = [pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in _CLASSES]
    distinct = np.bincount(np.unique(np.repeat(np.arange(n), n_words) * (len(code) + 1) + picked) // (len(code) + 1), minlength=n)
    lines = pc.split_pattern(texts, "\n")
    n_lines = np.diff(lines.offsets.to_numpy())
    coded = lines.flatten().dictionary_encode()
    line_codes = len(coded.dictionary) + 1
    own_lines = np.bincount(np.unique(np.repeat(np.arange(n), n_lines) * line_codes + coded.indices.to_numpy()) // line_codes, minlength=n)
    stats = [(np.maximum(chars, 1), True), (n_words, True), (chars / n_lines, True), (2.0 ** np.minimum(chars / n_words, 60), True)]
    stats += [(distinct / n_words, False), (own_lines / n_lines, False), *((c / chars, False) for c in counts[:-1])]
    bins = [np.searchsorted(_LENGTH_EDGES if long else _SHARE_EDGES, v, side="right") for v, long in stats]
    base = (1 << WORD_BITS) + np.arange(N_STATS) * BINS
    row = np.concatenate([row, np.tile(np.arange(n), N_STATS)])
    at = np.concatenate([at, (np.stack(bins) + base[:, None]).ravel()])
    x = np.concatenate([x, np.full(N_STATS * n, BIN_VALUE)])
    order = np.argsort(row, kind="stable")
    return row[order], at[order], x[order]


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(at, name, y, text), a table in the shared folder; rows are taken in the order of (at, name)."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.select("doc_id", F.col("quality").cast("int").alias("y")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    # at most max_rows rows of two numbers
    found = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    # one text for each, however often a doc_id is repeated
    once = found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return save(once.select(F.xxhash64("doc_id").alias("at"), F.concat_ws(":", "doc_id", "y").alias("name"), "y", "text"), "labelled")


def _beyond(sample: DataFrame, max_bytes: int) -> list[str]:
    """Names of the rows that have no room in max_bytes; only lengths come to the driver, max_rows of them at most."""
    out = []
    for r in sample.select("at", "name", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("at", "name").collect():
        if r.n <= max_bytes:
            max_bytes -= r.n
        else:
            out.append(r.name)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, max_bytes: int = 64 << 20, rank: int = 8, epochs: int = 6, seed: int = 7) -> Model:
    """Adagrad on the logistic loss, in batches; features are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces_of(batch, 1, 2 << 20):
                row, at, x = features(b.column(1))
                ends = np.searchsorted(row, np.arange(b.num_rows), side="right")
                each = lambda v, kind: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(v, kind)).cast(pa.list_(kind))
                yield pa.RecordBatch.from_arrays([b.column(0), each(at, pa.int32()), each(x, pa.float32())], ["y", "at", "x"])

    sample = _sample(docs, labels, max_rows)
    beyond = _beyond(sample, max_bytes)
    bounded = sample.where(~F.col("name").isin(beyond)) if beyond else sample
    t = bounded.select("y", "text").mapInArrow(run, "y int, at array<int>, x array<float>").toArrow().combine_chunks()
    discard(sample)
    y = t.column("y").to_numpy().astype(float) if t.num_rows else np.zeros(0)
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, rank)))
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(share / (1 - share))), model.weight, model.factor * 0)
    lists = [t.column(c).combine_chunks() for c in ("at", "x")]
    ends = lists[0].offsets.to_numpy()
    at, x = lists[0].values.to_numpy(), lists[1].values.to_numpy().astype(float)
    # the table arrives in any order; the fit should not depend on it
    ranks = np.argsort([zlib.crc32(at[i:j].tobytes() + x[i:j].tobytes()) for i, j in zip(ends, ends[1:])], kind="stable")
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    g0, gw, gv, rate, decay = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6), 0.1, 1e-4 * 128
    batches = max(1, len(ranks) // 128)
    for _ in range(max(epochs, -(-400 // batches))):  # few rows are gone through more often
        for part in np.array_split(rng.permutation(ranks), batches):
            where = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in part])
            size = ends[part + 1] - ends[part]
            row, a, v = np.repeat(np.arange(len(part)), size), at[where], x[where]
            slope = 1 / (1 + np.exp(-model.raw(a, v, row, len(part)))) - y[part]
            used, slot = np.unique(a, return_inverse=True)
            vx = model.factor[a] * v[:, None]
            sums = np.add.reduceat(vx, np.searchsorted(row, np.arange(len(part))))
            grad = (slope[row] * v)[:, None] * (sums[row] - vx)
            dw = np.bincount(slot, slope[row] * v, len(used)) + decay * model.weight[used]
            dv = np.stack([np.bincount(slot, g, len(used)) for g in grad.T], 1) + decay * model.factor[used]
            gw[used] += dw**2
            gv[used] += dv**2
            model.weight[used] -= rate * dw / np.sqrt(gw[used])
            model.factor[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
            g0 += slope.sum() ** 2
            model.bias -= rate * slope.sum() / np.sqrt(g0)
    return Model(float(model.bias), model.weight.astype(np.float32), model.factor.astype(np.float32))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted`, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x (rank + 1) numbers, whatever the input
    names = [c for c in docs.columns if c not in {"score", "predicted"}]
    docs = docs.select(*names)
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces_of(batch, text, 2 << 20):
                row, at, x = features(b.column(text))
                p = 1 / (1 + np.exp(-np.clip(shared.value.raw(at, x, row, b.num_rows), -30, 30)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))
