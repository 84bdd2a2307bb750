import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import packing, token_store
from gleaner.llm.tokens import WordTokenizer, default_path, pieces_of
from .helpers import SCHEMA, corpus, frame, long_texts


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_equal_whole_texts(reference):
    r = random.Random(1)
    parts = ["a", "don't", "é", "正文", " ", " ", " ", "\n", "\t", "  ", "\x1c", "\x85", "\xa0", "　", "1234", "!!", "<|endoftext|>", "Word,", "'s", "​", "\r\n", "👍"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(3000)] + [None, "", " ", "x "]
    k = WordTokenizer(default_path(), max_words=50)
    for i in range(0, len(texts), 300):
        flat, n = k.encode(pa.array(texts[i : i + 300], pa.string()))
        got = np.split(flat, np.cumsum(n)[:-1])
        assert all(g.tolist() == reference(t) for g, t in zip(got, texts[i : i + 300]))


def test_pieces_of():
    b = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "c"])], ["t"])
    parts = list(pieces_of(b, 0, 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == ["aa", None, "b" * 50, "", "c"] and len(parts) > 1


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 9, 1000], list(range(0, 4000, 3)), [0, 1 << 40]])
def test_elias_fano(values):
    e = token_store.EliasFano.from_bytes(token_store.EliasFano.of(np.array(values)).to_bytes())
    assert e.decode().tolist() == values and [e.access(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        e.access(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 20_000))
    assert 8 * len(token_store.EliasFano.of(values).to_bytes()) / len(values) < 2 + np.log2(1000) + 1.5


def test_segments():
    data = token_store.pack([None, 5, 9], np.array([2, 0, 3]), np.arange(5), 2)
    keys, edges, ids = token_store.unpack(data)
    assert (keys.between(0, 3), edges.decode().tolist(), ids.tolist()) == ([None, 5, 9], [0, 2, 2, 5], [0, 1, 2, 3, 4])
    far = [-(1 << 63), 0, (1 << 63) - 1]
    assert token_store.unpack(token_store.pack(far, np.ones(3, int), np.arange(3), 2))[0].between(0, 3) == far
    near = list(range(10**12, 10**12 + 40_000, 4))
    data = token_store.pack(near, np.ones(10_000, int), np.arange(10_000), 2)
    keys = token_store.unpack(data)[0]
    assert keys.between(0, 10_000) == near and keys.between(777, 801) == near[777:801]
    assert len(data) < 10_000 * (2 + 1)  # ids of two bytes; under a byte for a document's key and boundary
    with pytest.raises(ValueError):
        token_store.pack([2, 1], np.ones(2, int), np.arange(2), 2)
    with pytest.raises(ValueError):
        token_store.unpack(b"x" * 60)


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_round_trip(spark, reference, segment):
    rows = corpus() + [(None, "null key"), (2003, "again"), (2010, "before <|endoftext|> after"), (-5, "negative key")]
    segments = token_store.write_tokens(frame(spark, rows, ["data", "part"]).repartition(3), default_path(), segment_ids=segment)
    got = token_store.read_tokens(segments).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    at, texts = 0, {}
    for i, t in rows:
        texts.setdefault(i, []).append(zlib.crc32(np.array(reference(t) + [0], "<u4")))
    for r in got:
        assert r.start == at and r.ids_crc32 in texts[r.doc_id]
        at += r.n_tokens
    assert at == sum(len(reference(t)) + 1 for _, t in rows)
    assert token_store.read_tokens(token_store.write_tokens(spark.createDataFrame([], SCHEMA), default_path())).count() == 0


def test_bounds():
    r = np.random.default_rng(1)
    for _ in range(40):
        lengths = r.integers(1, 101, r.integers(1, 60))
        bins, place, n = packing.best_fit_decreasing(lengths, 100)
        bound = packing.lower_bound(lengths, 100)
        assert -(-lengths.sum() // 100) <= bound <= n
        for b in range(n):
            own = np.argsort(place[bins == b])
            assert (np.cumsum(lengths[bins == b][own]) - lengths[bins == b][own] == place[bins == b][own]).all() and lengths[bins == b].sum() <= 100
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3
    assert packing.lower_bound(np.zeros(0, int), 100) == 0


@pytest.mark.parametrize("group_rows", [40_000, 20])
def test_packing(spark, reference, group_rows):
    rows = corpus(200) + [(None, "null key"), (2003, "one"), (9000, "many words here " * 300)]
    out = packing.pack_documents(frame(spark, rows, ["piece", "g", "salt"]), default_path(), 256, group_rows=group_rows)
    got = out.collect()
    ids = {i: np.array(reference(t) + [0], "<u4") for i, t in rows}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part) == r.ids_crc32 and r.length <= 256 and (r.length == 256 or r.piece == 0)
    assert sum(r.length for r in got) == sum(len(reference(t)) + 1 for _, t in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 256
    bound = packing.lower_bound(np.array([r.length for r in got]), 256)
    # a certified group loses less than a bin to rounding
    groups = {s >> 28 for s in bins}
    assert bound <= len(bins) <= bound + len(groups)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), default_path()).count() == 0


def test_texts_of_several_megabytes(spark, reference):
    rows = long_texts()
    ids = {i: np.array(reference(t) + [0], "<u4") for i, t in rows}
    got = token_store.read_tokens(token_store.write_tokens(frame(spark, rows), default_path(), segment_ids=1 << 16)).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(x)) for i, x in ids.items()]
    pieces = packing.pack_documents(frame(spark, rows), default_path()).collect()
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) for r in pieces) and sum(r.length for r in pieces) == sum(map(len, ids.values()))
    assert len({r.sequence_id for r in pieces}) == packing.lower_bound(np.array([r.length for r in pieces]), 2048)
