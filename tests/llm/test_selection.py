import numpy as np
import pytest

from gleaner.llm import token_store


def test_rows_come_from_select(monkeypatch):
    r = np.random.default_rng(2)
    n = r.integers(1, 900, 1000)
    n[300:600] = 1
    ids = np.arange(n.sum()) % 50_000
    want = np.cumsum(n) - n
    monkeypatch.setattr(token_store.EliasFano, "decode", lambda self: pytest.fail("all offsets expanded"))
    got = token_store.segment_documents(70, token_store.pack(list(range(1000)), n, ids, 2))
    assert got.column("start").to_pylist() == (70 + want).tolist() and got.column("n_tokens").to_pylist() == n.tolist()


@pytest.mark.parametrize("values", [[0], [0, 0, 0], list(range(0, 4000, 3)), [0] * 700 + [1 << 40], [5] * 513])
def test_runs(values):
    e = token_store.EliasFano.from_bytes(token_store.EliasFano.of(np.array(values)).to_bytes())
    for i, j in [(0, len(values)), (0, 0), (len(values) - 1, len(values)), (len(values) // 3, len(values)), (255, 258), (256, 512)]:
        if i <= j <= len(values):
            assert e.between(i, j).tolist() == values[i:j]
    with pytest.raises(IndexError):
        e.between(0, len(values) + 1)
