import random

import pyarrow as pa
import pytest

from gleaner.llm.common import whole_groups


@pytest.mark.parametrize("at_least", [1, 3, 10, 1000])
def test_whole_groups(at_least):
    r = random.Random(at_least)
    for _ in range(40):
        keys = sorted(r.randrange(8) for _ in range(r.randrange(60)))
        cuts = [0, *sorted(r.randrange(len(keys) + 1) for _ in range(5)), len(keys)]
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array(range(i, j), pa.int64())], ["k", "i"]) for i, j in zip(cuts, cuts[1:])]
        got = list(whole_groups(iter(batches), "k", at_least))
        assert [x for t in got for x in t.column("i").to_pylist()] == list(range(len(keys)))
        # no group is parted, and none but the last table is smaller than asked for
        ends = [(t.column("k")[0].as_py(), t.column("k")[-1].as_py()) for t in got]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:])) and all(t.num_rows >= at_least for t in got[:-1])
        assert all(t.num_rows < at_least + keys.count(t.column("k")[-1].as_py()) for t in got)
