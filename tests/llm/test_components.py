import random

import pytest

from gleaner.llm.components import connected_components
from .helpers import components


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    r = random.Random(4)
    ids = range(120)
    links = {"path": [(i, i + 1) for i in range(59)] + [(80, 81)], "star": [(50, i) for i in range(100)], "random": [(r.randrange(120), r.randrange(120)) for _ in range(70)], "empty": []}[shape]
    df = spark.createDataFrame(links + [(5, 5), (None, 3)], "a bigint, b bigint")
    got = {x.id: x.component_id for x in connected_components(df, "a", "b").collect()}
    want = components(ids, links)
    assert {i: got.get(i, i) for i in ids} == want
