import random

import pytest

from trackloom.llm.components import components


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, small):
    r = random.Random(small)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(120)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2040)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long"), small).collect() == []
