import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import hard_negatives as module
from trackloom.llm.hard_negatives import hard_negatives, window

SCHEMA = "vec_id long, embedding array<float>, label int, slot int"


def brute(rows, step=50):
    rows = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), label) for i, v, label in rows if v and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for n, (a, av, al) in enumerate(rows):
        if a is None or a % step:
            continue
        others = [(i, int(av @ v), label) for m, (i, v, label) in enumerate(rows) if m != n and len(v) == len(av)]
        positives = sorted((o for o in others if o[2] == al), key=lambda o: order(o[1], o[0]))[:5]
        for p, ps, _ in positives:
            inside = sorted((o for o in others if o[2] != al and 50 * ps <= 100 * o[1] <= 95 * ps), key=lambda o: order(o[1], o[0]))[:3]
            out += [(a, p, k + 1, i, ps, s) for k, (i, s, _) in enumerate(inside)]
    return sorted(out, key=str)


def mined(df, step=50, **more):
    return sorted((tuple(r) for r in hard_negatives(df, F.col("vec_id") % step == 0, **more).collect()), key=str)


@pytest.mark.parametrize("block", [16 << 20, 8 * 16 * 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_BYTES", block)
    monkeypatch.setattr(module, "TILE", 2)
    monkeypatch.setattr(module, "CANDIDATES", 70)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)) * 0.3 + 0.2
    x[100:250] = x[7]
    rows = [(i, v, int(label)) for i, v, label in zip(range(len(x)), x.astype(np.float32).tolist(), rng.integers(0, 4, len(x)), strict=True)]
    want = brute(rows)
    assert len(want) > 50
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(4)
    assert mined(df) == want


def test_window():
    score = np.array([*range(-300, 301), (1 << 62) - 1, -(1 << 62)])
    low, high = window(score)
    for s, a, b in zip(score.tolist(), low.tolist(), high.tolist(), strict=True):
        assert 100 * a >= 50 * s > 100 * (a - 1) and 100 * b <= 95 * s < 100 * (b + 1)


def test_large_scores_are_exact(spark):
    """Beyond 2^53 the products are whole numbers."""
    far = [65535.99609375, 65535.99609375, 65535.0, 3.0]
    rows = [(0, far * 8, 1), (1, far * 8, 1), (2, (far[:3] + [2.99609375]) * 8, 1), (3, [v * 0.75 for v in far] * 8, 2), (4, [v * 0.75 for v in far[:3]] * 8 + [2.0] * 8, 2)]
    assert mined(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    one, two = [1.0, 0.0], [0.7, 0.1]
    rows = [(0, one, 1), (0, one, 1), (0, two, 1), (50, None, 1), (100, one, None), (150, [None, 1.0], 1), (200, [float("nan"), 1.0], 1), (1, one, 1), (2, two, 2), (None, two, 2), (2, two, 2), (3, [0.8, 0.0, 0.0], 2), (250, [], 1), (4, [float("inf"), 1.0], 2), (None, one, 1), (5, [-1.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert mined(df) == brute(rows)
    assert mined(df.where("vec_id > 0 and vec_id < 50")) == []
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    named = spark.createDataFrame([(0, one, "a"), (1, one, "a"), (2, two, "b")], "vec_id long, embedding array<double>, label string")
    assert mined(named) == [(0, 1, 1, 2, 65536, 45824)]
