"""Cases of review findings, small enough to be told by hand or by brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from trackloom.operators import association as C
from trackloom.operators import near as N
from trackloom.operators import raster as X
from trackloom.operators import reconstruction as R
from trackloom.operators import timeline as L
from trackloom.operators import tracking as K


@pytest.fixture
def small_batches(spark, monkeypatch):
    """Few rows in a batch and few pairs in a block, so that windows begin and end everywhere."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    monkeypatch.setattr(N, "CELLS", 40)
    monkeypatch.setattr(N, "KEPT", 50)
    yield
    spark.conf.set(key, before)


def traffic(seed: int, n: int, targets: int):
    """(id, target, t, x, y, a, c): places and codes that often meet, some unknown, many at one time."""
    r = random.Random(seed)
    some = lambda v: None if r.random() < 0.2 else v
    return [(i, f"T{r.randrange(targets):02}", r.randrange(200), some(r.randrange(40) / 4), r.randrange(-12, 12) / 4, some(r.randrange(3)), some(r.randrange(0, 900, 100) * 1.0)) for i in range(n)]


TRAFFIC = "id long, target string, t long, x double, y double, a int, c double"


def differ(p, q):
    return None not in (p[5], q[5]) and p[5] != q[5] or None not in (p[6], q[6]) and abs(p[6] - q[6]) > 300


def test_half_turn_by_rounding(spark):
    """187.2 to 7.2 is half a turn, which rounding makes a little less than -180: the way is to the right."""
    ref = spark.createDataFrame([(1, 0, 52 * 3.6), (1, 10, 2 * 3.6), (2, 0, 10.0), (2, 10, 350.0)], "k long, t long, a double")
    assert 2 * 3.6 - 52 * 3.6 + 180 < 0
    tst = spark.createDataFrame([(1, 5), (2, 5)], "k long, t long")
    got = {r.k: r.x for r in L.asof_neighbours(tst, ref, "k", "t", ["a"], 10).select("k", L.interpolate_angle("a", "t").alias("x")).collect()}
    assert abs(got[1] - 277.2) < 1e-9 and min(got[2] % 360, -got[2] % 360) < 1e-9


def test_sums_of_target_pairs(spark, small_batches):
    """sums of pairs from sweeps of groups of targets are those of all pairs."""
    rows = traffic(5, 220, 23)
    want = {}
    for p, q in combinations(rows, 2):
        if p[1] == q[1] or None in (p[3], q[3]) or abs(p[2] - q[2]) > 20:
            continue
        d = math.sqrt((p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2)
        if d <= 2:
            w = want.setdefault(tuple(sorted((p[1], q[1]))), [0, 0, 0, 0, 0.0])
            for i, v in enumerate((1, p[5] is not None and p[5] == q[5] and not differ(p, q), differ(p, q), d > 1, d)):
                w[i] += v
    df = spark.createDataFrame(rows, TRAFFIC)
    for most in (2, 512):
        sums, known = N.pair_sums(df, "t", "x", "y", "a", "c", 20, 2.0, most)
        name = {r.number: r.target for r in known.collect()}
        got = {tuple(sorted((name[r.one], name[r.two]))): [r.n, r.n_same, r.n_different, r.n_not_ok, r.total] for r in sums.collect()}
        assert want and set(got) == set(want) and all(got[k][:4] == want[k][:4] and math.isclose(got[k][4], want[k][4], abs_tol=1e-9) for k in got)
    pairs = C.target_pairs(df, "t", "x", "y", "a", "c", 20, 2.0, 0.0, 1.0, 1.0)
    assert {(r.one, r.two): r.n for r in pairs.collect()} == {k: w[0] for k, w in want.items()}


def test_nearest_of_all_pairs(spark, small_batches):
    """the nearest, how many candidates there are, and agreement, are those of all pairs."""
    rows = traffic(6, 300, 9)
    left, right = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3]
    far = lambda p, q: 9 if None in (p[3], q[3]) or abs(p[2] - q[2]) > 20 else math.sqrt((p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2)
    one, two = spark.createDataFrame(left, TRAFFIC).drop("target"), spark.createDataFrame(right, TRAFFIC).drop("id")
    for coded in (True, False):
        want = {}
        for p in left:
            met = [(far(p, q), q[1]) for q in right if far(p, q) <= 2 and not (coded and differ(p, q))]
            if met:
                want[p[0]] = (*min(met), len(met))
        for copied in (N.LEFT, N.RIGHT):
            got = {r.id: (r.distance, r.target, r.n_candidates) for r in N.nearest(one, two, "t", "x", "y", 20, 2.0, ("a", "c") if coded else None, copied).collect()}
            assert want and got == want
        if coded:
            steps = N.nearest_by_steps(one, two, "t", "x", "y", 20, 2.0, ("a", "c"))
            assert {r.id: r.target for r in steps.collect()} == {k: v[1] for k, v in want.items()}
    kinds = {}
    for p in left:
        for q in right:
            if far(p, q) <= 2:
                k = tuple("unknown" if None in (p[i], q[i]) else "same" if abs(p[i] - q[i]) <= most else "different" for i, most in ((5, 0), (6, 300)))
                kinds[k] = kinds.get(k, 0) + 1
    assert {(r.mode_a, r.mode_c): r.n for r in N.agreement(one, two, "t", "x", "y", 20, 2.0, ("a", "c")).collect()} == kinds


def test_sector_counts(spark):
    """F8: numbers and smallest of the sectors of points, many sectors alike, are those of the rows of points and sectors."""
    r = random.Random(3)
    shapes = [[(0.0, 0.0), (7.0, 2.0), (4.0, 9.0), (1.0, 5.0)], [(2.0, 1.0), (6.0, 1.5), (3.0, 8.0)], [(20.0, 20.0), (60.0, 22.0), (40.0, 70.0)]]
    sectors = [(k, [{"x": x, "y": y} for x, y in shapes[k % 3]], r.choice([None, 20.0]), r.choice([None, 50.0])) for k in range(40)]
    points = [(i, r.randrange(300) / 4 + 0.125 if i % 4 else 3.125, r.randrange(300) / 4 + 0.125 if i % 4 else 3.625, r.choice([None, 10.0, 20.0, 50.0, 70.0])) for i in range(300)]
    s = spark.createDataFrame(sectors, "sector long, corners array<struct<x:double,y:double>>, low double, high double")
    p = spark.createDataFrame(points, "id long, x double, y double, h double")
    want = {}
    for row in X.sectors_of(p, X.sector_index(s), "x", "y", "h").collect():
        n, first = want.get(row.id, (0, 99))
        want[row.id] = (n + 1, min(first, row.sector))
    got = {row.id: (row.n, row["first"]) for row in X.sector_counts(p, s, "id", "x", "y", "h").collect()}
    assert want and got == want and X.sector_counts(p, s.limit(0), "id", "x", "y", "h").collect() == []


def test_near_targets_by_steps(spark, monkeypatch):
    """growing parts of the largest distance find the targets that the whole of it finds at once, and look at fewer pairs."""
    rows = traffic(8, 400, 30)
    df = spark.createDataFrame(rows, TRAFFIC).toDF("id", "target_key", "t", "x", "y", "mode_a", "mode_c")
    unknown, known = df.where("id % 4 = 0"), df.where("id % 4 > 0")
    limits = R.Limits(track_gap=50, window=20, good=0.5, dubious=1.0, not_ok=4.0)
    got, judged = [], []
    plain = R._statuses
    monkeypatch.setattr(R, "_statuses", lambda pairs, *more: (judged[-1].append(pairs.count()), plain(pairs, *more))[1])
    for steps in ((1,), R.STEPS):
        monkeypatch.setattr(R, "STEPS", steps)
        judged.append([])
        got.append({r.id: r.target_key for r in R.near_targets(unknown, known, R.Names(), limits).collect()})
    assert got[0] and got[0] == got[1] and judged[1][-1] < judged[0][0]


def test_tracks_at_once():
    """whole tracks one after another, cut into parts anywhere, are smoothed as each alone, without a call for each."""
    g = np.random.default_rng(4)
    rows = pd.concat([pd.DataFrame({"key": k, "session": s, "t": np.sort(g.uniform(0, 50, n)), "x": g.normal(0, 90, n), "y": g.normal(0, 90, n), "sigma": g.uniform(1, 40, n)}) for k in range(4) for s, n in enumerate((1, 2, 7, 30))], ignore_index=True)
    want = [K.smooth(p.t.to_numpy(), p.x.to_numpy(), p.y.to_numpy(), p.sigma.to_numpy(), 3.0) for _, p in rows.groupby(["key", "session"])]
    for width in (3, 29, 1000):
        got = pd.concat(K._tracks((rows.iloc[i : i + width].reset_index(drop=True) for i in range(0, len(rows), width)), 3.0))
        assert np.allclose(got[["x", "vx", "y", "vy"]], np.concatenate([m for m, _ in want])) and np.allclose(got.stddev, np.concatenate([np.sqrt(2 * p[:, 0, 0]) for _, p in want]))


def test_regions_of_rows(spark, small_batches, monkeypatch):
    """F16: the regions in which rows lie, counted for rows near to each other, are those of all pairs; nulls on both sides."""
    monkeypatch.setattr(N, "TOGETHER", 4)
    r = random.Random(2)
    some = lambda v: None if r.random() < 0.15 else v
    rows = [(i, r.randrange(100), some(r.randrange(20) * 1.0), some(r.randrange(20) * 1.0)) for i in range(200)]
    span = lambda: some(tuple(sorted((r.randrange(-2, 22) * 1.0, r.randrange(-2, 22) * 1.0)))) or (None, None)
    regions = [(t, t + r.randrange(60), *span(), *span()) for t in (r.randrange(80) for _ in range(40))]
    inside = lambda v, a, b, free: a is None or free and v is None or v is not None and a <= v <= b
    want = {i: n for i, t, h, x in rows if (n := sum(a <= t <= b and inside(h, c, d, True) and inside(x, e, f, False) for a, b, c, d, e, f in regions))}
    one = spark.createDataFrame(rows, "id long, t long, h double, x double")
    two = spark.createDataFrame(regions, "low_t long, high_t long, low_h double, high_h double, low_x double, high_x double")
    assert {p.id: p.n_targets for p in N.regions_of(one, two, "id", ["t", "h", "x"], "h", 17).collect()} == want
