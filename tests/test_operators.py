import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import aggregates as A
from trackloom.operators import association as C
from trackloom.operators import evaluation as E
from trackloom.operators import filters as P
from trackloom.operators import spatial as G
from trackloom.operators import tables as TB
from trackloom.operators import timeline as L
from trackloom.operators import views as V
from trackloom.operators.tracking import motion, reference_tracks, smooth
from trackloom.plans.saved import get_targets, load


@pytest.fixture
def ref(spark):
    return spark.createDataFrame([(1, 0, 0.0), (1, 10, 100.0), (1, 20, 300.0), (1, 60, 700.0), (2, 5, 1.0)], "utn long, t long, v double")


def test_asof(spark, ref):
    times = [0, 5, 10, 19, 25, -1, 30, 60, 61]
    tst = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)] + [(99, 3, 5)], "id long, utn long, t long")
    for width in (None, 11):
        rows = L.asof_neighbours(tst, ref, "utn", "t", ["v"], 10, width).withColumn("x", L.interpolate("v", "t"))
        got = {r.id: (r.matched, r.x) for r in rows.collect()}
        assert got == {0: (True, 0.0), 1: (True, 50.0), 2: (True, 100.0), 3: (True, 280.0), 4: (False, None), 5: (False, None), 6: (False, None), 7: (True, 700.0), 8: (False, None), 99: (False, None)}


def test_sessions_and_periods(spark):
    rows = spark.createDataFrame([(7, 0, True), (7, 100, True), (7, 401, False), (7, 701, True), (7, 2000, True), (8, 5, True)], "k long, t long, ok boolean")
    for width in (None, 150):
        got = sorted((r.k, r.t, r.session) for r in L.gap_sessions(rows, "k", "t", 300, width).collect())
        assert got == [(7, 0, 1), (7, 100, 1), (7, 401, 2), (7, 701, 2), (7, 2000, 3), (8, 5, 1)]
    found = L.periods(rows, "k", "t", F.col("ok"), 300)
    assert sorted(map(tuple, found.collect())) == [(7, 0, 100), (7, 701, 701), (7, 2000, 2000), (8, 5, 5)]
    spans = spark.createDataFrame([(7, -5, 2100), (9, 0, 1)], "k long, first long, last long")
    gaps = sorted(map(tuple, L.outside_periods(found, spans, "k").collect()))
    assert gaps == [(7, -5, 0), (7, 100, 701), (7, 701, 2000), (7, 2000, 2100), (9, 0, 1)]


def test_detection(spark):
    periods = spark.createDataFrame([(1, 0, 100)], "utn long, period_begin long, period_end long")
    hits = spark.createDataFrame([(1, t) for t in (0, 10, 35, 90)], "utn long, t long")
    r = E.missed_updates(hits, periods, "utn", "t", 10).first()
    assert (r.sum_uis, r.missed) == (10, 7) and abs(r.pd - 0.3) < 1e-12


def test_conservation(spark):
    kinds = ["same", "different", "no_ref_val", "no_tst", "no_ref_pos"]
    rows = spark.range(1000).withColumn("k", F.col("id") % 7).withColumn("status", F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int")))
    for r in E.status_counts(rows, ["k"], "status", F.col("id") % 3 != 0).collect():
        assert r.n_updates - r.n_no_ref_pos == r.n_inside + r.n_outside and r.n_inside == r.n_same + r.n_different + r.n_no_ref_val + r.n_no_tst
        assert r.n_no_ref_pos > 0 and r.n_outside > 0


def test_sliced_helpers_against_plain_windows(spark):
    """previous, running, carried and mark_periods as one window over all rows of a key has them."""
    r = np.random.default_rng(5)
    rows = sorted({(int(r.integers(3)), int(t), int(v) if v % 3 else None) for t, v in zip(r.integers(0, 3000, 300), r.integers(0, 9, 300), strict=True)}, key=lambda x: x[:2])
    rows = [x for i, x in enumerate(rows) if i == 0 or rows[i - 1][:2] != x[:2]]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    w = Window.partitionBy("k").orderBy("t")
    for width in (1, 7, 100, 10_000):
        got = L.previous(df, ["k"], "t", ["t", "v"], width).select("k", "t", "prev.t", "prev.v")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.select("k", "t", F.lag("t").over(w), F.lag("v").over(w)).collect()), key=str)
        got = L.running(df, ["k"], "t", "v", "x", width).select("k", "t", "x")
        assert sorted((k, t, x or 0) for k, t, x in got.collect()) == sorted((k, t, x or 0) for k, t, x in df.select("k", "t", F.sum("v").over(w)).collect())
        got = L.carried(df, ["k"], "t", "v", width).select("k", "t", "v")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.select("k", "t", F.last("v", True).over(w)).collect()), key=str)
        spans = [(0, 10, 500), (0, 700, 700), (1, 0, 2999), (2, 100, 101), (2, 1500, 2500)]
        found = spark.createDataFrame(spans, "k long, period_begin long, period_end long")
        marked = {(x.k, x.t): x.period and (x.period.begin, x.period.end) for x in L.mark_periods(df, found, "k", "t", width).collect()}
        assert marked == {(k, t): next(((a, b) for q, a, b in spans if q == k and a <= t <= b), None) for k, t, _ in rows}


def test_frames_do_not_slide(spark, ref):
    """As-of frames grow from the start of their slice; a sliding one costs rows times rows within reach."""
    tst = spark.createDataFrame([(1, 1, 5)], "id long, utn long, t long")
    plan = L.asof_neighbours(tst, ref, "utn", "t", ["v"], 10)._jdf.queryExecution().executedPlan().toString()
    frames = re.findall("specifiedwindowframe\\(RangeFrame, ([^,]*), ([^)]*)", plan)
    assert frames and all(low == "unboundedpreceding$()" or low.startswith("unboundedpreceding") for low, _ in frames)


def test_filters(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (8,)], "c long")
    n = lambda cond: df.where(cond).count()
    assert n(P.codes("c", "1,NULL", 8)) == 2 and n(P.codes("c", "10", 8)) == 1 and n(P.values_or_null("c", [])) == 0
    assert n(P.compare("c", "NOT IN", [1])) == 3 and n(P.compare("c", "IN", [1, None])) == 2 and n(P.compare("c", "IS", None)) == 1


def test_polygon(spark):
    layer = [G.Sector("s", ((0, 0), (10, 0), (10, 10), (0, 10)), low=100.0), G.Sector("h", ((4, 4), (6, 4), (6, 6), (4, 6)), exclusion=True)]
    points = [(1.0, 1.0, 200.0), (5.0, 5.0, 200.0), (11.0, 1.0, 200.0), (1.0, 1.0, 50.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(points, "x double, y double, h double")
    assert [r.l for r in G.layer_flags(df, {"l": layer}, "x", "y", "h").collect()] == [True, False, False, False, True]


def test_hash_match(spark):
    users = spark.createDataFrame([(1, 1000, "a;b"), (2, 1000, "z")], "id long, t long, h string")
    given = spark.createDataFrame([(10, 930, "a"), (11, 960, "b"), (12, 995, "a"), (13, 1003, "a")], "id long, t long, h string")
    got = {r.id: (r.match, r.dt, r.dubious) for r in C.best_hash_match(users, given, "h", "h", "t", 60, 2, 30).collect()}
    assert got == {1: (12, -5, False), 2: (None, None, None)}


def test_rollover(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([86390.0, 86399.0, 3.0, 10.0])], "s string, i long, tod double")
    assert [r.day for r in L.day_rollover(df, "s", "i", "tod").orderBy("i").collect()] == [0, 0, 1, 1]


def test_dubious(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 2, 100.0), (1, 4, 100.0)], "utn long, t long, v double")
    r = E.dubious(df, ["utn"], "t", {"v": 29.43}, 1.0, 2, 1.0, 0.05).first()
    assert r.n_dubious == 1 and r.is_dubious and r.reason == "changes"


def test_histogram_and_grid(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(float("nan"),), (None,)], "v double")
    got = {r.bin: r.n for r in V.histogram(df, "v", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3, -1: 1, None: 1} and V.integer_bins(0, 3, 10) == (3, 1)
    g = V.grid(df.where("v >= 0").select("v", F.lit(1.0).alias("y")), "v", "y", "v", (0.0, 8.0, 0.0, 1.0), (4, 1)).collect()
    assert sum(r.n for r in g) == 9 and {(r.cx, r.cy) for r in g} == {(i, 0) for i in range(4)}


def test_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, None), (9, "n")], "k long, v string")
    assert sorted(map(tuple, TB.update_by_key(df, new, "k", ["v"]).collect()), key=str) == [(1, "a"), (2, None), (3, None)]
    assert sorted(r.k for r in TB.upsert(df, new, "k").collect()) == [1, 2, 3, 9]
    assert TB.delete(df, F.col("v") == "a").count() == 2


def test_smoothing():
    r = np.random.default_rng(0)
    t = np.arange(0.0, 60.0, 2.0)
    x, y = 100 * t, -50 * t
    s, _ = smooth(t, x + r.normal(0, 30, len(t)), y + r.normal(0, 30, len(t)), 30.0, 1.0)
    assert np.hypot(s[:, 0] - x, s[:, 2] - y).mean() < 25 and abs(s[10, 1] - 100) < 15
    f, q = motion(2.0, 1.0)
    assert f[0, 1] == 2.0 and np.allclose(q, q.T)


def test_saved_spec(spark):
    df = spark.range(100).withColumn("t", F.col("id"))
    spec = {"contents": ["a"], "columns": {"a": ["id"]}, "filters": [{"column": "id", "operator": ">=", "value": 10}, {"column": "none", "operator": "=", "value": 1}], "windows": {"column": "t", "excluded": [[20, 29]]}, "where": "id % 2 = 0"}
    assert load({"a": df}, spec)["a"].count() == 40


def test_dubious_angles(spark):
    df = spark.createDataFrame([(1, t, a) for t, a in enumerate([350.0, 359.0, 1.0, 355.0, 100.0])], "utn long, t long, track double")
    n = lambda **angles: E.dubious(df, ["utn"], "t", {"track": 10.0}, 1.0, 1, 0.0, 0.5, **angles).first()["n_track"]
    assert (n(), n(angles=("track",))) == (3, 1)


def test_unique_values(spark):
    df = spark.createDataFrame([(4, "a"), (2, "b"), (1, "a"), (3, None)], "i long, v string")
    assert sorted(map(tuple, A.unique_values(df, "v", "i").collect())) == [("a", 1, 2), ("b", 2, 1)]


def scalar_filter(t, x, sigma, noise):
    """One axis of the constant-velocity filter and smoother, written with plain numbers."""
    s, p = np.array([x[0], 0.0]), np.array([[sigma**2, 0.0], [0.0, 1e4]])
    states, covs, ahead, steps = [s], [p], [(s, p)], [np.eye(2)]
    for i in range(1, len(t)):
        dt = t[i] - t[i - 1]
        f = np.array([[1.0, dt], [0.0, 1.0]])
        s, p = f @ s, f @ p @ f.T + noise**2 * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
        ahead.append((s, p)), steps.append(f)
        k = p[:, 0] / (p[0, 0] + sigma**2)
        s, p = s + k * (x[i] - s[0]), p - np.outer(k, p[0])
        states.append(s), covs.append(p)
    for i in range(len(t) - 2, -1, -1):
        c = covs[i] @ steps[i + 1].T @ np.linalg.inv(ahead[i + 1][1])
        states[i] = states[i] + c @ (states[i + 1] - ahead[i + 1][0])
        covs[i] = covs[i] + c @ (covs[i + 1] - ahead[i + 1][1]) @ c.T
    return np.array(states), np.array(covs)


def test_tracks_against_a_scalar_filter(spark):
    r = np.random.default_rng(3)
    t = np.cumsum(r.uniform(0.5, 4, 40))
    x, y = 80 * t + r.normal(0, 20, 40), -30 * t + r.normal(0, 20, 40)
    frame = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(t, x, y, strict=True)], "k long, s double, x double, y double").repartition(5)
    got = reference_tracks(frame, "k", "s", "x", "y", 20.0, 2.0).orderBy("t").toPandas()
    (sx, px), (sy, py) = scalar_filter(t, x, 20.0, 2.0), scalar_filter(t, y, 20.0, 2.0)
    assert np.allclose(got[["x", "vx", "y", "vy"]], np.column_stack([sx, sy]), atol=1e-6) and np.allclose(got.stddev, np.sqrt(px[:, 0, 0] + py[:, 0, 0]), atol=1e-6)
    at = np.arange(np.ceil(t[0] / 2), np.floor(t[-1] / 2) + 1) * 2
    grid = reference_tracks(frame, "k", "s", "x", "y", 20.0, 2.0, step=2.0).orderBy("t").toPandas()
    i = np.searchsorted(t, at, side="right") - 1
    w = (at - t[i]) / (t[i + 1] - t[i])
    want = (1 - w) * (sx[i, 0] + sx[i, 1] * (at - t[i])) + w * (sx[i + 1, 0] - sx[i + 1, 1] * (t[i + 1] - at))
    assert np.allclose(grid.t, at) and np.allclose(grid.x, want, atol=1e-6)


def test_table_functions(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0), (3, "c", None)], "k long, v string, x double").withColumn("none", F.lit(None).cast("int"))
    assert [r.v for r in TB.set_null(df, "v").collect()] == [None] * 3 and TB.set_null(df, "v").schema == df.schema
    assert [r.v for r in TB.update_cell(df, "k", 2, "v", "new").orderBy("k").collect()] == ["a", "new", "c"]
    assert TB.drop_empty_columns(df).columns == ["k", "v", "x"] and [r.k for r in TB.cut_prefix(df, "k", 2).orderBy("k").collect()] == [2, 3]
    assert [r.k for r in TB.delete_sources(df, "v", ["a", "c"], ("k", 1)).orderBy("k").collect()] == [2, 3]
    assert [r.x for r in TB.scaled(df, {"x": 2.0}).orderBy("k").collect()] == [4.0, 6.0, None]
    assert TB.compacted(df, ["k"], 2).rdd.getNumPartitions() <= 2 and TB.compacted(df, ["k"], 2).count() == 3
    assert sorted((r.k, r.rec_num) for r in TB.numbered(df, [F.col("k").desc()], 5).collect()) == [(1, 3 * 256 + 5), (2, 2 * 256 + 5), (3, 256 + 5)]
    seen = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, 1, "one")], "k long, t long, v string")
    assert sorted((r.k, r.v) for r in C.latest(seen, "k", "t").collect()) == [(1, "new"), (2, "one")]
    assert sorted(map(tuple, get_targets(seen, "k", "t").collect())) == [(1, 2, 5, 9), (2, 1, 1, 1)]
    one = spark.range(1).select(S.time_seconds(F.lit("01:02:03.500")).alias("s"), S.hex_value(F.lit("fF")).alias("h"), S.trailing_int(F.lit("line 12 ")).alias("i")).first()
    assert tuple(one) == (3723.5, 255, 12) and V.grid_shape(0.0, 10.0, 3.0) == (0.0, 12.0, 4)


def test_quantiles_against_numpy(spark):
    r = np.random.default_rng(8)
    rows = [(int(k), float(v)) for k, v in zip(r.integers(0, 3, 500), np.round(r.normal(0, 5, 500), 1), strict=True)] + [(0, float("nan")), (1, None)]
    got = {x.k: x for x in A.quantiles(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    for k in range(3):
        own = [v for q, v in rows if q == k and v is not None and v == v]
        assert np.allclose([got[k].a, got[k].b, got[k].c], np.quantile(own, [0.1, 0.5, 0.99]))


def test_slices_write_each_report_once(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "t")
    rows = C.in_slices(df, "t", 100, 30).collect()
    assert sum(r.kept for r in rows) == df.count() and all(r.slice * 70 <= r.t < r.slice * 70 + 100 for r in rows)
    bounds = C.slice_bounds(0, 995, 100, 30)
    assert [b[2] for b in bounds[:-1]] == [b[0] for b in bounds[1:]] and bounds[0][0] == 0 and bounds[-1][2] == 996


def test_transponders_that_fail_leave_the_next(spark):
    known = spark.createDataFrame(
        [(1, 7, None, 10.0, 0.0, 5.0), (2, 7, None, 10.0, 1.0, None), (3, None, 9, None, None, 3.0), (4, None, None, 89.95, 170.0, 8.0), (5, None, None, 0.0, 179.99, 9.0)],
        "number long, a long, b long, lat double, lon double, h double",
    )
    rows = [(1, 7, None, 10.001, 1.0), (2, 7, None, 10.0, 0.001), (3, 7, None, 30.0, 0.0), (4, 7, 9, 30.0, 0.0), (5, 0o7777, None, 30.0, 0.0), (6, 1, 1, 89.95, -100.0), (7, None, None, 0.0, -179.99), (8, None, 9, None, None), (9, None, None, 0.05, 179.99)]
    reports = spark.createDataFrame(rows, "id long, code long, address long, lat double, lon double")
    got = C.fixed_transponders(reports, known, "id", {"a": "code", "b": "address"}, "lat", "lon", 15_000.0, "code", "h").collect()
    want = {1: (2, True, 0.0), 2: (1, True, 5.0), 3: (None, False, None), 4: (3, True, 3.0), 5: (None, True, 0.0), 6: (4, True, 8.0), 7: (5, True, 9.0), 8: (3, True, 3.0), 9: (5, True, 9.0)}
    assert {r.id: (r.transponder, r.is_transponder, r.transponder_height) for r in got} == want
    nothing = known.limit(0)
    assert not any(r.transponder for r in C.fixed_transponders(reports, nothing, "id", {"a": "code"}, "lat", "lon", 10.0, "code").collect())
    every = spark.createDataFrame([(6, None, None, None, None, None)], known.schema)
    assert {r.transponder for r in C.fixed_transponders(reports, every, "id", {"a": "code"}, "lat", "lon", 10.0, "code").collect()} == {6}


def test_positions_of_a_reference_that_stands(spark):
    ref = spark.createDataFrame([(1, 0, 10.0, 20.0, 100.0, 5.0), (1, 10, 10.0, 20.0, 200.0, 7.0), (1, 20, 11.0, 20.0, None, 9.0)], "k long, t long, lat double, lon double, h double, v double")
    tst = spark.createDataFrame([(1, 5), (1, 10), (1, 15), (1, 25)], "k long, t long")
    got = L.interpolated_position(L.asof_neighbours(tst, ref, "k", "t", ["lat", "lon", "h", "v"], 10), "t", "lat", "lon", "h", "v")
    found = {r.t: r.ref and tuple(r.ref) for r in got.collect()}
    assert found[5] == (10.0, 20.0, 100.0, None) and found[10] == (10.0, 20.0, 200.0, 7.0) and found[25] is None
    assert np.allclose(found[15], (10.5, 20.0, 200.0, 8.0))


def test_merging_twice(spark):
    """Best pairs first; what they leave is scored anew."""
    pairs = spark.createDataFrame([(1, 2, 5.0), (2, 3, 9.0), (3, 4, 5.0), (5, 6, 5.0), (5, 7, 5.0)], "one long, two long, score double")
    merges = C.best_merges(pairs)
    assert sorted(map(tuple, merges.collect())) == [(3, 2), (6, 5)]
    reports = spark.createDataFrame([(i,) for i in range(1, 8)], "target long")
    assert sorted(r.target for r in C.merged(reports, merges).collect()) == [1, 2, 2, 4, 5, 5, 7]
