import random
from fractions import Fraction
from math import floor

from pyspark.sql import functions as F

from trackloom.operators import evaluation as E
from trackloom.operators import filters as P
from trackloom.operators.raster import line_cells, polygon_cells, sector_index, sectors_of
from trackloom.plans import requirements as R


def touched(x1, y1, x2, y2, n):
    """The half-open cells of an n x n grid with a point of the line, in exact arithmetic; its outer edges belong to the last cells."""
    x1, y1, x2, y2 = map(Fraction, (x1, y1, x2, y2))
    at = {Fraction(0), Fraction(1)}
    for a, b in ((x1, x2), (y1, y2)):
        if a != b:
            at |= {s for k in range(-60, 61) if 0 <= (s := (k - a) / (b - a)) <= 1}
    at = sorted(at)
    at += [(a + b) / 2 for a, b in zip(at, at[1:])]
    out = set()
    for s in at:
        x, y = x1 + (x2 - x1) * s, y1 + (y2 - y1) * s
        if 0 <= x <= n and 0 <= y <= n:
            out.add((min(floor(x), n - 1), min(floor(y), n - 1)))
    return out


def test_lines(spark):
    r = random.Random(4)
    lines = [(0, 0, 0, 10, 10), (1, 3, 3, 3, 3), (2, 0, 5, 10, 5), (3, 10, 0, 0, 10), (4, 9, 3, 0, 0), (5, -4, 7, 15, -2), (6, 12, 12, 14, 14), (7, 10, 10, 10, 0)]
    lines += [(i, *(r.randrange(-32, 120) / 8 for _ in range(4))) for i in range(8, 400)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, *p in lines], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {(x.id, x.cx, x.cy) for x in line_cells(df, "x1", "y1", "x2", "y2", (0.0, 10.0, 0.0, 10.0), (10, 10)).collect()}
    want = {(i, *c) for i, *p in lines for c in touched(*p, 10)}
    # no touched cell is missed; a rounded corner may add a neighbour that the line meets within 1e-9
    assert want <= got and len(got - want) <= 0.01 * len(want)


def inside(corners, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_polygons_and_sectors(spark):
    r = random.Random(5)
    sectors = []
    for i in range(120):
        # from a thousandth of the plane to all of it, some of them crossing themselves
        size, x, y = 0.05 * 3 ** r.randrange(7), r.uniform(0, 40), r.uniform(0, 40)
        sectors.append((i, [(x + r.uniform(0, size), y + r.uniform(0, size)) for _ in range(r.randrange(3, 9))], r.choice([None, 10.0]), r.choice([None, 30.0])))
    df = spark.createDataFrame(sectors + [(200, [(1.0, 1.0), (2.0, 2.0)], None, None), (201, [], None, None)], "sector long, corners array<struct<x:double,y:double>>, low double, high double").cache()
    points = [(i, *(r.uniform(-2, 45) for _ in range(2)), r.choice([None, 5.0, 20.0, 35.0]), r.choice([None, True, False])) for i in range(800)] + [(900, None, 1.0, None, None)]
    at = spark.createDataFrame(points, "id long, x double, y double, h double, g boolean")
    index = sector_index(df)
    got = {(p.id, p.sector) for p in sectors_of(at, index, "x", "y", "h", "g").collect()}
    want = {(i, s) for i, x, y, h, g in points if x is not None for s, c, low, high in sectors if inside(c, x, y) and not (h is not None and (low or 0) > h) and not (h is not None and high is not None and h > high) and not (g and low)}
    assert got == want
    assert len(want) > 200
    assert index.groupBy("sector").count().agg(F.max("count")).first()[0] < 2500
    cells = {(c.sector, c.cx, c.cy) for c in polygon_cells(df, "sector", "corners", (0.0, 40.0, 0.0, 40.0), (40, 40)).collect()}
    assert cells == {(s, x, y) for s, c, *_ in sectors for x in range(40) for y in range(40) if inside(c, x + 0.5, y + 0.5)}
    every = {(c.sector, c.cx, c.cy) for c in polygon_cells(df, "sector", "corners", (0.0, 40.0, 0.0, 40.0), (40, 40), border=True).collect()}
    assert cells <= every and {(i, min(39, floor(x)), min(39, floor(y))) for i, c, *_ in sectors for x, y in c if 0 <= x <= 40 and 0 <= y <= 40} <= every
    assert sectors_of(at, index.limit(0), "x", "y").collect() == []


def test_gap_limits_after_the_tolerance(spark):
    hits = spark.createDataFrame([("a", t) for t in (0, 12, 30, 65)], "utn string, t long")
    periods = spark.createDataFrame([("a", 0, 65)], "utn string, period_begin long, period_end long")
    missed = lambda *more: E.missed_updates(hits, periods, "utn", "t", 10, *more).first().missed
    # gaps of 12, 18 and 35; with a tolerance of 3 these are 9, 15 and 32
    assert missed() == 1 + 1 + 3 and missed(3) == 1 + 3 and missed(3, 16) == 3 and missed(3, 15) == 4 and missed(3, None, 32) == 4 and missed(3, None, 31) == 1


def test_identification_false_and_target_lists(spark):
    rows = [("different", "no_tst", "no_ref_val"), ("different", "different", "different"), ("same", "different", "no_tst"), ("no_tst", "no_tst", "no_ref_val")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    every, some = (df.select(E.identification_false(["a", "b", "c"], need).alias("r")).collect() for need in (True, False))
    assert [x.r for x in every] == ["not_false", "false", "not_false", "not_false"] and [x.r for x in some] == ["false", "false", "false", "not_false"]
    targets = spark.createDataFrame([(1, [5, 70], [1]), (2, [66], [1, 2]), (3, [], []), (4, None, None)], "utn long, codes array<int>, addresses array<int>")
    targets = targets.selectExpr("*", "false AS p", "true AS m", "9.0D AS top", "100 AS d", "50 AS n", "true AS seen")
    reasons = lambda codes, addresses: [x.r for x in targets.orderBy("utn").select(P.target_reasons("codes", 3, 10, "p", "m", "top", "d", "n", codes, 1.0, "seen", "addresses", addresses).alias("r")).collect()]
    assert reasons(([5, (60, 67)], True), ([2], True)) == ["Mode A code", "Mode A code", None, None]
    assert reasons(([(0, 70)], False), ([2], False)) == ["address", None, "Mode A code", "Mode A code"]


def test_identification_false_judges_every_matched_report(spark):
    """Against a loop by report: every one is false or correct, and those with nothing to compare are counted beside."""
    sf = "/root/testdata/sf0.01"
    want = {}
    for x in R._statuses(spark, sf).where("matched").collect():
        seen = [x.s_mode_a, x.s_acad, x.s_acid]
        n = want.setdefault(x.utn, [0, 0, 0, 0])
        n[0] += "different" in seen
        n[1] += seen == ["different"] * 3
        n[2] += seen != ["different"] * 3
        n[3] += not {"same", "different"} & set(seen)
    got = {x.utn: [x.n_any, x.n_all, x.n_correct, x.n_unknown] for x in R.identification_false(spark, sf).collect()}
    assert got == want and all(sum(n[i] for n in want.values()) for i in range(4))
    rows = [(None, "no_tst"), ("no_ref_val", "no_tst"), ("same", None), ("no_tst", "different")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [x.r for x in df.select(E.any_comparable(["a", "b"]).alias("r")).collect()] == [False, False, True, True]
    assert not df.select(E.any_comparable([]).alias("r")).first().r
