"""Queries of association, sectors and views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import association as C
from trackloom.operators import filters as P
from trackloom.operators import raster as X
from trackloom.operators import spatial as G
from trackloom.operators import views as V
from trackloom.plans.common import HOUR, REPORTS, reports, table

ZONE = G.Sector("zone", ((5.0, 2000.0), (45.0, 10000.0), (48.0, 60000.0), (20.0, 90000.0), (3.0, 40000.0)))
HOLE = G.Sector("hole", ((20.5, 20000.5), (30.5, 20000.5), (30.5, 40000.5), (20.5, 40000.5)), exclusion=True)
UPPER = G.Sector("upper", ((1.5, 900.5), (50.5, 900.5), (50.5, 110000.5), (1.5, 110000.5)), low=0.03, high=0.07)


def sector_containment(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0.01, F.col("l_discount")).alias("height"))
    rows = G.layer_flags(li, {"main": [ZONE, HOLE], "upper": [UPPER]}, "l_quantity", "l_extendedprice", "height")
    return rows.groupBy("main", "upper").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"))


def great_circle(spark, sf):
    c = table(spark, sf, "customer").withColumn("lat", F.col("c_custkey") % 60).withColumn("lon", F.col("c_nationkey") * 2.0)
    d = S.haversine(F.lit(48.1), F.lit(16.6), F.col("lat"), F.col("lon"))
    return c.select("c_custkey", F.round(d / 1000, 3).alias("km"), C.distance_class(d / 1852 / 1000).alias("distance_class"))


def radar_positions(spark, sf):
    c = table(spark, sf, "customer").withColumn("slant", F.lit(10000.0) + F.abs("c_acctbal") * 10).withColumn("azimuth", (F.col("c_custkey") % 360).cast("double"))
    lat, lon = S.polar_to_position(F.lit(47.0), F.lit(15.0), F.col("slant"), F.col("azimuth"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") * 100.0), F.lit(300.0))
    return c.select("c_custkey", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


_HASH = (20 * HOUR, 2 * HOUR, 10 * HOUR, 6 * HOUR, HOUR, 12 * HOUR)


def hash_associations(spark, sf):
    """Purchases list two hashes; views have one each, of a third as many values as users, so that hashes collide."""
    r = reports(spark, sf)
    users = r.where("source = 'purchase'").select("id", "t", F.concat_ws(";", F.col("utn") % 50, (F.col("utn") + 1) % 50, F.when(F.col("code") % 9 == 0, "none")).alias("hashes"))
    given = r.where("source = 'view'").select("id", "t", (F.col("utn") % 50).cast("string").alias("hash"))
    return C.hash_associations(users, given, "hashes", "hash", "t", *_HASH)


def hash_outcomes(spark, sf):
    return hash_associations(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("n_candidates").alias("n_candidates"))


def hash_best_match(spark, sf):
    r = reports(spark, sf)
    users = r.where("source = 'purchase'").select("id", "t", F.concat_ws(";", "utn", F.col("utn") + 1).alias("hashes"))
    given = r.where("source = 'view'").select("id", "t", F.col("utn").cast("string").alias("hash"))
    return C.best_hash_match(users, given, "hashes", "hash", "t", 6 * HOUR, HOUR, 3 * HOUR).select("id", "match", "dt", "dubious")


def candidate_range_join(spark, sf):
    r = reports(spark, sf).withColumn("x", F.col("value")).withColumn("y", F.col("code").cast("double"))
    return C.nearest_candidates(r.where("source = 'error'"), r.where("source = 'signup'").withColumnRenamed("utn", "target"), "t", "x", "y", 2 * HOUR, 15.0).withColumn("distance", F.round("distance", 6))


def overlap_pairs(spark, sf):
    spans = reports(spark, sf).groupBy("utn").agg(F.min("t").alias("begin"), F.max("t").alias("end"), F.max("code").alias("code"))
    return C.merge_candidates(spans, "utn", "code", 0.9).withColumn("share", F.round("share", 9))


def fixed_transponder_lookup(spark, sf):
    n = table(spark, sf, "nation")
    f = n.select((F.col("n_nationkey") + 1).alias("number"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") * 3).alias("code"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("address"))
    r = reports(spark, sf).withColumn("address", F.col("utn") % 25)
    return C.first_transponder(r, f, "code", "address").select("id", "transponder", "is_transponder")


def target_filter_first_reason(spark, sf):
    t = reports(spark, sf).groupBy("utn").agg(F.count("*").alias("n"), F.min("code").alias("low"), F.max("value").alias("top"))
    rules = [("few updates", F.col("n") < 55), ("code", F.col("low").isin(1, 2)), ("low", F.col("top") < 480)]
    return t.select("utn", P.first_reason(rules).alias("reason"))


def unassociated(spark, sf):
    r = reports(spark, sf)
    return C.unassociated(r, r.where("code % 4 = 1"), ["source"])


def target_categories(spark, sf):
    t = reports(spark, sf).groupBy("utn").agg(F.max("value").alias("top"), F.min("code").alias("emitter"))
    return t.groupBy(C.category(F.col("utn"), [1, 2, 3], F.col("top") * 2.1, F.col("emitter")).alias("category")).agg(F.count("*").alias("n"))


def target_windows(spark, sf):
    w = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("utn"), (F.lit(1704067200_000000) + F.col("n_nationkey") * 20 * HOUR).alias("begin"))
    return P.without_windows_of(reports(spark, sf), w.withColumn("end", F.col("begin") + 200 * HOUR), "utn", "t").groupBy("utn").agg(F.count("*").alias("n"))


def histogram_range(spark, sf):
    return V.histogram(reports(spark, sf), "value", 20, ["source"])


def histogram_invalid(spark, sf):
    v = F.when(F.col("code") % 10 == 0, float("nan")).when(F.col("code") % 10 != 1, F.col("value"))
    return V.histogram(reports(spark, sf).withColumn("value", v), "value", 10, None, (100.0, 300.0))


def histogram_category(spark, sf):
    return V.category_histogram(table(spark, sf, "orders"), "o_orderpriority", ["o_orderstatus"])


def grid2d_stats(spark, sf):
    g = V.grid(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", (1.0, 50.0, 1000.0, 100000.0), (16, 16))
    return g.select("cx", "cy", "n", "n_nan", "min", "max", *(F.round(c, 8).alias(c) for c in ("mean", "variance", "stddev")))


def scatter_bounds(spark, sf):
    return V.scatter_bounds(table(spark, sf, "lineitem"), ["l_shipdate"], "l_quantity", "l_tax").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def line_cells(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("c_custkey") % 10).cast("double").alias("x2"), (F.col("c_nationkey") % 10).cast("double").alias("y2"))
    return X.line_cells(c, "x1", "y1", "x2", "y2", (0.0, 10.0, 0.0, 10.0), (10, 10)).groupBy("cx", "cy").agg(F.count("*").alias("n"))


def _fields(spark, sf):
    """A quadrilateral with whole corners for each supplier, on a grid of 24 times 24."""
    at = lambda dx, dy: F.struct((F.col("s_suppkey") % 13 + dx).cast("double").alias("x"), (F.col("s_nationkey") % 11 + dy).cast("double").alias("y"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sector"), F.array(at(0, 0), at(7, 2), at(4, 9), at(1, 5)).alias("corners"), F.when(F.col("s_suppkey") % 3 == 0, 20.0).alias("low"), F.when(F.col("s_suppkey") % 4 == 0, 70.0).alias("high"))


def polygon_cells(spark, sf):
    return X.polygon_cells(_fields(spark, sf), "sector", "corners", (0.0, 24.0, 0.0, 24.0), (24, 24)).groupBy("cx", "cy").agg(F.count("*").alias("n"), F.min("sector").alias("first"))


def sectors_of_reports(spark, sf):
    """Thousands of sectors from a table; places of reports are odd quarters, so that none is on an edge's end."""
    x, y = (F.col("utn") * 37 % 96 + 0.5) / 4, (F.col("code") * 29 % 96 + 0.5) / 4
    points = reports(spark, sf).select("id", x.alias("x"), y.alias("y"), F.when(F.col("code") % 6 != 0, F.col("value")).alias("height"))
    return X.sector_counts(points, _fields(spark, sf), "id", "x", "y", "height")


def top_n_rows(spark, sf):
    return V.report_page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100)


def surroundings(spark, sf):
    r = reports(spark, sf).withColumn("value", F.when(F.col("code") != 5, F.col("value")))
    return V.surroundings(r, r.where("id = 500"), "t", "value", 24 * HOUR, 50.0).select("id")


_W = "WITH " + REPORTS


def _inside(sector: G.Sector) -> str:
    edges = zip(sector.corners, sector.corners[1:] + sector.corners[:1], strict=True)
    d = lambda v: f"{v}::DOUBLE"
    return "(" + " + ".join(f"CASE WHEN ({d(y1)} > y) <> ({d(y2)} > y) AND x < {d(x2 - x1)} * (y - {d(y1)}) / {d(y2 - y1)} + {d(x1)} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in edges if y1 != y2) + ") % 2 = 1"


_FIELDS = "WITH f AS (SELECT s_suppkey AS sector, s_suppkey % 13 AS x0, s_nationkey % 11 AS y0, CASE WHEN s_suppkey % 3 = 0 THEN 20 END AS low, CASE WHEN s_suppkey % 4 = 0 THEN 70 END AS high FROM supplier)"
_CORNERS = [(0, 0), (7, 2), (4, 9), (1, 5)]
# whole numbers and halves: the side of each edge is exact without a division
_IN_FIELD = "(" + " + ".join(f"((y0 + {b} > py) <> (y0 + {d} > py) AND (px - x0 - {a}) * ({d - b}) {'<' if d > b else '>'} ({c - a}) * (py - y0 - {b}))::INT" for (a, b), (c, d) in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True)) + ") % 2 = 1"
_PAST, _FUTURE, _OLD, _CLOSE_PAST, _CLOSE_FUTURE, _ENDS = _HASH
_HASHES = f"""WITH {REPORTS}, u AS (SELECT id, t, unnest(list_distinct(string_split(concat_ws(';', utn % 50, (utn + 1) % 50, CASE WHEN code % 9 = 0 THEN 'none' END), ';'))) AS hash FROM reports WHERE source = 'purchase'),
g AS (SELECT id, t, (utn % 50)::VARCHAR AS hash FROM reports WHERE source = 'view'), span AS (SELECT min(t) AS first, max(t) AS last FROM u),
p AS (SELECT u.id, u.hash, g.id AS match, g.t - u.t AS dt FROM u JOIN g ON g.hash = u.hash AND g.t - u.t BETWEEN {-_PAST} AND {_FUTURE}),
b AS (SELECT id, hash, arg_min(match, (abs(dt), match)) AS match, arg_min(dt, (abs(dt), match)) AS dt, count(*) AS n, count(*) FILTER (WHERE dt BETWEEN {-_CLOSE_PAST} AND {_CLOSE_FUTURE}) AS n_close FROM p GROUP BY id, hash),
hashed AS (SELECT u.id, u.hash, b.match, b.dt, coalesce(b.n, 0) AS n_candidates, CASE WHEN b.n IS NULL THEN CASE WHEN u.t - first <= {_ENDS} OR last - u.t <= {_ENDS} THEN 'missing at an end' ELSE 'missing' END WHEN b.dt <= {-_OLD} THEN 'dubious distant'
  WHEN b.dt BETWEEN {-_CLOSE_PAST} AND {_CLOSE_FUTURE} AND n_close > 1 THEN 'dubious collision' ELSE 'found' END AS outcome FROM u CROSS JOIN span LEFT JOIN b ON b.id = u.id AND b.hash = u.hash)"""
SQL = {
    "sector_containment": f"WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y, CASE WHEN l_discount > 0.01::DOUBLE THEN l_discount END AS h FROM lineitem), f AS (SELECT x, {_inside(ZONE)} AND NOT ({_inside(HOLE)}) AS main, {_inside(UPPER)} AND coalesce(h >= 0.03::DOUBLE, true) AND coalesce(h <= 0.07::DOUBLE, true) AS upper FROM p) SELECT main, upper, count(*) AS n, sum(x) AS sum_qty FROM f GROUP BY main, upper",
    "great_circle": "WITH p AS (SELECT c_custkey, radians(c_custkey % 60) AS b, radians(c_nationkey * 2.0::DOUBLE) AS l, radians(48.1::DOUBLE) AS a, radians(16.6::DOUBLE) AS k FROM customer), d AS (SELECT c_custkey, 2 * 6371008.8::DOUBLE * asin(least(1, sqrt(power(sin((b - a) / 2), 2) + cos(a) * cos(b) * power(sin((l - k) / 2), 2)))) AS d FROM p) SELECT c_custkey, round(d / 1000, 3) AS km, CASE WHEN d / 1852 / 1000 > 5 THEN 'not ok' WHEN d / 1852 / 1000 > 2 THEN 'dubious' WHEN d / 1852 / 1000 < 1 THEN 'good' ELSE 'acceptable' END AS distance_class FROM d",
    "radar_positions": "WITH p AS (SELECT c_custkey, 10000.0::DOUBLE + abs(c_acctbal) * 10 AS s, radians((c_custkey % 360)::DOUBLE) AS a, coalesce(CASE WHEN c_nationkey <> 3 THEN c_nationkey * 100.0::DOUBLE END, 300) - 300 AS h FROM customer), g AS (SELECT *, sqrt(greatest(s * s - h * h, 0)) AS g FROM p) SELECT c_custkey, round(47 + degrees(g * cos(a) / 6371008.8::DOUBLE), 7) AS lat, round(15 + degrees(g * sin(a) / (6371008.8::DOUBLE * cos(radians(47)))), 7) AS lon FROM g",
    "hash_best_match": f"{_W}, u AS (SELECT id, t, unnest([utn, utn + 1]) AS h FROM reports WHERE source = 'purchase'), m AS (SELECT u.id, g.id AS match, g.t - u.t AS dt FROM u JOIN reports g ON g.source = 'view' AND g.utn = u.h AND g.t - u.t BETWEEN -{6 * HOUR} AND {HOUR}), b AS (SELECT id, min_by((match, dt), (abs(dt), match)) AS b FROM m GROUP BY id) SELECT r.id, b.b[1] AS match, b.b[2] AS dt, abs(b.b[2]) >= {3 * HOUR} AS dubious FROM reports r LEFT JOIN b USING (id) WHERE r.source = 'purchase'",
    "candidate_range_join": f"{_W}, p AS (SELECT a.id, b.utn AS target, sqrt((b.value - a.value) * (b.value - a.value) + (b.code - a.code) * (b.code - a.code)) AS d FROM reports a JOIN reports b ON a.source = 'error' AND b.source = 'signup' AND abs(a.t - b.t) <= {2 * HOUR}) SELECT id, min_by(target, (d, target)) AS target, round(min(d), 6) AS distance, count(*) AS n_candidates FROM p WHERE d <= 15 GROUP BY id",
    "overlap_pairs": f"{_W}, s AS (SELECT utn, min(t) AS a, max(t) AS b, max(code) AS code FROM reports GROUP BY utn), p AS (SELECT x.code, x.utn AS one, y.utn AS two, (least(x.b, y.b) - greatest(x.a, y.a)) / least(x.b - x.a, y.b - y.a) AS share FROM s x JOIN s y ON x.code = y.code AND x.utn < y.utn AND least(x.b, y.b) > greatest(x.a, y.a) AND x.b > x.a AND y.b > y.a) SELECT code, one, two, round(share, 9) AS share FROM p WHERE share >= 0.9",
    "fixed_transponder_lookup": f"{_W}, f AS (SELECT n_nationkey + 1 AS number, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 3 END AS c, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS a FROM nation), h AS (SELECT r.id, min(number) AS transponder FROM reports r JOIN f ON (c IS NOT NULL OR a IS NOT NULL) AND (c IS NULL OR c = r.code) AND (a IS NULL OR a = r.utn % 25) GROUP BY r.id) SELECT r.id, h.transponder::BIGINT AS transponder, h.transponder IS NOT NULL OR r.code = 4095 AS is_transponder FROM reports r LEFT JOIN h USING (id)",
    "target_filter_first_reason": f"{_W} SELECT utn, CASE WHEN count(*) < 55 THEN 'few updates' WHEN min(code) IN (1, 2) THEN 'code' WHEN max(value) < 480 THEN 'low' END AS reason FROM reports GROUP BY utn",
    "unassociated": f"{_W} SELECT source, count(*) FILTER (WHERE code % 4 = 1) AS n_assoc, count(*) FILTER (WHERE code % 4 <> 1) AS n_unassoc FROM reports GROUP BY source",
    "target_categories": f"{_W}, t AS (SELECT utn, max(value) * 2.1::DOUBLE AS top, min(code) AS e FROM reports GROUP BY utn) SELECT CASE WHEN utn IN (1, 2, 3) THEN 'vehicle' WHEN e BETWEEN 1 AND 5 OR top >= 1000 THEN 'aircraft' ELSE 'unknown' END AS category, count(*) AS n FROM t GROUP BY category",
    "target_windows": f"{_W}, w AS (SELECT n_nationkey + 1 AS utn, 1704067200000000 + n_nationkey * {20 * HOUR} AS a FROM nation) SELECT utn, count(*) AS n FROM reports r WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.utn = r.utn AND r.t BETWEEN a AND a + {200 * HOUR}) GROUP BY utn",
    "histogram_range": f"{_W}, b AS (SELECT min(value) AS a, max(value) AS z FROM reports) SELECT source, CAST(least(floor((value - a) / ((z - a) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM reports, b GROUP BY ALL",
    "histogram_invalid": f"{_W} SELECT CASE WHEN code % 10 = 1 THEN NULL WHEN code % 10 = 0 OR value NOT BETWEEN 100 AND 300 THEN -1 ELSE CAST(least(floor((value - 100) / 20), 9) AS BIGINT) END AS bin, count(*) AS n FROM reports GROUP BY bin",
    "histogram_category": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "grid2d_stats": "SELECT CAST(least(floor((l_quantity - 1) * (16 / 49.0::DOUBLE)), 15) AS BIGINT) AS cx, CAST(least(floor((l_extendedprice - 1000) * (16 / 99000.0::DOUBLE)), 15) AS BIGINT) AS cy, count(*) AS n, CAST(0 AS BIGINT) AS n_nan, min(l_discount) AS min, max(l_discount) AS max, round(avg(l_discount), 8) AS mean, round(var_pop(l_discount), 8) AS variance, round(stddev_pop(l_discount), 8) AS stddev FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_extendedprice BETWEEN 1000 AND 100000 GROUP BY ALL",
    "scatter_bounds": "SELECT l_shipdate::DATE AS l_shipdate, count(*) AS n, min(l_quantity) AS min_x, max(l_quantity) AS max_x, min(l_tax) AS min_y, max(l_tax) AS max_y FROM lineitem GROUP BY ALL",
    "polygon_cells": f"{_FIELDS}, p AS (SELECT f.*, cx, cy, cx + 5e-1 AS px, cy + 5e-1 AS py FROM range(24) a(cx), range(24) b(cy), f) SELECT cx, cy, count(*) AS n, min(sector) AS first FROM p WHERE {_IN_FIELD} GROUP BY cx, cy",
    "sectors_of_reports": f"{_FIELDS}, {REPORTS}, q AS (SELECT id, (utn * 37 % 96 + 5e-1) / 4 AS px, (code * 29 % 96 + 5e-1) / 4 AS py, CASE WHEN code % 6 <> 0 THEN value END AS height FROM reports) SELECT id, count(*) AS n, min(sector) AS first FROM q JOIN f ON px BETWEEN x0 AND x0 + 7 AND coalesce(height >= low, true) AND coalesce(height <= high, true) WHERE {_IN_FIELD} GROUP BY id",
    "hash_associations": f"{_HASHES} SELECT * FROM hashed",
    "hash_outcomes": f"{_HASHES} SELECT outcome, count(*) AS n, sum(n_candidates)::BIGINT AS n_candidates FROM hashed GROUP BY outcome",
    "line_cells": """WITH c AS (SELECT c_custkey, c_custkey % 10 AS x, c_nationkey % 10 AS y FROM customer), d AS (SELECT *, 2 * greatest(x, 1) * greatest(y, 1) AS d FROM c),
p AS (SELECT DISTINCT c_custkey, least(x * m // d, 9) AS cx, least(y * m // d, 9) AS cy FROM d, unnest(range(0, d + 1)) AS t(m)) SELECT cx, cy, count(*) AS n FROM p GROUP BY cx, cy""",
    "top_n_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "surroundings": f"{_W}, m AS (SELECT t, CASE WHEN code <> 5 THEN value END AS h FROM reports WHERE id = 500) SELECT r.id FROM reports r, m WHERE r.t BETWEEN m.t - {24 * HOUR} AND m.t + {24 * HOUR} AND (r.code = 5 OR r.value BETWEEN m.h - 50 AND m.h + 50)",
}
