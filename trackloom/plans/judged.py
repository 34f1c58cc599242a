"""Queries of extra data in a sector, interest, surroundings of several targets, categories and accuracies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.functions import text as X
from trackloom.operators import association as C
from trackloom.operators import evaluation as E
from trackloom.operators import spatial as G
from trackloom.operators import timeline as L
from trackloom.operators import tracking as K
from trackloom.operators import views as V
from trackloom.plans.common import FLIGHTS, HOUR, REACH, flights, table
from trackloom.plans.requirements import _A, _status, _statuses
from trackloom.plans.timelines import _PERIODS, _W, _periods

#: Mode of movement -> what its null and its value are taken from.
MODES = {"longitudinal": (5, 1), "transversal": (6, 4), "vertical": (7, 16)}
SECTOR = G.Sector("sector", ((47.05, 13.002), (48.0, 13.03), (47.9, 13.09), (47.2, 13.08)))


def extra_data_in_sector(spark, sf):
    clicks = flights(spark, sf).where("source = 'click'").select("utn", "t", "lat", "lon")
    out = E.extra_data(clicks, _periods(spark, sf), "utn", "t", inside=G.in_polygon(SECTOR, F.col("lat"), F.col("lon")))
    return out.withColumn("p_extra", F.round("p_extra", 9))


def _counts(spark, sf):
    """For each user and attribute the reports that are different and those that could be compared."""
    s = _statuses(spark, sf).where("matched")
    each = s.select("utn", F.explode(F.array(*(F.struct(F.lit(c).alias("requirement"), F.col(f"s_{c}").alias("status")) for c in ("mode_a", "acad", "acid")))).alias("e")).select("utn", "e.*")
    return each.groupBy("utn", "requirement").agg(F.count_if(F.col("status") == "different").alias("failed"), F.count_if(F.col("status").isin("same", "different")).alias("total"))


def interest_by_requirement(spark, sf):
    return E.interest_contributions(_counts(spark, sf), "utn", ["requirement"], "failed", "total")[0].withColumn("factor", F.round("factor", 9))


def interest_of_targets(spark, sf):
    return E.interest_contributions(_counts(spark, sf), "utn", ["requirement"], "failed", "total")[1].withColumn("factor", F.round("factor", 7))


def surroundings_of_each(spark, sf):
    f = flights(spark, sf)
    marks = f.where("utn % 20 = 3 and code % 4 = 1")
    return V.surroundings_of_each(f, marks, "utn", "id", "t", "mode_c", HOUR, 300.0, ("lat", "lon"), 24 * HOUR)


def target_categories(spark, sf):
    f = flights(spark, sf)
    each = f.groupBy("utn").agg(F.min("acad").alias("address"), F.max("acid").alias("name"), F.max("mode_c").alias("top"), F.max(F.col("code") % 7).alias("emitter"))
    kind = C.category(F.col("address"), [0, 1009], F.col("top"), F.when(F.col("utn") % 3 == 0, F.col("emitter")), F.col("name"), ["TGT7", "TGT11", "TGT99"])
    return each.select("utn", kind.alias("category"))


def accuracy_step(spark, sf):
    """One step of the variances: positions against each user's mean, which itself is known to a hundredth of a degree."""
    f = flights(spark, sf).where("lat is not null")
    middle = f.groupBy("utn").agg(F.avg("lat").alias("fx"), F.avg("lon").alias("fy"))
    return K.variance_step(f.join(middle, "utn").withColumn("v", F.lit(1e-4)), "source", ("lat", "lon"), ("fx", "fy"), "v").withColumn("sigma", F.round("sigma", 9))


def altitude_fill_trusted(spark, sf):
    """Measured heights go before the reported ones."""
    f = flights(spark, sf).withColumn("measured", F.when(F.col("code") % 4 == 1, F.col("mode_c") + 7)).withColumn("mode_c", F.when(F.col("code") % 3 != 0, F.col("mode_c")))
    return L.fill_nearest(f, "utn", "t", "mode_c", REACH, "measured").select("id", F.round("mode_c", 5).alias("mode_c"))


def reference_positions(spark, sf):
    """W1 on positions of a coarse grid, so that many references stand still."""
    f = flights(spark, sf).withColumns({c: F.floor(F.col(c) * 10) / 10.0 for c in ("lat", "lon")})
    a = L.asof_neighbours(f.where("source in ('click', 'purchase')").select("id", "utn", "t"), f.where("source = 'view'"), "utn", "t", ["lat", "lon", "mode_c", "speed"], REACH)
    ref = L.interpolated_position(a, "t", "lat", "lon", "mode_c", "speed").where("ref is not null").select("id", "ref.*")
    return ref.select("id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("mode_c", 4).alias("mode_c"), F.round("speed", 5).alias("speed"))


def dubious_by_speed(spark, sf):
    """Times in hours, speeds in metres an hour; a third of the reports has its own speed."""
    f = flights(spark, sf).withColumn("own", F.when(F.col("code") % 3 == 0, F.col("speed") * 60))
    rules = {"limits": {"mode_c": 9000.0}, "second": float(HOUR), "least_updates": 30, "least_duration": 240.0, "most_share": 0.2, "compared": (0.5, 40.0)}
    return E.dubious(f, ["utn"], "t", speed=E.Speed("own", "lat", "lon", 9000.0), **rules).withColumn("duration", F.round("duration", 6))


def dubious_target_ratio(spark, sf):
    out = E.dubious_ratio(dubious_by_speed(spark, sf).withColumn("k", F.col("utn") % 4), ["k"])
    return out.select("k", "n", "n_dubious", *(F.round(c, 4).alias(c) for c in ("mean_dubious", "mean_other", "p_dubious")))


def modes_of_movement(spark, sf):
    """Each mode of movement against the reference, one row for each target and mode."""
    f = flights(spark, sf).withColumns({m: e for m, e in _modes().items()})
    a = L.asof_neighbours(f.where("source in ('click', 'purchase')").select("id", "utn", "t", *MODES), f.where("source = 'view'"), "utn", "t", list(MODES), REACH).where("matched")
    each = a.select("utn", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), L.compare_status(m, m).alias("status")) for m in MODES))).alias("e")).select("utn", "e.*")
    out = E.correct_rate(E.status_counts(each, ["utn", "mode"], "status"))
    return out.select("utn", "mode", "n_inside", "n_same", "n_different", "n_no_ref_val", "n_no_tst", F.round("p_correct", 9).alias("p_correct"))


def _modes():
    """What stands for the modes in the reports: two bits of the code each, some unknown."""
    return {m: F.when(F.col("code") % n != 0, F.floor(F.col("code") / d) % 4) for m, (n, d) in MODES.items()}


def fixed_transponders(spark, sf):
    """J12 with each set of attributes, positions and heights."""
    n = F.col("n_nationkey")
    f = table(spark, sf, "nation").select((n + 1).alias("number"), F.when(n % 3 != 0, n * 37 % 4096).alias("mode_a"), F.when(n % 2 == 1, n * 1009).alias("acad"), F.when(n % 5 != 0, n * 10.0).alias("height"), F.when((n % 4 == 0) | (n % 6 == 0), 47 + n * 4e-2).alias("lat"), F.when((n % 4 == 0) | (n % 6 == 0), 13.02 + n * 1e-2).alias("lon"))
    r = C.fixed_transponders(flights(spark, sf), f.where("lat is not null or mode_a is not null or acad is not null"), "id", {"mode_a": "mode_a", "acad": "acad"}, "lat", "lon", 15000.0, "mode_a", "height")
    return r.select("id", "transponder", "is_transponder", "transponder_height")


def text_forms(spark, sf):
    """reports' values as text and back in parts."""
    f = flights(spark, sf)
    area, own = X.split_source_id(S.source_id(F.col("utn") % 255, F.col("code")))
    counter, content = X.split_record_number(S.record_number(F.col("id"), F.col("code")))
    return f.select(
        "id", X.date_text(F.col("t")).alias("day"), X.day_time_text(F.col("t")).alias("time"), X.padded(F.col("code"), 4).alias("code_text"), X.fixed_text(F.col("code"), 2).alias("fixed"),
        X.nearest_power_of_10(F.col("speed") * F.col("code")).alias("power"), area.alias("area"), own.alias("own"), counter.alias("counter"), content.alias("content"), X.latex_text(F.concat_ws("_", "source", "acid")).alias("latex"),
    )


def bearings_between(spark, sf):
    """Bearings a quarter of the way between two."""
    f = flights(spark, sf).where("lat is not null and lon is not null")
    got = X.interpolated_bearing(F.col("lon") - 13, F.col("lat") - 47.5, F.col("angle") - 180, F.col("speed") - 280, F.lit(0.25))
    return f.select("id", F.round(got, 6).alias("bearing"))


def source_accuracies(spark, sf):
    f = flights(spark, sf).select("utn", (F.col("t") / 1e6 / 10000).alias("s"), (F.col("lat") * 1000).alias("x"), (F.col("lon") * 1000).alias("y"), "source")
    return K.estimated_accuracies(f, "utn", "s", "x", "y", "source", rounds=2).select("source", F.round("sigma", 6).alias("sigma"), "n")


QUERIES = {"source_accuracies": source_accuracies}
_EDGES = list(zip(SECTOR.corners, SECTOR.corners[1:] + SECTOR.corners[:1], strict=True))
_INSIDE = "(lat BETWEEN {}::DOUBLE AND {}::DOUBLE AND lon BETWEEN {}::DOUBLE AND {}::DOUBLE AND (".format(min(x for x, _ in SECTOR.corners), max(x for x, _ in SECTOR.corners), min(y for _, y in SECTOR.corners), max(y for _, y in SECTOR.corners))
_INSIDE += " + ".join(f"(({b}::DOUBLE > lon) <> ({d}::DOUBLE > lon) AND lat < ({c}::DOUBLE - {a}::DOUBLE) * (lon - {b}::DOUBLE) / ({d}::DOUBLE - {b}::DOUBLE) + {a}::DOUBLE)::INT" for (a, b), (c, d) in _EDGES) + ") % 2 = 1)"
_FACTORS = f"""{_A}, s AS (SELECT utn, {", ".join(f"{_status(c)} AS {c}" for c in ("mode_a", "acad", "acid"))} FROM aligned WHERE pos),
u AS ({" UNION ALL ".join(f"SELECT utn, '{c}' AS requirement, {c} AS status FROM s" for c in ("mode_a", "acad", "acid"))}),
c AS (SELECT utn, requirement, count(*) FILTER (WHERE status = 'different') AS failed, count(*) FILTER (WHERE status IN ('same', 'different')) AS total FROM u GROUP BY ALL),
f AS (SELECT utn, requirement, coalesce(failed / nullif(sum(total) OVER (PARTITION BY requirement), 0), 0) AS factor FROM c)"""
# reports are defined by what comes before
_FLIGHTS_ALONE = "flights AS" + FLIGHTS.partition(", flights AS")[2]
_REBASED = lambda a, base: f"(({a}) - ({base}) + 180 - 360 * floor((({a}) - ({base}) + 180) / 360) - 180)"
_SIDES = lambda columns: ", ".join(f"CASE WHEN ok THEN {s}.{c} END AS {s}_{c}" for s in ("lo", "hi") for c in columns)
_NEAR = f"SELECT x.*, coalesce(x.t - lo.t <= {REACH} AND hi.t - x.t <= {REACH}, false) AS ok, {{}} FROM x ASOF LEFT JOIN y lo ON x.utn = lo.utn AND x.t >= lo.t ASOF LEFT JOIN y hi ON x.utn = hi.utn AND x.t <= hi.t"
_BESIDE = lambda columns: f"x AS (SELECT * FROM g WHERE source IN ('click', 'purchase')), y AS (SELECT * FROM g WHERE source = 'view'), n AS ({_NEAR.format(_SIDES(['t', *columns]))})"
_BY_SPEED = f"""WITH {FLIGHTS}, d AS (SELECT utn, t, CASE WHEN code % 3 = 0 THEN speed * 60 END AS own, (t - lag(t) OVER w) / {float(HOUR)}::DOUBLE AS dt, abs(mode_c - lag(mode_c) OVER w) AS dm, radians(lon - lag(lon) OVER w) * cos(radians(lag(lat) OVER w)) * 6371008.8::DOUBLE AS east, radians(lat - lag(lat) OVER w) * 6371008.8::DOUBLE AS north FROM flights WINDOW w AS (PARTITION BY utn ORDER BY t)),
b AS (SELECT utn, t, coalesce(dt > 0 AND dt BETWEEN 5e-1 AND 40 AND dm / dt > 9000, false) AS bm, coalesce(own > 9000, false) AS bo, NOT coalesce(own > 9000, false) AND coalesce(dt > 0 AND sqrt(east * east + north * north) / dt > 9000, false) AS bp FROM d),
a AS (SELECT utn, count(*) AS n_updates, (max(t) - min(t)) / {float(HOUR)}::DOUBLE AS du, count(*) FILTER (WHERE bm OR bo OR bp) AS n_dubious, count(*) FILTER (WHERE bm) AS n_mode_c, count(*) FILTER (WHERE bo) AS n_speed_own, count(*) FILTER (WHERE bp) AS n_speed_positions FROM b GROUP BY utn),
r AS (SELECT utn, n_updates, round(du, 6) AS duration, n_dubious, n_mode_c, n_speed_own, n_speed_positions, CASE WHEN n_updates < 30 THEN 'few updates' WHEN du < 240 THEN 'short' WHEN n_dubious > 2e-1 * n_updates THEN 'changes' END AS reason FROM a), s AS (SELECT *, reason IS NOT NULL AS is_dubious FROM r)"""
_MODE_STATUS = lambda m: f"CASE WHEN lo_{m} IS NULL AND hi_{m} IS NULL THEN 'no_ref_val' WHEN {m} IS NULL THEN 'no_tst' WHEN {m} = lo_{m} OR {m} = hi_{m} THEN 'same' ELSE 'different' END"
SQL = {
    "text_forms": f"""WITH {FLIGHTS} SELECT id, strftime(make_timestamp(t), '%Y-%m-%d') AS day, strftime(make_timestamp(t), '%H:%M:%S.%g') AS time, lpad(CAST(code AS VARCHAR), 4, '0') AS code_text, printf('%.2f', CAST(code AS DOUBLE)) AS fixed,
CASE WHEN speed * code = 0 THEN 0e0 ELSE sign(speed * code) * pow(10, round(log10(abs(speed * code)))) END AS power, (utn % 255 * 255 + code) // 255 AS area, (utn % 255 * 255 + code) % 255 AS own, id AS counter, code AS content, replace(concat_ws('_', source, acid), '_', '\\_') AS latex FROM flights""",
    "bearings_between": f"""WITH {FLIGHTS}, b AS (SELECT id, lon - 13 AS e, lat - 475e-1 AS n, angle - 180 AS a, speed - 280 AS z, degrees(atan2(lon - 13, lat - 475e-1)) AS way FROM flights WHERE lat IS NOT NULL AND lon IS NOT NULL),
c AS (SELECT *, {_REBASED("a", "way")} AS x, {_REBASED("z", "way")} AS y FROM b)
SELECT id, round(CASE WHEN sqrt(e * e + n * n) < 1e-6 THEN a WHEN (x >= 0) <> (y >= 0) THEN {_REBASED("x + (y - x) * 25e-2", "-way")} ELSE {_REBASED(f"a + {_REBASED('z', 'a')} * 25e-2", "0")} END, 6) AS bearing FROM c""",
    "altitude_fill_trusted": f"""WITH {FLIGHTS}, n AS (SELECT id, utn, t, CASE WHEN code % 3 <> 0 THEN mode_c END AS value, CASE WHEN code % 4 = 1 THEN mode_c + 7 END AS measured FROM flights), k AS (SELECT utn, t, coalesce(measured, value) AS value FROM n WHERE coalesce(measured, value) IS NOT NULL),
j AS (SELECT n.id, n.t, n.value, CASE WHEN n.t - lo.t < {REACH} THEN lo.t END AS lt, CASE WHEN n.t - lo.t < {REACH} THEN lo.value END AS lv, CASE WHEN hi.t - n.t < {REACH} THEN hi.t END AS ht, CASE WHEN hi.t - n.t < {REACH} THEN hi.value END AS hv
  FROM n ASOF LEFT JOIN k lo ON n.utn = lo.utn AND n.t >= lo.t ASOF LEFT JOIN k hi ON n.utn = hi.utn AND n.t <= hi.t)
SELECT id, round(CASE WHEN value IS NOT NULL THEN value WHEN lt = t THEN lv WHEN lt IS NOT NULL AND ht IS NOT NULL THEN lv + (hv - lv) * ((t - lt) / (ht - lt)) ELSE coalesce(lv, hv) END, 5) AS mode_c FROM j""",
    "reference_positions": f"""WITH {FLIGHTS}, g AS (SELECT id, utn, t, source, floor(lat * 10) / 10e0 AS lat, floor(lon * 10) / 10e0 AS lon, mode_c, speed FROM flights), {_BESIDE(["lat", "lon", "mode_c", "speed"])},
m AS (SELECT *, lo_t = t AS exact, CASE WHEN lo_t = t THEN 0e0 ELSE (t - lo_t) / (hi_t - lo_t) END AS share, lo_lat = hi_lat AND lo_lon = hi_lon AS still FROM n WHERE ok AND lo_lat IS NOT NULL AND lo_lon IS NOT NULL AND hi_lat IS NOT NULL AND hi_lon IS NOT NULL)
SELECT id, round(CASE WHEN still THEN lo_lat ELSE lo_lat + degrees(radians(hi_lat - lo_lat) * share) END, 8) AS lat, round(CASE WHEN still THEN lo_lon ELSE lo_lon + degrees(radians(hi_lon - lo_lon) * share) END, 8) AS lon,
round(CASE WHEN still THEN lo_mode_c ELSE coalesce(lo_mode_c + (hi_mode_c - lo_mode_c) * share, lo_mode_c, hi_mode_c) END, 4) AS mode_c, round(CASE WHEN exact THEN lo_speed WHEN NOT still THEN lo_speed + (hi_speed - lo_speed) * share END, 5) AS speed FROM m""",
    "dubious_by_speed": f"{_BY_SPEED} SELECT * FROM s",
    "dubious_target_ratio": f"{_BY_SPEED} SELECT utn % 4 AS k, count(*) AS n, count(*) FILTER (WHERE is_dubious) AS n_dubious, round(avg(duration) FILTER (WHERE is_dubious), 4) AS mean_dubious, round(avg(duration) FILTER (WHERE NOT is_dubious), 4) AS mean_other, round(count(*) FILTER (WHERE is_dubious) / count(*), 4) AS p_dubious FROM s GROUP BY 1",
    "modes_of_movement": f"""WITH {FLIGHTS}, g AS (SELECT id, utn, t, source, {", ".join(f"CASE WHEN code % {n} <> 0 THEN code // {d} % 4 END AS {m}" for m, (n, d) in MODES.items())} FROM flights), {_BESIDE(list(MODES))},
u AS ({" UNION ALL ".join(f"SELECT utn, '{m}' AS mode, {_MODE_STATUS(m)} AS status FROM n WHERE ok" for m in MODES)})
SELECT utn, mode, count(*) AS n_inside, count(*) FILTER (WHERE status = 'same') AS n_same, count(*) FILTER (WHERE status = 'different') AS n_different, count(*) FILTER (WHERE status = 'no_ref_val') AS n_no_ref_val, count(*) FILTER (WHERE status = 'no_tst') AS n_no_tst,
round(CASE WHEN count(*) FILTER (WHERE status IN ('same', 'different', 'no_tst')) > 0 THEN count(*) FILTER (WHERE status = 'same') / count(*) FILTER (WHERE status IN ('same', 'different', 'no_tst')) END, 9) AS p_correct FROM u GROUP BY ALL""",
    "fixed_transponders": f"""WITH {FLIGHTS}, k AS (SELECT n_nationkey AS n, n_nationkey % 4 = 0 OR n_nationkey % 6 = 0 AS placed FROM nation),
f AS (SELECT n + 1 AS number, CASE WHEN n % 3 <> 0 THEN n * 37 % 4096 END AS a, CASE WHEN n % 2 = 1 THEN n * 1009 END AS b, CASE WHEN n % 5 <> 0 THEN n * 10e0 END AS h, CASE WHEN placed THEN 47 + n * 4e-2 END AS y, CASE WHEN placed THEN 1302e-2 + n * 1e-2 END AS x FROM k),
m AS (SELECT r.id, min({{'number': f.number, 'h': f.h}}) AS first FROM flights r JOIN f ON (a IS NOT NULL OR b IS NOT NULL OR y IS NOT NULL) AND (a IS NULL OR coalesce(a = mode_a, false)) AND (b IS NULL OR coalesce(b = acad, false)) AND (y IS NULL OR coalesce(2 * 6371008.8::DOUBLE * asin(least(1e0, sqrt(pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lon) / 2), 2)))) <= 15000, false)) GROUP BY r.id),
o AS (SELECT r.id, m.first.number AS transponder, m.first.h AS h, m.id IS NOT NULL OR coalesce(mode_a = 4095, false) AS is_transponder FROM flights r LEFT JOIN m ON m.id = r.id) SELECT id, transponder, is_transponder, CASE WHEN is_transponder THEN coalesce(h, 0) END AS transponder_height FROM o""",
    "extra_data_in_sector": f"{_W}, {_PERIODS}, {_FLIGHTS_ALONE}, c AS (SELECT r.utn, EXISTS (SELECT 1 FROM periods p WHERE p.utn = r.utn AND r.t BETWEEN period_begin AND period_end) AS ok FROM flights r WHERE source = 'click' AND coalesce({_INSIDE}, false)) SELECT utn, count(*) FILTER (WHERE NOT ok) AS n_extra, count(*) FILTER (WHERE ok) AS n_ok, round(count(*) FILTER (WHERE NOT ok) / count(*), 9) AS p_extra FROM c GROUP BY utn",
    "interest_by_requirement": f"{_FACTORS} SELECT utn, requirement, round(factor, 9) AS factor, CASE WHEN factor >= 5e-2 THEN 2 WHEN factor >= 1e-2 THEN 1 ELSE 0 END AS interest FROM f",
    "interest_of_targets": f"{_FACTORS}, t AS (SELECT utn, sum(factor) AS factor FROM f GROUP BY utn) SELECT utn, round(factor, 7) AS factor, CASE WHEN factor >= 1e-1 THEN 2 WHEN factor >= 5e-2 THEN 1 ELSE 0 END AS interest FROM t",
    "surroundings_of_each": f"""WITH {FLIGHTS}, m AS (SELECT utn AS of, min(t) - {HOUR} AS t0, max(t) + {HOUR} AS t1, min(mode_c) - 300 AS h0, max(mode_c) + 300 AS h1, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM flights WHERE utn % 20 = 3 AND code % 4 = 1 GROUP BY utn),
w AS (SELECT *, least(1e-1, (a1 - a0) * 1e-1) AS wa, least(1e-1, (o1 - o0) * 1e-1) AS wo FROM m)
SELECT f.id, count(*) AS n_targets FROM flights f JOIN w ON f.t BETWEEN t0 AND t1 AND (h0 IS NULL OR mode_c IS NULL OR mode_c BETWEEN h0 AND h1) AND (a0 IS NULL OR coalesce(lat BETWEEN a0 - wa AND a1 + wa, false)) AND (o0 IS NULL OR coalesce(lon BETWEEN o0 - wo AND o1 + wo, false)) GROUP BY f.id""",
    "target_categories": f"WITH {FLIGHTS}, s AS (SELECT utn, min(acad) AS address, max(acid) AS name, max(mode_c) AS top, max(code % 7) AS emitter FROM flights GROUP BY utn) SELECT utn, CASE WHEN address IN (0, 1009) OR name IN ('TGT7', 'TGT11', 'TGT99') THEN 'vehicle' WHEN (utn % 3 = 0 AND emitter BETWEEN 1 AND 5) OR top >= 1000 THEN 'aircraft' ELSE 'unknown' END AS category FROM s",
    "accuracy_step": f"WITH {FLIGHTS}, p AS (SELECT source, lat, lon, avg(lat) OVER (PARTITION BY utn) AS fx, avg(lon) OVER (PARTITION BY utn) AS fy FROM flights WHERE lat IS NOT NULL) SELECT source, round(sqrt(avg(((lat - fx) * (lat - fx) + (lon - fy) * (lon - fy)) / 2 + 1e-4)), 9) AS sigma, count(*) AS n FROM p GROUP BY source",
}
