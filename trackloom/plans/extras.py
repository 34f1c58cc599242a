"""Queries of filters by target, source and selection, of further aggregates, of positions and of views; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import aggregates as A
from trackloom.operators import filters as P
from trackloom.operators import spatial as G
from trackloom.operators import timeline as L
from trackloom.operators import views as V
from trackloom.plans.common import FLIGHTS, HOUR, flights, table

DAY0 = 1704067200_000000
FIELD = G.Sector("field", ((47.0, 13.0), (48.1, 13.1), (47.9, 13.45), (47.1, 13.4)))


def filter_primary_only(spark, sf):
    f = flights(spark, sf).withColumn("kind", F.when(F.col("code") % 9 != 0, F.col("code") % 8))
    return f.where(P.primary_only(["mode_a", "acid"], "kind")).select("id")


def filter_addresses(spark, sf):
    return flights(spark, sf).where(P.codes("acad", "3F1,7E2,bd3,NULL", 16)).select("id", "acad")


def filter_targets(spark, sf):
    f = flights(spark, sf)
    with_key, without = P.of_target(f, "utn", [1, 5, 9]), P.of_target(f, "no_such_column", [1], null=True)
    return f.where(with_key & without).select("id", "utn")


def filter_chain(spark, sf):
    c = [("AND", P.compare("speed", ">=", 400)), ("AND", P.compare("code", "<", 50)), ("OR", P.compare("angle", ">=", 5.0, absolute=True) & P.compare("code", "IN", [7, None]))]
    return flights(spark, sf).where(P.chain(c)).select("id")


def filter_heights(spark, sf):
    f = flights(spark, sf).withColumn("other_height", F.when(F.col("code") % 3 != 0, F.col("mode_c") + 500))
    return f.where(P.heights(f, ["mode_c", "other_height", "not_there"], 10000, 30000, null=True)).select("id")


def import_filtered(spark, sf):
    f = flights(spark, sf).withColumn("tod", F.pmod(F.floor(F.col("t") / 1_000_000), F.lit(86400)).cast("double"))
    f = L.override_tod(f, "tod", 3600.0, 80000.0)
    kept = P.import_filter(f, ("tod", 1000.0, 50000.0), ("lat", "lon", 47.2, 47.9, 13.05, 13.4), ("mode_c", 2000, 40000))
    return L.not_in_future(kept, "t", F.lit(DAY0 + 600 * HOUR), 3 * HOUR).select("id", F.round("tod", 3).alias("tod"))


def selected_rows(spark, sf):
    f = flights(spark, sf)
    return P.selection_flag(f, f.where("code = 42"), "id").groupBy("source", "selected").agg(F.count("*").alias("n"))


def enabled_lines(spark, sf):
    f = flights(spark, sf)
    known = spark.createDataFrame([("click", 0, "Radar", True), ("click", 1, "Radar", False), ("view", 0, "ADSB", True), ("view", 1, "ADSB", True), ("error", 0, "MLAT", True)], "source string, line long, type string, wanted boolean")
    return P.enabled(f, known, ["Radar", "ADSB"], ["source", "line"]).groupBy("source", "line").agg(F.count("*").alias("n"))


def ground_only_sources(spark, sf):
    return flights(spark, sf).select("id", P.on_ground("ground", "source", ["signup"]).alias("on_ground"))


def evaluation_load(spark, sf):
    f = flights(spark, sf)
    contents = {s: f.where(F.col("source") == s) for s in ("click", "view", "error")}
    kept = P.evaluation_load(contents, "view", "click", "t", (DAY0 + 100 * HOUR, DAY0 + 500 * HOUR), "utn", range(0, 40), {"view": F.col("speed") < 500})
    return kept["view"].unionByName(kept["click"]).select("id", "source")


def _summaries(spark, sf):
    f = flights(spark, sf)
    return f.groupBy("utn").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("duration"), (F.count("acad") == 0).alias("primary"), (F.count_if(F.col("acad").isNotNull() & (F.col("code") > 3)) > 0).alias("mode_s"), F.collect_set("mode_a").alias("codes"), F.max("mode_c").alias("top"), F.collect_set("acad").alias("addresses"), (F.count_if(F.col("source") == "view") > 0).alias("seen"))


def target_use(spark, sf):
    reason = P.target_reasons("codes", 3, 300 * HOUR, "primary", "mode_s", "top", "duration", "n", ([74, (100, 140)], True), 45000.0, "seen", "addresses", ([1009 * i for i in range(7)], True))
    return _summaries(spark, sf).select("utn", reason.alias("reason"))


def excluded_requirements(spark, sf):
    results = flights(spark, sf).select("utn", F.col("source").alias("requirement")).distinct()
    excluded = results.where("(utn % 3 = 0 and requirement = 'click') or (utn % 5 = 0 and requirement = 'view')")
    return P.without_requirements(results, excluded, "utn", "requirement")


def values_with_indexes(spark, sf):
    out = A.values_with_indexes(flights(spark, sf), "mode_a", "id", 3)
    return out.select("mode_a", "n", F.array_join(F.transform("indexes", lambda x: x.cast("string")), ",").alias("indexes"))


def null_indexes(spark, sf):
    return A.null_indexes(flights(spark, sf), "acid", "id")


def unique_values(spark, sf):
    return A.unique_values(flights(spark, sf), "mode_a", "id")


def trimmed_mean(spark, sf):
    out = A.top_trimmed_mean(flights(spark, sf), ["source"], "speed", 0.1)
    return out.select("source", F.round("mean", 6).alias("mean"), "n")


def weighted_deviation(spark, sf):
    f = flights(spark, sf).withColumn("w", 1 + F.col("code"))
    return A.weighted_deviation(f, ["source"], "speed", "w").select("source", F.round("mean", 6).alias("mean"), F.round("stddev", 5).alias("stddev"))


def contents_extent(spark, sf):
    f = flights(spark, sf)
    return A.extent([f.where("source = 'view'"), f.where("source = 'click'").drop("lat", "lon")], "t", "lat", "lon")


def target_details(spark, sf):
    out = A.target_details(flights(spark, sf), "utn", "t", {"codes": "mode_a", "names": "acid"}, "lat", "lon", "mode_c", F.col("acad").isNull())
    return out.withColumn("codes", F.array_join("codes", ",")).withColumn("names", F.array_join("names", ","))


def minimum_height(spark, sf):
    ok = G.above_minimum_height([(FIELD, 20000.0)], F.col("lat"), F.col("lon"), F.col("mode_c"))
    return flights(spark, sf).where("lat is not null").select("id", ok.alias("above"))


def sensor_coverage(spark, sf):
    ok = G.covered([(47.3, 13.2, 30000.0), (47.8, 13.3, 15000.0)], F.col("lat"), F.col("lon"))
    return flights(spark, sf).where("lat is not null").select("id", ok.alias("covered"))


def filled_positions(spark, sf):
    """Plots of which some have range and azimuth only; the sources are radars."""
    f = flights(spark, sf).select("id", "source", "lat", "lon", (5000 + F.col("speed") * 100).alias("slant"), F.col("angle").alias("azimuth"), "mode_c")
    radars = spark.createDataFrame([("click", 47.1, 13.1, 100.0), ("view", 47.6, 13.4, 300.0)], "source string, lat double, lon double, altitude double")
    out = G.fill_positions(f, radars, "source", "slant", "azimuth", "mode_c")
    return out.select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def positions_and_back(spark, sf):
    """Positions to range and azimuth of a radar, and through the local plane back."""
    f = flights(spark, sf).where("lat is not null and mode_c is not null")
    site = (F.lit(47.2), F.lit(13.1), F.lit(150.0))
    slant, azimuth = S.position_to_polar(site[0], site[1], F.col("lat"), F.col("lon"), F.col("mode_c") * S.FOOT, site[2])
    f = f.withColumn("slant", slant).withColumn("azimuth", azimuth)
    east, north = S.local_offset(site[0], site[1], F.col("lat"), F.col("lon"))
    back_lat, back_lon = S.local_to_position(site[0], site[1], east, north)
    return f.select("id", F.round("slant", 3).alias("slant"), F.round("azimuth", 6).alias("azimuth"), F.round(back_lat, 9).alias("lat"), F.round(back_lon, 9).alias("lon"))


def chosen_histograms(spark, sf):
    f = flights(spark, sf)
    parts = [V.choose_histogram(f, c, 20).withColumn("of", F.lit(c)) for c in ("source", "track", "code", "speed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def feature_histograms(spark, sf):
    f = flights(spark, sf).withColumn("climb", F.col("mode_c") - 20000)
    return V.feature_histograms(f, {"speed": "speed", "climb": "climb"}, ["track"], 10)


def feature_grids(spark, sf):
    out = V.feature_grids(flights(spark, sf), {"speed": "speed", "height": "mode_c"}, "lat", "lon", (47.0, 48.0, 13.0, 13.5), (8, 8))
    return out.select("feature", "cx", "cy", "n", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), F.round("mean", 5).alias("mean"), F.round("stddev", 4).alias("stddev"))


def grid_drops(spark, sf):
    return V.dropped_of_grid(flights(spark, sf), "lat", "lon", (47.2, 47.8, 13.1, 13.4))


def scatter_series(spark, sf):
    return V.scatter(flights(spark, sf), ["source"], "speed", "mode_c")


def surrounding_data(spark, sf):
    f = flights(spark, sf)
    out = V.surroundings(f, f.where("utn = 3"), "t", "mode_c", 60_000_000, 300.0, ("lat", "lon"), ("mode_a", "acad"))
    return out.select("id", "utn")


def text_functions(spark, sf):
    p = table(spark, sf, "part").withColumn("text", F.concat(F.col("p_size").cast("string"), F.lit(" of "), "p_name", F.lit(" "), (F.col("p_partkey") % 7).cast("string")))
    host, port = S.address_parts(F.concat(F.lit("radar"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit(":5010")).otherwise(F.lit(""))))
    newer = S.version_key(F.concat_ws(".", (F.col("p_size") % 4).cast("string"), F.col("p_size").cast("string"))) > F.array(F.lit(2), F.lit(9))
    return p.select(
        "p_partkey", S.is_number(F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_retailprice").cast("string"))).alias("number"), S.leading_int(F.col("text")).alias("leading"), S.trailing_int(F.col("text")).alias("trailing"),
        S.percent_text(F.col("p_size") / 37.0).alias("share"), host.alias("host"), port.alias("port"), newer.alias("newer"), F.round(S.to_precision(F.col("p_retailprice"), 0.25), 2).alias("rounded"),
    )


def masked_identities(spark, sf):
    """The codes of reports and their masks: one to one, all in range, the same each time, others with another key."""
    codes = flights(spark, sf).where("mode_a is not null").select("mode_a", S.pseudonym(F.col("mode_a"), "key", 12).alias("masked"), S.pseudonym(F.col("mode_a"), "other", 12).alias("other"))
    both = codes.groupBy("mode_a").agg(F.count_distinct("masked").alias("n"), F.min("masked").alias("masked"), F.min("other").alias("other"), F.count("*").alias("reports"))
    moved = lambda a, b: F.count_if(F.col(a) != F.col(b)) * 2 > F.count("*")
    return both.agg(F.count("*").alias("n_codes"), F.count_distinct("masked").alias("n_masked"), F.max("n").alias("masks_a_code"), F.sum("reports").alias("n"), (F.count_if(F.col("masked").between(0, 4095)) == F.count("*")).alias("in_range"), moved("masked", "other").alias("keyed"), moved("masked", "mode_a").alias("moved"))


def position_accuracy(spark, sf):
    sigma = S.accuracy_sigma(F.col("code") % 4, F.col("code") % 11, F.col("code") % 14)
    return flights(spark, sf).select("id", F.round(sigma, 6).alias("sigma"), S.velocity_sigma(F.col("code") % 6).alias("sigma_v"))


def vectors(spark, sf):
    east, north = S.bearing_vector(F.col("speed"), F.col("angle"))
    return flights(spark, sf).select("id", F.round(east, 6).alias("east"), F.round(north, 6).alias("north"), S.measured_time("mode_a", "acad", "id").alias("first_known"))


_W = f"WITH {FLIGHTS}"
_EDGES = list(zip(FIELD.corners, FIELD.corners[1:] + FIELD.corners[:1], strict=True))


def _inside(x: str, y: str) -> str:
    box = f"{x} BETWEEN 47.0::DOUBLE AND 48.1::DOUBLE AND {y} BETWEEN 13.0::DOUBLE AND 13.45::DOUBLE"
    crossed = " + ".join(f"(({y1}::DOUBLE > {y}) <> ({y2}::DOUBLE > {y}) AND {x} < ({x2}::DOUBLE - {x1}::DOUBLE) * ({y} - {y1}::DOUBLE) / ({y2}::DOUBLE - {y1}::DOUBLE) + {x1}::DOUBLE)::INT" for (x1, y1), (x2, y2) in _EDGES if y1 != y2)
    return f"({box} AND ({crossed}) % 2 = 1)"


def _within(a: float, b: float, metres: float) -> str:
    h = f"pow(sin(radians(lat - {a}::DOUBLE) / 2), 2) + cos(radians({a}::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - {b}::DOUBLE) / 2), 2)"
    return f"2 * 6371008.8::DOUBLE * asin(least(sqrt({h}), 1)) <= {metres}"


_R8 = "6371008.8::DOUBLE"
_BIN = lambda c, n, by="": f"CASE WHEN {c} IS NULL THEN NULL ELSE least(floor(({c} - lo) / ((hi - lo) / {n})), {n} - 1)::BIGINT END"
_CASES = lambda of, table: f"CASE {of} " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in table.items()) + " END"
SQL = {
    "filter_primary_only": f"{_W} SELECT id FROM flights WHERE mode_a IS NULL AND acid IS NULL AND (code % 9 = 0 OR code % 8 IN (1, 3, 6, 7))",
    "filter_addresses": f"{_W} SELECT id, acad FROM flights WHERE acad IN (1009, 2018, 3027) OR acad IS NULL",
    "filter_targets": f"{_W} SELECT id, utn FROM flights WHERE utn IN (1, 5, 9)",
    "filter_chain": f"{_W} SELECT id FROM flights WHERE (speed >= 400 AND code < 50) OR (abs(angle) >= 5 AND (code = 7 OR code IS NULL))",
    "filter_heights": f"{_W}, o AS (SELECT id, mode_c, CASE WHEN code % 3 <> 0 THEN mode_c + 500 END AS other FROM flights) SELECT id FROM o WHERE (mode_c IS NULL OR mode_c BETWEEN 10000 AND 30000) AND (other IS NULL OR other BETWEEN 10000 AND 30000)",
    "import_filtered": f"{_W}, d AS (SELECT *, CAST(t // 1000000 % 86400 AS DOUBLE) AS x FROM flights), o AS (SELECT *, CASE WHEN x >= 80000 THEN (x + 3600) - 86400 * floor((x + 3600) / 86400) ELSE x END AS tod FROM d) SELECT id, round(tod, 3) AS tod FROM o WHERE tod BETWEEN 1000 AND 50000 AND (lat IS NULL OR lat BETWEEN 47.2::DOUBLE AND 47.9::DOUBLE) AND (lon IS NULL OR lon BETWEEN 13.05::DOUBLE AND 13.4::DOUBLE) AND (mode_c IS NULL OR mode_c BETWEEN 2000 AND 40000) AND t <= {DAY0 + 603 * HOUR}",
    "selected_rows": f"{_W} SELECT source, code = 42 AS selected, count(*) AS n FROM flights GROUP BY ALL",
    "enabled_lines": f"{_W} SELECT source, line, count(*) AS n FROM flights WHERE (source = 'click' AND line = 0) OR source = 'view' GROUP BY ALL",
    "ground_only_sources": f"{_W} SELECT id, CASE WHEN source = 'signup' THEN true ELSE ground END AS on_ground FROM flights",
    "evaluation_load": f"{_W} SELECT id, source FROM flights WHERE t BETWEEN {DAY0 + 100 * HOUR} AND {DAY0 + 500 * HOUR} AND utn < 40 AND (source = 'click' OR (source = 'view' AND speed < 500))",
    "target_use": f"""{_W}, s AS (SELECT utn, count(*) AS n, max(t) - min(t) AS duration, count(acad) = 0 AS only_primary, count(*) FILTER (WHERE acad IS NOT NULL AND code > 3) > 0 AS mode_s, count(*) FILTER (WHERE mode_a = 74 OR mode_a BETWEEN 100 AND 140) > 0 AS listed, max(mode_c) AS top, count(*) FILTER (WHERE acad IN (0, 1009, 2018, 3027, 4036, 5045, 6054)) > 0 AS by_address, count(*) FILTER (WHERE source = 'view') > 0 AS seen FROM flights GROUP BY utn)
SELECT utn, CASE WHEN n < 3 OR duration < {300 * HOUR} THEN 'short' WHEN only_primary THEN 'primary only' WHEN NOT mode_s THEN 'Mode A/C only' WHEN listed THEN 'Mode A code' WHEN top IS NULL THEN 'no Mode C' WHEN top < 45000 THEN 'Mode C too low' WHEN by_address THEN 'address' WHEN NOT seen THEN 'not detected' END AS reason FROM s""",
    "excluded_requirements": f"{_W} SELECT DISTINCT utn, source AS requirement FROM flights WHERE NOT (utn % 3 = 0 AND source = 'click') AND NOT (utn % 5 = 0 AND source = 'view')",
    "values_with_indexes": f"{_W}, r AS (SELECT mode_a, id, row_number() OVER (PARTITION BY mode_a ORDER BY id) AS k FROM flights WHERE mode_a IS NOT NULL) SELECT mode_a, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (WHERE k <= 3) AS indexes FROM r GROUP BY mode_a",
    "null_indexes": f"{_W} SELECT id FROM flights WHERE acid IS NULL",
    "unique_values": f"{_W} SELECT mode_a, min(id) AS first_index, count(*) AS n FROM flights WHERE mode_a IS NOT NULL GROUP BY mode_a",
    "trimmed_mean": f"{_W}, q AS (SELECT source, quantile_cont(speed, 0.9) AS most FROM flights GROUP BY source) SELECT source, round(avg(speed), 6) AS mean, count(*) AS n FROM flights JOIN q USING (source) WHERE speed <= most GROUP BY source",
    "weighted_deviation": f"{_W}, s AS (SELECT source, sum(1 + code) AS w, sum((1 + code) * speed) AS wv, sum((1 + code) * speed * speed) AS wvv FROM flights GROUP BY source) SELECT source, round(wv / w, 6) AS mean, round(sqrt(wvv / w - (wv / w) * (wv / w)), 5) AS stddev FROM s",
    "contents_extent": f"{_W} SELECT min(t) AS min_t, max(t) AS max_t, min(lat) FILTER (WHERE source = 'view') AS min_lat, max(lat) FILTER (WHERE source = 'view') AS max_lat, min(lon) FILTER (WHERE source = 'view') AS min_lon, max(lon) FILTER (WHERE source = 'view') AS max_lon FROM flights WHERE source IN ('view', 'click')",
    "target_details": f"{_W} SELECT utn, count(*) AS n_updates, max(t) - min(t) AS duration, coalesce(string_agg(DISTINCT mode_a::VARCHAR, ',' ORDER BY mode_a::VARCHAR), '') AS codes, coalesce(string_agg(DISTINCT acid, ',' ORDER BY acid), '') AS names, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, min(mode_c) AS min_mode_c, max(mode_c) AS max_mode_c, bool_and(acad IS NULL) AS primary_only FROM flights GROUP BY utn",
    "minimum_height": f"{_W} SELECT id, NOT coalesce({_inside('lat', 'lon')} AND mode_c < 20000, false) AS above FROM flights WHERE lat IS NOT NULL",
    "sensor_coverage": f"{_W} SELECT id, {_within(47.3, 13.2, 30000)} OR {_within(47.8, 13.3, 15000)} AS covered FROM flights WHERE lat IS NOT NULL",
    "filled_positions": f"""{_W}, p AS (SELECT id, lat, lon, angle, 5000 + speed * 100 AS slant, mode_c * 3048e-4 AS h, CASE source WHEN 'click' THEN 471e-1 WHEN 'view' THEN 476e-1 END AS la, CASE source WHEN 'click' THEN 131e-1 WHEN 'view' THEN 134e-1 END AS lo, CASE source WHEN 'click' THEN 1e2 WHEN 'view' THEN 3e2 END AS alt FROM flights),
g AS (SELECT *, sqrt(greatest(slant * slant - (coalesce(h, alt) - alt) * (coalesce(h, alt) - alt), 0)) AS ground FROM p)
SELECT id, round(CASE WHEN lat IS NULL THEN la + degrees(ground * cos(radians(angle)) / {_R8}) ELSE lat END, 9) AS lat, round(CASE WHEN lat IS NULL THEN lo + degrees(ground * sin(radians(angle)) / ({_R8} * cos(radians(la)))) ELSE lon END, 9) AS lon FROM g""",
    "positions_and_back": f"{_W}, o AS (SELECT id, lat, lon, radians(lon - 131e-1) * cos(radians(472e-1)) * {_R8} AS e, radians(lat - 472e-1) * {_R8} AS n, mode_c * 3048e-4 - 150 AS h FROM flights WHERE lat IS NOT NULL AND mode_c IS NOT NULL), a AS (SELECT *, degrees(atan2(e, n)) AS x FROM o) SELECT id, round(sqrt(e * e + n * n + h * h), 3) AS slant, round(CASE WHEN x < 0 THEN x + 360 ELSE x END, 6) AS azimuth, round(lat, 9) AS lat, round(lon, 9) AS lon FROM a",
    "chosen_histograms": f"""{_W}, b AS (SELECT min(speed) AS lo, max(speed) AS hi, min(code) AS c0, max(code) AS c1 FROM flights), n AS (SELECT CASE WHEN (c1 - c0) // 20 = 0 THEN greatest(1, c1 - c0) ELSE 20 END AS bins, CASE WHEN (c1 - c0) // 20 = 0 THEN 1 ELSE (c1 - c0) // 20 END AS step FROM b)
SELECT source AS bin, count(*) AS n, 'source' AS of FROM flights GROUP BY 1 UNION ALL SELECT track::VARCHAR, count(*), 'track' FROM flights GROUP BY 1
UNION ALL SELECT least((code - c0) // step, bins - 1)::VARCHAR, count(*), 'code' FROM flights, b, n GROUP BY 1 UNION ALL SELECT {_BIN("speed", 20)}::VARCHAR, count(*), 'speed' FROM flights, b GROUP BY 1""",
    "feature_histograms": f"{_W}, f AS (SELECT track, speed, mode_c - 20000 AS climb FROM flights), b AS (SELECT min(speed) AS lo, max(speed) AS hi FROM f), c AS (SELECT min(climb) AS lo, max(climb) AS hi FROM f) SELECT 'speed' AS feature, track, {_BIN('speed', 10)} AS bin, count(*) AS n FROM f, b GROUP BY ALL UNION ALL SELECT 'climb', track, {_BIN('climb', 10)}, count(*) FROM f, c GROUP BY ALL",
    "feature_grids": f"{_W}, k AS (SELECT CASE WHEN lat BETWEEN 47 AND 48 THEN least(floor((lat - 47) * 8), 7)::BIGINT END AS cx, CASE WHEN lon BETWEEN 13 AND 135e-1 THEN least(floor((lon - 13) * 16), 7)::BIGINT END AS cy, speed, mode_c FROM flights), v AS (SELECT 'speed' AS feature, cx, cy, speed AS v FROM k UNION ALL SELECT 'height', cx, cy, mode_c FROM k) SELECT feature, cx, cy, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 5) AS mean, round(stddev_pop(v), 4) AS stddev FROM v WHERE cx IS NOT NULL AND cy IS NOT NULL GROUP BY feature, cx, cy",
    "grid_drops": f"{_W}, i AS (SELECT coalesce(lat BETWEEN 47.2::DOUBLE AND 47.8::DOUBLE AND lon BETWEEN 13.1::DOUBLE AND 13.4::DOUBLE, false) AS ok FROM flights) SELECT count(*) FILTER (WHERE ok) AS n_inside, count(*) FILTER (WHERE NOT ok) AS n_dropped FROM i",
    "scatter_series": f"{_W} SELECT source, speed AS x, mode_c AS y FROM flights WHERE mode_c IS NOT NULL",
    "surrounding_data": f"""{_W}, m AS (SELECT min(t) AS t0, max(t) AS t1, min(mode_c) AS h0, max(mode_c) AS h1, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM flights WHERE utn = 3), k AS (SELECT * FROM flights WHERE utn = 3)
SELECT id, utn FROM flights, m WHERE t BETWEEN t0 - 60000000 AND t1 + 60000000 AND (mode_c IS NULL OR mode_c BETWEEN h0 - 300 AND h1 + 300) AND lat BETWEEN a0 - least(1e-1, (a1 - a0) * 1e-1) AND a1 + least(1e-1, (a1 - a0) * 1e-1) AND lon BETWEEN o0 - least(1e-1, (o1 - o0) * 1e-1) AND o1 + least(1e-1, (o1 - o0) * 1e-1)
AND (mode_a IS NULL OR mode_a IN (SELECT mode_a FROM k WHERE mode_a IS NOT NULL)) AND (acad IS NULL OR acad IN (SELECT acad FROM k WHERE acad IS NOT NULL))""",
    "text_functions": """SELECT p_partkey, NOT (p_size % 3 = 0) AS number, p_size::BIGINT AS leading, p_partkey % 7 AS trailing, printf('%.2f', p_size / 37.0::DOUBLE * 100) || ' %' AS share, 'radar' || p_size AS host, CASE WHEN p_size % 2 = 0 THEN 5010 END AS port,
(p_size % 4 > 2 OR (p_size % 4 = 2 AND p_size > 9)) AS newer, round(round(p_retailprice / 25e-2) * 25e-2, 2) AS rounded FROM part""",
    "masked_identities": f"{_W} SELECT count(DISTINCT mode_a) AS n_codes, count(DISTINCT mode_a) AS n_masked, 1::BIGINT AS masks_a_code, count(*) AS n, true AS in_range, true AS keyed, true AS moved FROM flights WHERE mode_a IS NOT NULL",
    "position_accuracy": f"{_W}, b AS (SELECT id, code, CASE WHEN code % 4 = 0 THEN {_CASES('code % 11', S.NUCP)} WHEN code % 4 IN (1, 2) THEN {_CASES('code % 14', S.NACP)} END AS bound FROM flights) SELECT id, round(CASE WHEN bound < 9 THEN bound / 2 ELSE bound / 25e-1 END, 6) AS sigma, {_CASES('code % 6', S.NACV)} AS sigma_v FROM b",
    "vectors": f"{_W} SELECT id, round(speed * sin(radians(angle)), 6) AS east, round(speed * cos(radians(angle)), 6) AS north, coalesce(mode_a, acad, id) AS first_known FROM flights",
}
