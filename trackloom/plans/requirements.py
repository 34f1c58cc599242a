"""Queries of requirements on identities, intervals and positions, each with SQL written from the stated rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.scalar import local_offset
from trackloom.operators import evaluation as E
from trackloom.operators import timeline as L
from trackloom.operators.tracking import spline_points as spline
from trackloom.plans.common import FLIGHTS, HOUR, INTERVAL, REACH, flights

SITE = (47.2, 13.1)
_REF = ["mode_a", "acad", "acid", "mode_c", "lat", "lon", "speed", "angle", "ground"]


def aligned(spark, sf):
    """Clicks and purchases as test reports, views as reference."""
    f = flights(spark, sf)
    tst = f.where("source in ('click', 'purchase')").select("id", "utn", "t", *_REF)
    return L.asof_neighbours(tst, f.where("source = 'view'"), "utn", "t", _REF, REACH)


def _sql_aligned() -> str:
    sides = ", ".join(f"CASE WHEN pos THEN {s}.{c} END AS {s}_{c}" for s in ("lo", "hi") for c in ["t", *_REF])
    return f"""WITH {FLIGHTS}, tst AS (SELECT * FROM flights WHERE source IN ('click', 'purchase')), ref AS (SELECT * FROM flights WHERE source = 'view'),
near AS (SELECT tst.*, lo.t AS lt, hi.t AS ht, coalesce(tst.t - lo.t <= {REACH} AND hi.t - tst.t <= {REACH}, false) AS pos FROM tst ASOF LEFT JOIN ref lo ON tst.utn = lo.utn AND tst.t >= lo.t ASOF LEFT JOIN ref hi ON tst.utn = hi.utn AND tst.t <= hi.t),
aligned AS (SELECT near.id, near.utn, near.t, {", ".join(f"near.{c}" for c in _REF)}, pos, {sides} FROM near LEFT JOIN ref lo ON lo.utn = near.utn AND lo.t = near.lt LEFT JOIN ref hi ON hi.utn = near.utn AND hi.t = near.ht)"""


def _status(column: str, tolerance: float = 0) -> str:
    same = lambda side: f"abs({column} - {side}_{column}) <= {tolerance}" if tolerance else f"{column} = {side}_{column}"
    return f"CASE WHEN NOT pos THEN 'no_ref_pos' WHEN lo_{column} IS NULL AND hi_{column} IS NULL THEN 'no_ref_val' WHEN {column} IS NULL THEN 'no_tst' WHEN {same('lo')} OR {same('hi')} THEN 'same' ELSE 'different' END"


def _statuses(spark, sf):
    a = aligned(spark, sf)
    return a.withColumns({f"s_{c}": L.compare_status(c, c, 0, F.col("matched")) for c in ("mode_a", "acad", "acid")})


_IDENTITIES = f"s AS (SELECT id, utn, t, pos, {', '.join(f'{_status(c)} AS s_{c}' for c in ('mode_a', 'acad', 'acid'))} FROM aligned)"
_THREE = ["s_mode_a", "s_acad", "s_acid"]


def identification_correct(spark, sf):
    s = _statuses(spark, sf).where("matched")
    one, every = (E.identification_correct(_THREE, need) for need in (False, True))
    return s.groupBy("utn").agg(F.count_if(one == "correct").alias("n_any"), F.count_if(one == "not_correct").alias("n_none"), F.count_if(every == "correct").alias("n_all"), F.count_if(one == "no_ref_val").alias("n_no_ref_val"))


def identification_false(spark, sf):
    """n_all and n_correct add up to the matched reports; n_unknown tells how many of n_correct had nothing to compare."""
    s = _statuses(spark, sf).where("matched")
    some, every = (E.identification_false(_THREE, need) for need in (False, True))
    return s.groupBy("utn").agg(F.count_if(some == "false").alias("n_any"), F.count_if(every == "false").alias("n_all"), F.count_if(every == "not_false").alias("n_correct"), F.count_if(~E.any_comparable(_THREE)).alias("n_unknown"))


def _periods(spark, sf):
    return L.periods(flights(spark, sf).where("source = 'view'"), "utn", "t", F.lit(True), 48 * HOUR, HOUR)


_PERIODS = f"""pm AS (SELECT utn, t, CASE WHEN t - lag(t) OVER (PARTITION BY utn ORDER BY t) <= {48 * HOUR} THEN 0 ELSE 1 END AS new FROM flights WHERE source = 'view'),
pn AS (SELECT utn, t, sum(new) OVER (PARTITION BY utn ORDER BY t) AS p FROM pm),
periods AS (SELECT utn, min(t) AS period_begin, max(t) AS period_end FROM pn GROUP BY utn, p HAVING max(t) - min(t) >= {HOUR})"""


def _intervals_sql(valid: str) -> str:
    return f"""{_sql_aligned()}, {_PERIODS}, long AS (SELECT * FROM periods WHERE period_end - period_begin >= {5 * HOUR}),
points AS (SELECT p.utn, period_begin, a.t AS x FROM long p JOIN aligned a ON a.utn = p.utn AND a.t BETWEEN period_begin AND period_end WHERE {valid}
  UNION ALL SELECT utn, period_begin, period_begin FROM long UNION ALL SELECT utn, period_begin, period_end FROM long),
gaps AS (SELECT utn, x - lag(x) OVER (PARTITION BY utn, period_begin ORDER BY x) AS gap FROM points),
m AS (SELECT utn, CAST(sum(CASE WHEN gap > {INTERVAL} THEN gap // {INTERVAL} ELSE 0 END) AS BIGINT) AS missed FROM gaps GROUP BY utn),
u AS (SELECT utn, CAST(sum((period_end - period_begin) // {INTERVAL}) AS BIGINT) AS sum_uis FROM long GROUP BY utn)
SELECT utn, sum_uis, missed, round(CASE WHEN sum_uis > 0 THEN 1 - missed / sum_uis END, 9) AS pd FROM u JOIN m USING (utn)"""


def _intervals(spark, sf, valid):
    return E.missed_intervals(_with_mode_c(spark, sf), _periods(spark, sf), "utn", "t", valid, INTERVAL, 5 * HOUR).withColumn("pd", F.round("pd", 9))


def _with_mode_c(spark, sf):
    return _statuses(spark, sf).withColumn("s_mode_c", L.compare_status("mode_c", "mode_c", 3000.0, F.col("matched")))


def identification_periods(spark, sf):
    """Updates whose address is the reference's, or that have no reference, count."""
    return _intervals(spark, sf, F.col("s_acad").isin("same", "no_ref_val", "no_ref_pos"))


def mode_c_periods(spark, sf):
    return _intervals(spark, sf, F.col("s_mode_c").isin("same", "no_ref_val", "no_ref_pos"))


def interval_detection(spark, sf):
    """Updates with a position at all are valid."""
    return _intervals(spark, sf, F.col("lat").isNotNull())


def generic_correct(spark, sf):
    """Whole numbers that must be equal and measures that must be near, one row for each kind."""
    a = aligned(spark, sf).where("matched")
    kinds = {"ground": 0, "mode_c": 2000.0, "speed": 60.0}
    rows = None
    for name, most in kinds.items():
        counts = E.status_counts(a.withColumn("status", L.compare_status(name, name, most)).withColumn("kind", F.lit(name)), ["kind"], "status")
        rows = counts if rows is None else rows.unionByName(counts)
    return E.correct_rate(rows).select("kind", "n_inside", "n_same", "n_different", "n_no_ref_val", "n_no_tst", F.round("p_correct", 9).alias("p_correct"))


def _errors(spark, sf):
    a = aligned(spark, sf).where("matched and lat is not null")
    a = a.withColumns({f"ref_{c}": L.interpolate(c, "t") for c in ("lat", "lon", "speed")}).withColumn("ref_angle", L.interpolate_angle("angle", "t"))
    return E.position_errors(a, "lat", "lon", "ref_lat", "ref_lon", "ref_angle", "ref_speed")


def _at(column: str) -> str:
    share = "((t - lo_t) / (hi_t - lo_t))"
    return f"CASE WHEN lo_t = t THEN lo_{column} ELSE coalesce(lo_{column} + (hi_{column} - lo_{column}) * {share}, lo_{column}, hi_{column}) END"


_TURN = "(hi_angle - lo_angle + 180 - 360 * floor((hi_angle - lo_angle + 180) / 360) - 180)"
_ERRORS = f"""{_sql_aligned()}, m AS (SELECT *, {_at("lat")} AS ref_lat, {_at("lon")} AS ref_lon, {_at("speed")} AS ref_speed, CASE WHEN lo_t = t THEN lo_angle ELSE lo_angle + {_TURN} * ((t - lo_t) / (hi_t - lo_t)) END AS ref_angle FROM aligned WHERE pos AND lat IS NOT NULL),
o AS (SELECT *, radians(lon - ref_lon) * cos(radians(ref_lat)) * 6371008.8::DOUBLE AS east, radians(lat - ref_lat) * 6371008.8::DOUBLE AS north FROM m),
e AS (SELECT *, sqrt(east * east + north * north) AS d, sqrt(east * east + north * north) * cos(radians(90 - ref_angle) - atan2(north, east)) AS d_along, sqrt(east * east + north * north) * sin(radians(90 - ref_angle) - atan2(north, east)) AS d_across FROM o)"""


def _rate(df, value: str, passed):
    out = E.passed_rate(df, ["utn"], value, passed)
    return out.select("utn", "n_passed", "n_failed", *(F.round(c, 4).alias(c) for c in ("min", "max", "mean", "rms", "stddev")), F.round("p_passed", 9).alias("p_passed"))


def _rate_sql(value: str, passed: str) -> str:
    return f"""{_ERRORS}, v AS (SELECT utn, {value} AS v FROM e) SELECT utn, count(*) FILTER (WHERE {passed}) AS n_passed, count(*) FILTER (WHERE NOT {passed}) AS n_failed, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean,
round(sqrt(avg(v * v)), 4) AS rms, round(stddev_pop(v), 4) AS stddev, round(count(*) FILTER (WHERE {passed}) / count(*), 9) AS p_passed FROM v WHERE v IS NOT NULL GROUP BY utn"""


def position_distance(spark, sf):
    return _rate(_errors(spark, sf), "d", F.col("d") <= 9000)


def position_along(spark, sf):
    return _rate(_errors(spark, sf), "d_along", F.abs("d_along") <= 6000)


def position_across(spark, sf):
    return _rate(_errors(spark, sf), "d_across", F.abs("d_across") <= 6000)


def position_latency(spark, sf):
    return _rate(_errors(spark, sf), "latency", F.abs("latency") <= 20)


def position_distance_rms(spark, sf):
    """The root mean square over all targets, from their sums."""
    per = _errors(spark, sf).groupBy("utn").agg(F.count("d").alias("n"), F.sum(F.col("d") * F.col("d")).alias("squares"))
    out = E.roll_up(per, [], ["n", "squares"])
    return out.select("n_targets", "n", F.round(F.sqrt(F.col("squares") / F.col("n")), 4).alias("rms"))


def _radar(spark, sf):
    e = E.radar_view(_errors(spark, sf), SITE, "lat", "lon", "tst")
    return E.radar_view(e, SITE, "ref_lat", "ref_lon", "ref").withColumn("k", F.col("utn") % 4)


_RADAR = _ERRORS + "".join(
    f", {p} AS (SELECT *, sqrt(x{p} * x{p} + y{p} * y{p}) AS {p}_range, atan2(x{p}, y{p}) AS {p}_azimuth FROM (SELECT *, radians({lon} - {SITE[1]}::DOUBLE) * cos(radians({SITE[0]}::DOUBLE)) * 6371008.8::DOUBLE AS x{p}, radians({lat} - {SITE[0]}::DOUBLE) * 6371008.8::DOUBLE AS y{p} FROM {of}))"
    for p, of, lat, lon in (("t1", "e", "lat", "lon"), ("r1", "t1", "ref_lat", "ref_lon"))
)


def radar_range(spark, sf):
    out = E.linear_fit(_radar(spark, sf), ["k"], "tst_range", "ref_range")
    return out.select("k", "n", F.round("gain", 5).alias("gain"), F.round("bias", 1).alias("bias"), F.round("mean_diff", 3).alias("mean_diff"))


def radar_azimuth(spark, sf):
    a = _radar(spark, sf).withColumn("turn", E.azimuth_difference(F.col("ref_azimuth"), F.col("tst_azimuth")))
    return a.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("turn"), 5).alias("mean_turn"), F.count_if(F.abs("turn") <= 10).alias("n_passed"))


def extra_track_rate(spark, sf):
    f = flights(spark, sf)
    tracks = f.groupBy("utn", "track").agg(F.min("t").alias("period_begin"), F.max("t").alias("period_end")).where("track = 0")
    return E.extra_track_rate(f, E.extra_tracks(f, tracks, "utn", "t", "track"), "utn", "id").withColumn("p_extra", F.round("p_extra", 9))


def extra_data_ignoring(spark, sf):
    """R21 with the rules on targets: few updates, short, primary only."""
    f = flights(spark, sf)
    gone = E.ignored_targets(f, "utn", "t", F.col("utn") % 11 == 0, 60, 700 * HOUR)
    return E.extra_data(f.where("source = 'click'").select("utn", "t"), _periods(spark, sf), "utn", "t", gone).withColumn("p_extra", F.round("p_extra", 9))


def dubious_tracks(spark, sf):
    f = flights(spark, sf)
    rules = {"limits": {"speed": 40.0, "angle": 30.0}, "second": float(HOUR), "least_updates": 3, "least_duration": 10.0, "most_share": 0.3, "angles": ("angle",), "primary": F.col("acad").isNull(), "largest": {"speed": 560.0}}
    return E.dubious_tracks(f, "utn", "track", "t", 24 * HOUR, **rules).withColumn("duration", F.round("duration", 6))


def dubious_track_ratio(spark, sf):
    out = E.dubious_ratio(dubious_tracks(spark, sf), ["track"])
    return out.select("track", "n", "n_dubious", *(F.round(c, 4).alias(c) for c in ("mean_dubious", "mean_other", "p_dubious")))


def interpolated_positions(spark, sf):
    """Positions between two reports in the local frame of the one before."""
    a = aligned(spark, sf).where("matched and lo.lat is not null and hi.lat is not null")
    share = F.when(F.col("exact"), 0.0).otherwise((F.col("t") - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t")))
    east, north = local_offset(F.col("lo.lat"), F.col("lo.lon"), F.col("hi.lat"), F.col("hi.lon"))
    return a.select("id", F.round(east * share, 4).alias("east"), F.round(north * share, 4).alias("north"))


def neighbour_ground(spark, sf):
    return aligned(spark, sf).where("matched").select("id", L.neighbour_flag("ground").alias("ground"))


def nearest_point(spark, sf):
    f = flights(spark, sf)
    got = L.nearest_at(f.where("source = 'view'").select("utn", "t", "speed"), f.where("source = 'click'").select("id", "utn", "t"), "utn", "t", ["speed"], REACH)
    return got.select("id", "index", F.col("speed").alias("last_speed"))


def positions_between(spark, sf):
    f = flights(spark, sf)
    spans = f.groupBy("utn").agg((F.min("t") + 100 * HOUR).alias("begin"), (F.min("t") + 200 * HOUR).alias("end"))
    return L.positions_between(f.select("id", "utn", "t"), spans, "utn", "t").select("id", "begin")


def spline_points(spark, sf):
    """Every two hours between reports at most two days apart."""
    out = spline(flights(spark, sf).where("lat is not null"), ["utn"], "t", ["lat", "lon"], 2 * HOUR, 48 * HOUR)
    return out.select("utn", "at", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


def _cubic(c: str) -> str:
    line = f"(x1.{c} - x0.{c}) / x0.gap"
    m0 = f"CASE WHEN x0.before THEN (x1.{c} - x0.b_{c}) / (x1.t - x0.bt) ELSE {line} END * gap"
    m1 = f"CASE WHEN x0.beyond THEN (x0.f_{c} - x0.{c}) / (x0.ft - x0.t) ELSE {line} END * gap"
    return f"(2*s*s*s - 3*s*s + 1) * x0.{c} + (s*s*s - 2*s*s + s) * ({m0}) + (3*s*s - 2*s*s*s) * x1.{c} + (s*s*s - s*s) * ({m1})".replace("x1.t", "x0.nt").replace(f"x1.{c}", f"x0.n_{c}")


_SPLINE = f"""WITH {FLIGHTS}, r AS (SELECT utn, t, lat, lon, lag(t) OVER w AS bt, lag(lat) OVER w AS b_lat, lag(lon) OVER w AS b_lon, lead(t) OVER w AS nt, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon, lead(t, 2) OVER w AS ft, lead(lat, 2) OVER w AS f_lat, lead(lon, 2) OVER w AS f_lon FROM flights WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY utn ORDER BY t)),
p AS (SELECT *, CAST(nt - t AS DOUBLE) AS gap, coalesce(t - bt <= {48 * HOUR}, false) AS before, coalesce(ft - nt <= {48 * HOUR}, false) AS beyond FROM r WHERE nt - t <= {48 * HOUR}),
g AS (SELECT *, unnest(range((t + {2 * HOUR - 1}) // {2 * HOUR}, CASE WHEN beyond THEN (nt + {2 * HOUR - 1}) // {2 * HOUR} ELSE nt // {2 * HOUR} + 1 END)) AS i FROM p), x0 AS (SELECT *, i * {2 * HOUR} AS "at", (i * {2 * HOUR} - t) / gap AS s FROM g)"""
_TRACKS = f"""WITH {FLIGHTS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY utn, track ORDER BY t) <= {24 * HOUR} THEN 0 ELSE 1 END AS new FROM flights),
h AS (SELECT *, CAST(sum(new) OVER (PARTITION BY utn, track ORDER BY t) AS BIGINT) AS session FROM g),
d AS (SELECT *, (t - lag(t) OVER w) / {float(HOUR)}::DOUBLE AS dt, speed - lag(speed) OVER w AS ds, angle - lag(angle) OVER w + 180 AS da FROM h WINDOW w AS (PARTITION BY utn, track, session ORDER BY t)),
b AS (SELECT *, coalesce(dt > 0 AND abs(ds) / dt > 40, false) AS bs, coalesce(dt > 0 AND abs(da - 360 * floor(da / 360) - 180) / dt > 30, false) AS ba, coalesce(abs(speed) > 560, false) AS bl FROM d),
a AS (SELECT utn, track, session, count(*) AS n_updates, (max(t) - min(t)) / {float(HOUR)}::DOUBLE AS du, bool_and(acad IS NULL) AS only_primary, count(*) FILTER (WHERE bs OR ba OR bl) AS n_dubious, count(*) FILTER (WHERE bs) AS n_speed, count(*) FILTER (WHERE ba) AS n_angle, count(*) FILTER (WHERE bl) AS n_large_speed FROM b GROUP BY utn, track, session),
r AS (SELECT utn, track, session, n_updates, du, n_dubious, n_speed, n_angle, n_large_speed, CASE WHEN only_primary THEN 'primary only' WHEN n_updates < 3 THEN 'few updates' WHEN du < 10 THEN 'short' WHEN n_dubious > 0.3::DOUBLE * n_updates THEN 'changes' END AS reason FROM a)"""
_A = _sql_aligned()
_VALID = lambda column, tolerance=0: f"({_status(column, tolerance)}) IN ('same', 'no_ref_val', 'no_ref_pos')"
SQL = {
    "spline_points": f"{_SPLINE} SELECT utn, \"at\", round({_cubic('lat')}, 7) AS lat, round({_cubic('lon')}, 7) AS lon FROM x0",
    "identification_correct": f"""{_A}, {_IDENTITIES} SELECT utn, count(*) FILTER (WHERE NOT none_known AND fine > 0) AS n_any, count(*) FILTER (WHERE NOT none_known AND fine = 0) AS n_none, count(*) FILTER (WHERE NOT none_known AND fine = 3) AS n_all, count(*) FILTER (WHERE none_known) AS n_no_ref_val
FROM (SELECT utn, s_mode_a = 'no_ref_val' AND s_acad = 'no_ref_val' AND s_acid = 'no_ref_val' AS none_known, (s_mode_a IN ('same', 'no_ref_val'))::INT + (s_acad IN ('same', 'no_ref_val'))::INT + (s_acid IN ('same', 'no_ref_val'))::INT AS fine FROM s WHERE pos) GROUP BY utn""",
    "identification_false": f"""{_A}, {_IDENTITIES} SELECT utn, count(*) FILTER (WHERE bad > 0) AS n_any, count(*) FILTER (WHERE bad = 3) AS n_all, count(*) FILTER (WHERE bad < 3) AS n_correct, count(*) FILTER (WHERE bad = 0 AND good = 0) AS n_unknown
FROM (SELECT utn, {" + ".join(f"({s} = 'same')::INT" for s in _THREE)} AS good, {" + ".join(f"({s} = 'different')::INT" for s in _THREE)} AS bad FROM s WHERE pos) GROUP BY utn""",
    "identification_periods": _intervals_sql(_VALID("acad")),
    "mode_c_periods": _intervals_sql(_VALID("mode_c", 3000)),
    "interval_detection": _intervals_sql("lat IS NOT NULL"),
    "generic_correct": f"{_A}, k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS kind, {_status(c, m)} AS status FROM aligned WHERE pos" for c, m in (("ground", 0), ("mode_c", 2000), ("speed", 60))) + """)
SELECT kind, count(*) AS n_inside, count(*) FILTER (WHERE status = 'same') AS n_same, count(*) FILTER (WHERE status = 'different') AS n_different, count(*) FILTER (WHERE status = 'no_ref_val') AS n_no_ref_val, count(*) FILTER (WHERE status = 'no_tst') AS n_no_tst,
round(count(*) FILTER (WHERE status = 'same') / count(*) FILTER (WHERE status IN ('same', 'different', 'no_tst')), 9) AS p_correct FROM k GROUP BY kind""",
    "position_distance": _rate_sql("d", "v <= 9000"),
    "position_along": _rate_sql("d_along", "abs(v) <= 6000"),
    "position_across": _rate_sql("d_across", "abs(v) <= 6000"),
    "position_latency": _rate_sql("CASE WHEN d > 0 AND ref_speed > 0 THEN -d_along / ref_speed END", "abs(v) <= 20"),
    "position_distance_rms": f"{_ERRORS} SELECT count(DISTINCT utn) AS n_targets, CAST(count(d) AS BIGINT) AS n, round(sqrt(sum(d * d) / count(d)), 4) AS rms FROM e",
    "radar_range": f"{_RADAR} SELECT utn % 4 AS k, count(*) AS n, CASE WHEN count(*) > 1 THEN round(regr_slope(r1_range, t1_range), 5) END AS gain, round(regr_intercept(r1_range, t1_range), 1) AS bias, round(avg(t1_range - r1_range), 3) AS mean_diff FROM r1 GROUP BY 1",
    "radar_azimuth": f"{_RADAR}, z AS (SELECT utn % 4 AS k, t1_azimuth - r1_azimuth + pi() AS x FROM r1), y AS (SELECT k, degrees(x - 2 * pi() * floor(x / (2 * pi())) - pi()) AS turn FROM z) SELECT k, count(*) AS n, round(avg(turn), 5) AS mean_turn, count(*) FILTER (WHERE abs(turn) <= 10) AS n_passed FROM y GROUP BY k",
    "extra_track_rate": f"WITH {FLIGHTS}, k AS (SELECT utn, min(t) AS a, max(t) AS b FROM flights WHERE track = 0 GROUP BY utn), x AS (SELECT f.utn, coalesce(f.track <> 0 AND f.t BETWEEN a AND b, false) AS extra FROM flights f LEFT JOIN k ON k.utn = f.utn) SELECT utn, count(*) FILTER (WHERE extra) AS n_extra, count(*) FILTER (WHERE NOT extra) AS n_ok, round(count(*) FILTER (WHERE extra) / count(*), 9) AS p_extra FROM x GROUP BY utn",
    "extra_data_ignoring": f"WITH {FLIGHTS}, {_PERIODS}, gone AS (SELECT utn FROM flights GROUP BY utn HAVING count(*) < 60 OR max(t) - min(t) < {700 * HOUR} OR utn % 11 = 0), c AS (SELECT f.utn, EXISTS (SELECT 1 FROM periods p WHERE p.utn = f.utn AND f.t BETWEEN period_begin AND period_end) AS ok FROM flights f WHERE source = 'click' AND utn NOT IN (SELECT utn FROM gone)) SELECT utn, count(*) FILTER (WHERE NOT ok) AS n_extra, count(*) FILTER (WHERE ok) AS n_ok, round(count(*) FILTER (WHERE NOT ok) / count(*), 9) AS p_extra FROM c GROUP BY utn",
    "dubious_tracks": f"{_TRACKS} SELECT utn, track, session, n_updates, round(du, 6) AS duration, n_dubious, n_speed, n_angle, n_large_speed, reason, reason IS NOT NULL AS is_dubious FROM r",
    "dubious_track_ratio": f"{_TRACKS}, q AS (SELECT track, round(du, 6) AS du, reason IS NOT NULL AS bad FROM r) SELECT track, count(*) AS n, count(*) FILTER (WHERE bad) AS n_dubious, round(avg(du) FILTER (WHERE bad), 4) AS mean_dubious, round(avg(du) FILTER (WHERE NOT bad), 4) AS mean_other, round(count(*) FILTER (WHERE bad) / count(*), 4) AS p_dubious FROM q GROUP BY track",
    "interpolated_positions": f"{_A}, s AS (SELECT id, lo_lat, lo_lon, hi_lat, hi_lon, CASE WHEN lo_t = t THEN 0.0::DOUBLE ELSE (t - lo_t) / (hi_t - lo_t) END AS share FROM aligned WHERE pos AND lo_lat IS NOT NULL AND hi_lat IS NOT NULL) SELECT id, round(radians(hi_lon - lo_lon) * cos(radians(lo_lat)) * 6371008.8::DOUBLE * share, 4) AS east, round(radians(hi_lat - lo_lat) * 6371008.8::DOUBLE * share, 4) AS north FROM s",
    "neighbour_ground": f"{_A} SELECT id, CASE WHEN lo_ground THEN true ELSE hi_ground END AS ground FROM aligned WHERE pos",
    "nearest_point": f"WITH {FLIGHTS}, v AS (SELECT utn, t, speed, row_number() OVER (PARTITION BY utn ORDER BY t) AS i FROM flights WHERE source = 'view') SELECT c.id, CASE WHEN c.t - v.t <= {REACH} THEN v.i END AS index, CASE WHEN c.t - v.t <= {REACH} THEN v.speed END AS last_speed FROM (SELECT * FROM flights WHERE source = 'click') c ASOF LEFT JOIN v ON c.utn = v.utn AND c.t >= v.t",
    "positions_between": f"WITH {FLIGHTS}, s AS (SELECT utn, min(t) + {100 * HOUR} AS a, min(t) + {200 * HOUR} AS b FROM flights GROUP BY utn) SELECT id, a AS begin FROM flights JOIN s USING (utn) WHERE t BETWEEN a AND b",
}
