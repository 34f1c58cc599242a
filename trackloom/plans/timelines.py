"""Queries along the time of targets: alignment, sessions, periods; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import evaluation as E
from trackloom.operators import timeline as L
from trackloom.plans.common import HOUR, INTERVAL, REACH, REPORTS, reports


def aligned(spark, sf):
    """Clicks as test reports, views as reference."""
    r = reports(spark, sf)
    tst, ref = r.where("source = 'click'").select("id", "utn", "t", "value", "code"), r.where("source = 'view'").select("utn", "t", "value", "code")
    return L.asof_neighbours(tst, ref, "utn", "t", ["value", "code"], REACH)


_ALIGNED = f"""
tst AS (SELECT * FROM reports WHERE source = 'click'), ref AS (SELECT utn, t, min_by(value, (value, code)) AS value, min_by(code, (value, code)) AS code FROM reports WHERE source = 'view' GROUP BY utn, t),
aligned AS (
  SELECT tst.id, tst.utn, tst.t, tst.value, tst.code,
    CASE WHEN tst.t - lo.t <= {REACH} THEN lo.t END AS lo_t, CASE WHEN tst.t - lo.t <= {REACH} THEN lo.value END AS lo_value, CASE WHEN tst.t - lo.t <= {REACH} THEN lo.code END AS lo_code,
    CASE WHEN hi.t - tst.t <= {REACH} THEN hi.t END AS hi_t, CASE WHEN hi.t - tst.t <= {REACH} THEN hi.value END AS hi_value, CASE WHEN hi.t - tst.t <= {REACH} THEN hi.code END AS hi_code
  FROM tst ASOF LEFT JOIN ref lo ON tst.utn = lo.utn AND tst.t >= lo.t ASOF LEFT JOIN ref hi ON tst.utn = hi.utn AND tst.t <= hi.t
),
status AS (
  SELECT *, CASE WHEN lo_t IS NULL OR hi_t IS NULL THEN 'no_ref_pos' WHEN abs(value - lo_value) <= 100 OR abs(value - hi_value) <= 100 THEN 'same' ELSE 'different' END AS status FROM aligned
)"""


def asof_interpolate(spark, sf):
    a = aligned(spark, sf)
    return a.select("id", "matched", F.round(L.interpolate("value", "t"), 6).alias("ref_value"))


def asof_angle(spark, sf):
    a = aligned(spark, sf).where("matched")
    return a.select("id", F.round(L.interpolate_angle("value", "t"), 5).alias("angle"))


def _status(spark, sf):
    a = aligned(spark, sf)
    return a.withColumn("status", L.compare_status("value", "value", 100.0, F.col("matched")))


def asof_compare_status(spark, sf):
    return _status(spark, sf).select("id", "status")


def altitude_fill(spark, sf):
    r = reports(spark, sf).withColumn("value", F.when(F.col("code") % 3 != 0, F.col("value")))
    return L.fill_nearest(r, "utn", "t", "value", REACH).select("id", F.round("value", 6).alias("value"))


def gap_sessions(spark, sf):
    return L.gap_sessions(reports(spark, sf), "utn", "t", REACH).groupBy("utn", "session").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def _periods(spark, sf):
    return L.periods(reports(spark, sf), "utn", "t", F.col("source") != "error", 24 * HOUR, 1_000_000)


_PERIODS = f"""
marked AS (SELECT utn, t, source <> 'error' AS ok, lag(source <> 'error') OVER w AS before, lag(t) OVER w AS prev_t FROM reports WINDOW w AS (PARTITION BY utn ORDER BY t)),
numbered AS (SELECT *, sum(CASE WHEN ok AND (NOT coalesce(before, false) OR t - prev_t > {24 * HOUR}) THEN 1 ELSE 0 END) OVER (PARTITION BY utn ORDER BY t) AS p FROM marked),
periods AS (SELECT utn, min(t) AS period_begin, max(t) AS period_end FROM numbered WHERE ok GROUP BY utn, p HAVING max(t) - min(t) >= 1000000)"""


def reference_periods_ui(spark, sf):
    return L.update_intervals(_periods(spark, sf), "utn", INTERVAL)


def outside_periods(spark, sf):
    spans = reports(spark, sf).groupBy("utn").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return L.outside_periods(_periods(spark, sf), spans, "utn")


def detection_with_limits(spark, sf):
    """A tolerance, and limits of the gaps that count, which are asked of what the tolerance leaves."""
    clicks = reports(spark, sf).where("source = 'click'").select("utn", "t")
    out = E.missed_updates(clicks, _periods(spark, sf), "utn", "t", INTERVAL, 2 * HOUR, 8 * HOUR, 30 * HOUR)
    return out.withColumn("pd", F.round("pd", 9))


def _detection(spark, sf):
    clicks = reports(spark, sf).where("source = 'click'").select("utn", "t")
    return E.missed_updates(clicks, _periods(spark, sf), "utn", "t", INTERVAL)


_DETECTION = f"""{_PERIODS},
points AS (
  SELECT p.utn, period_begin, r.t AS x FROM periods p JOIN reports r ON r.utn = p.utn AND r.source = 'click' AND r.t BETWEEN period_begin AND period_end
  UNION ALL SELECT utn, period_begin, period_begin FROM periods UNION ALL SELECT utn, period_begin, period_end FROM periods
),
gaps AS (SELECT utn, x - lag(x) OVER (PARTITION BY utn, period_begin ORDER BY x) AS gap FROM points),
missed AS (SELECT utn, CAST(sum(CASE WHEN gap > {INTERVAL} THEN gap // {INTERVAL} ELSE 0 END) AS BIGINT) AS missed FROM gaps GROUP BY utn),
uis AS (SELECT utn, CAST(sum((period_end - period_begin) // {INTERVAL}) AS BIGINT) AS sum_uis FROM periods GROUP BY utn),
detection AS (SELECT utn, sum_uis, missed, CASE WHEN sum_uis > 0 THEN 1 - missed / sum_uis END AS pd FROM uis JOIN missed USING (utn))"""


def detection_probability(spark, sf):
    return _detection(spark, sf).withColumn("pd", F.round("pd", 9))


def detection_rollup(spark, sf):
    out = E.roll_up(_detection(spark, sf), [], ["sum_uis", "missed"])
    return out.withColumn("pd", F.round(E.detection_probability(F.col("missed"), F.col("sum_uis")), 9))


def seconds_grid(spark, sf):
    r = reports(spark, sf).withColumn("hour", F.floor(F.col("t") / HOUR)).withColumn("sure", F.col("code") % 3)
    return L.seconds_grid(r, "utn", "hour", "code", "sure", 2)


def tod_rollover_reset(spark, sf):
    r = reports(spark, sf).withColumn("tod", F.when(F.col("code") % 17 != 0, ((F.floor(F.col("t") / 1_000_000) * 7) % 86400).cast("double")))
    return L.day_rollover_reset(r, "source", "t", "tod", 9000.0, 20000.0).select("id", "day", "seconds")


def tod_rollover(spark, sf):
    r = reports(spark, sf).withColumn("tod", F.pmod(F.floor(F.col("t") / 1_000_000) * 7, F.lit(86400)).cast("double"))
    return L.day_rollover(r, "source", "t", "tod", 20000.0).select("id", "day", "seconds")


def interval_overlap(spark, sf):
    p = _periods(spark, sf).groupBy("utn").agg(F.min("period_begin").alias("a"), F.min("period_end").alias("b"), F.max("period_begin").alias("c"), F.max("period_end").alias("d"))
    return p.select("utn", F.round(L.overlap_share(F.col("a"), F.col("d"), F.col("b"), F.col("c")), 9).alias("share"))


def _counts(spark, sf):
    """The reference's mapped position decides what is inside."""
    s = _status(spark, sf).withColumn("inside", L.interpolate("value", "t") < 400)
    return E.status_counts(s, ["utn"], "status", F.col("inside"))


_COUNTS = f"""{_ALIGNED},
placed AS (SELECT *, CASE WHEN lo_t = t THEN lo_value ELSE lo_value + (hi_value - lo_value) * ((t - lo_t) / (hi_t - lo_t)) END < 400 AS inside FROM status),
counts AS (
  SELECT utn, count(*) AS n_updates, count(*) FILTER (WHERE lo_t IS NULL OR hi_t IS NULL) AS n_no_ref_pos, count(*) FILTER (WHERE lo_t IS NOT NULL AND hi_t IS NOT NULL AND NOT inside) AS n_outside,
    count(*) FILTER (WHERE lo_t IS NOT NULL AND hi_t IS NOT NULL AND inside) AS n_inside, count(*) FILTER (WHERE inside AND status = 'same') AS n_same,
    count(*) FILTER (WHERE inside AND status = 'different') AS n_different, CAST(0 AS BIGINT) AS n_no_ref_val, CAST(0 AS BIGINT) AS n_no_tst
  FROM placed GROUP BY utn
)"""


def correct_rate(spark, sf):
    return E.correct_rate(_counts(spark, sf)).withColumn("p_correct", F.round("p_correct", 9))


def false_rate(spark, sf):
    return E.false_rate(_counts(spark, sf)).select("utn", F.round("p_false", 9).alias("p_false"))


def present_rate(spark, sf):
    r = reports(spark, sf).withColumn("code", F.when(F.col("code") % 4 != 0, F.col("code")))
    tst, ref = r.where("source = 'click'"), r.where("source = 'view'")
    a = L.asof_neighbours(tst, ref, "utn", "t", ["value", "code"], REACH)
    counts = E.status_counts(a.withColumn("status", L.compare_status("code", "code", 0, F.col("matched"))), ["utn"], "status")
    return E.present_rate(counts).withColumn("p_present", F.round("p_present", 9))


def split_rollup(spark, sf):
    counts = _counts(spark, sf).withColumn("split", E.split_key(F.col("utn") % 5 == 0, F.col("utn") % 2 == 0))
    return E.correct_rate(E.roll_up(counts, ["split"], ["n_same", "n_different", "n_no_tst"])).withColumn("p_correct", F.round("p_correct", 9))


def position_rms(spark, sf):
    a = aligned(spark, sf).where("matched").withColumn("d", F.col("value") - L.interpolate("value", "t"))
    out = E.accumulate(a, ["utn"], "d")
    return out.select("utn", "n", *(F.round(c, 5).alias(c) for c in ("min", "max", "mean", "rms", "stddev")))


def linear_fit(spark, sf):
    a = aligned(spark, sf).where("matched").withColumn("ref", L.interpolate("value", "t")).withColumn("k", F.col("utn") % 4)
    out = E.linear_fit(a, ["k"], "value", "ref")
    return out.select("k", "n", *(F.round(c, 6).alias(c) for c in ("gain", "bias", "mean_diff")))


def speed_percent_threshold(spark, sf):
    a = aligned(spark, sf).where("matched").withColumn("ref", L.interpolate("value", "t"))
    return a.groupBy("utn").agg(F.count_if(E.speed_passes(F.col("value"), F.col("ref"), 20.0, 30.0)).alias("n_ok"), F.count("*").alias("n"))


def angle_min_diff(spark, sf):
    a = aligned(spark, sf).where("matched and exact = false")
    ok = E.angle_passes(F.col("value"), F.col("lo.value"), 45.0, F.col("hi.value"), 50.0)
    return a.groupBy("utn").agg(F.count_if(ok).alias("n_ok"), F.count(ok).alias("n_used"))


def extra_data(spark, sf):
    clicks = reports(spark, sf).where("source = 'click'").select("utn", "t")
    return E.extra_data(clicks, _periods(spark, sf), "utn", "t").withColumn("p_extra", F.round("p_extra", 9))


def extra_tracks(spark, sf):
    r = reports(spark, sf).withColumn("track", F.col("code") % 3)
    tracks = r.groupBy("utn", "track").agg(F.min("t").alias("period_begin"), F.max("t").alias("period_end")).where("track = 0")
    return E.extra_tracks(r, tracks, "utn", "t", "track").select("id")


def dubious_targets(spark, sf):
    return E.dubious(reports(spark, sf), ["utn"], "t", {"value": 20.0, "code": 10.0}, float(HOUR), 30, 240.0, 0.3).withColumn("duration", F.round("duration", 6))


def interest_levels(spark, sf):
    c = _counts(spark, sf).withColumn("factor", F.col("n_different") / F.col("n_updates"))
    return E.interest(c, "factor", (0.3, 0.15)).groupBy("interest").agg(*E.holds_for_every_target(F.col("n_different") > 5))


_W = "WITH " + REPORTS
_REF = "CASE WHEN lo_t = t THEN lo_value ELSE lo_value + (hi_value - lo_value) * ((t - lo_t) / (hi_t - lo_t)) END"
_MATCHED = "lo_t IS NOT NULL AND hi_t IS NOT NULL"
SQL = {
    "asof_interpolate": f"{_W}, {_ALIGNED} SELECT id, {_MATCHED} AS matched, CASE WHEN {_MATCHED} THEN round({_REF}, 6) END AS ref_value FROM aligned",
    "asof_angle": f"{_W}, {_ALIGNED}, s AS (SELECT id, t, lo_t, hi_t, lo_value AS a, (hi_value - lo_value + 180) - 360 * floor((hi_value - lo_value + 180) / 360) - 180 AS turn FROM aligned WHERE {_MATCHED}), v AS (SELECT id, CASE WHEN lo_t = t THEN a ELSE (a + turn * ((t - lo_t) / (hi_t - lo_t))) - 360 * floor((a + turn * ((t - lo_t) / (hi_t - lo_t))) / 360) END AS x FROM s) SELECT id, round(x, 5) AS angle FROM v",
    "asof_compare_status": f"{_W}, {_ALIGNED} SELECT id, status FROM status",
    "altitude_fill": f"""{_W}, n AS (SELECT id, utn, t, CASE WHEN code % 3 <> 0 THEN value END AS value FROM reports), k AS (SELECT utn, t, value FROM n WHERE value IS NOT NULL),
j AS (SELECT n.id, n.t, n.value, CASE WHEN n.t - lo.t < {REACH} THEN lo.t END AS lt, CASE WHEN n.t - lo.t < {REACH} THEN lo.value END AS lv, CASE WHEN hi.t - n.t < {REACH} THEN hi.t END AS ht, CASE WHEN hi.t - n.t < {REACH} THEN hi.value END AS hv
  FROM n ASOF LEFT JOIN k lo ON n.utn = lo.utn AND n.t >= lo.t ASOF LEFT JOIN k hi ON n.utn = hi.utn AND n.t <= hi.t)
SELECT id, round(coalesce(value, CASE WHEN ht > lt THEN lv + (hv - lv) * ((t - lt) / (ht - lt)) ELSE lv + (hv - lv) END, lv, hv), 6) AS value FROM j""",
    "gap_sessions": f"{_W}, m AS (SELECT utn, t, CASE WHEN t - lag(t) OVER w <= {REACH} THEN 0 ELSE 1 END AS new FROM reports WINDOW w AS (PARTITION BY utn ORDER BY t)), s AS (SELECT utn, t, CAST(sum(new) OVER (PARTITION BY utn ORDER BY t) AS BIGINT) AS session FROM m) SELECT utn, session, count(*) AS n, min(t) AS first, max(t) AS last FROM s GROUP BY utn, session",
    "reference_periods_ui": f"{_W}, {_PERIODS} SELECT utn, CAST(sum((period_end - period_begin) // {INTERVAL}) AS BIGINT) AS sum_uis, count(*) AS n_periods FROM periods GROUP BY utn",
    "outside_periods": f"""{_W}, {_PERIODS}, spans AS (SELECT utn, min(t) AS first, max(t) AS last FROM reports GROUP BY utn),
g AS (SELECT s.utn, coalesce(lag(period_end) OVER (PARTITION BY s.utn ORDER BY period_begin), first) AS gap_begin, coalesce(period_begin, last) AS gap_end FROM spans s LEFT JOIN periods p ON p.utn = s.utn
  UNION ALL SELECT s.utn, max(period_end), any_value(last) FROM spans s JOIN periods p ON p.utn = s.utn GROUP BY s.utn)
SELECT * FROM g WHERE gap_end > gap_begin""",
    "detection_with_limits": f"{_W}, {_DETECTION}, l AS (SELECT utn, gap - {2 * HOUR} AS gap FROM gaps), m AS (SELECT utn, CAST(coalesce(sum(gap // {INTERVAL}) FILTER (WHERE gap > {INTERVAL} AND gap BETWEEN {8 * HOUR} AND {30 * HOUR}), 0) AS BIGINT) AS missed FROM l GROUP BY utn) SELECT utn, sum_uis, m.missed, round(CASE WHEN sum_uis > 0 THEN 1 - m.missed / sum_uis END, 9) AS pd FROM uis JOIN m USING (utn)",
    "detection_probability": f"{_W}, {_DETECTION} SELECT utn, sum_uis, missed, round(pd, 9) AS pd FROM detection",
    "detection_rollup": f"{_W}, {_DETECTION} SELECT count(*) AS n_targets, CAST(sum(sum_uis) AS BIGINT) AS sum_uis, CAST(sum(missed) AS BIGINT) AS missed, round(1 - sum(missed) / sum(sum_uis), 9) AS pd FROM detection",
    "seconds_grid": f"{_W}, g AS (SELECT utn, t // {HOUR} AS hour, code, code % 3 AS sure, unnest(range(t // {HOUR} - 2, t // {HOUR} + 3)) AS slot FROM reports) SELECT utn, slot, min_by(code, (-sure, abs(slot - hour), code)) AS code FROM g GROUP BY utn, slot",
    "tod_rollover_reset": f"""{_W}, d AS (SELECT id, source, t, CASE WHEN code % 17 <> 0 THEN CAST((t // 1000000 * 7) % 86400 AS DOUBLE) END AS tod FROM reports),
s AS (SELECT *, count(*) FILTER (WHERE tod BETWEEN 20000 AND 66400) OVER (PARTITION BY source ORDER BY t) AS stretch FROM d),
l AS (SELECT source, stretch, min(t) AS late FROM s WHERE tod >= 77400 GROUP BY ALL),
j AS (SELECT s.source, s.stretch, min(s.t) AS turn FROM s JOIN l USING (source, stretch) WHERE s.tod <= 9000 AND s.t > l.late GROUP BY ALL),
n AS (SELECT s.id, s.tod, count(j.turn) OVER (PARTITION BY s.source ORDER BY s.t) AS days FROM s LEFT JOIN j ON j.source = s.source AND j.turn = s.t)
SELECT id, CASE WHEN tod IS NOT NULL THEN days - (tod >= 77400 AND days > 0)::INT END AS day, CASE WHEN tod IS NOT NULL THEN (days - (tod >= 77400 AND days > 0)::INT) * 86400e0 + tod END AS seconds FROM n""",
    "tod_rollover": f"{_W}, d AS (SELECT id, source, t, CAST((t // 1000000 * 7) % 86400 AS DOUBLE) AS tod FROM reports), s AS (SELECT *, lag(tod) OVER (PARTITION BY source ORDER BY t) AS b FROM d), r AS (SELECT id, tod, CAST(sum(CASE WHEN b > 66400 AND tod < 20000 THEN 1 WHEN b < 20000 AND tod > 66400 THEN -1 ELSE 0 END) OVER (PARTITION BY source ORDER BY t) AS BIGINT) AS day FROM s) SELECT id, day, day * 86400.0::DOUBLE + tod AS seconds FROM r",
    "interval_overlap": f"{_W}, {_PERIODS}, p AS (SELECT utn, min(period_begin) AS a, min(period_end) AS b, max(period_begin) AS c, max(period_end) AS d FROM periods GROUP BY utn), o AS (SELECT utn, least(d, c) - greatest(a, b) AS common, least(d - a, c - b) AS shorter FROM p) SELECT utn, round(CASE WHEN common > 0 AND shorter > 0 THEN common / shorter ELSE 0.0::DOUBLE END, 9) AS share FROM o",
    "correct_rate": f"{_W}, {_COUNTS} SELECT *, round(CASE WHEN n_same + n_different > 0 THEN n_same / (n_same + n_different) END, 9) AS p_correct FROM counts",
    "false_rate": f"{_W}, {_COUNTS} SELECT utn, round(CASE WHEN n_same + n_different > 0 THEN n_different / (n_same + n_different) END, 9) AS p_false FROM counts",
    # from the stated rule: reports without a reference position don't count, those whose reference has no code count as present
    "present_rate": f"""{_W}, r AS (SELECT utn, t, source, value, CASE WHEN code % 4 <> 0 THEN code END AS code FROM reports), tst AS (SELECT * FROM r WHERE source = 'click'),
ref AS (SELECT utn, t, any_value(code) AS code FROM r WHERE source = 'view' GROUP BY utn, t),
j AS (SELECT tst.utn, tst.code, lo.code AS a, hi.code AS b, tst.t - lo.t <= {REACH} AND hi.t - tst.t <= {REACH} AS pos FROM tst ASOF LEFT JOIN ref lo ON tst.utn = lo.utn AND tst.t >= lo.t ASOF LEFT JOIN ref hi ON tst.utn = hi.utn AND tst.t <= hi.t),
c AS (SELECT utn, count(*) AS n_updates, count(*) FILTER (WHERE pos IS NOT TRUE) AS n_no_ref_pos, CAST(0 AS BIGINT) AS n_outside, count(*) FILTER (WHERE pos) AS n_inside,
  count(*) FILTER (WHERE pos AND code IS NOT NULL AND (code = a OR code = b)) AS n_same, count(*) FILTER (WHERE pos AND code IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL) AND (code = a OR code = b) IS NOT TRUE) AS n_different,
  count(*) FILTER (WHERE pos AND a IS NULL AND b IS NULL) AS n_no_ref_val, count(*) FILTER (WHERE pos AND (a IS NOT NULL OR b IS NOT NULL) AND code IS NULL) AS n_no_tst FROM j GROUP BY utn)
SELECT *, round(CASE WHEN n_inside > 0 THEN (n_inside - n_no_tst) / n_inside END, 9) AS p_present FROM c""",
    "split_rollup": f"{_W}, {_COUNTS}, s AS (SELECT CASE WHEN utn % 5 = 0 THEN 'Primary' WHEN utn % 2 = 0 THEN 'Mode S' ELSE 'Mode A/C' END AS split, count(*) AS n_targets, CAST(sum(n_same) AS BIGINT) AS n_same, CAST(sum(n_different) AS BIGINT) AS n_different, CAST(sum(n_no_tst) AS BIGINT) AS n_no_tst FROM counts GROUP BY split) SELECT *, round(CASE WHEN n_same + n_different > 0 THEN n_same / (n_same + n_different) END, 9) AS p_correct FROM s",
    "position_rms": f"{_W}, {_ALIGNED}, d AS (SELECT utn, value - {_REF} AS d FROM aligned WHERE {_MATCHED}) SELECT utn, count(d) AS n, round(min(d), 5) AS min, round(max(d), 5) AS max, round(avg(d), 5) AS mean, round(sqrt(avg(d * d)), 5) AS rms, round(stddev_pop(d), 5) AS stddev FROM d GROUP BY utn",
    "linear_fit": f"{_W}, {_ALIGNED}, d AS (SELECT utn % 4 AS k, value, {_REF} AS ref FROM aligned WHERE {_MATCHED}) SELECT k, count(*) AS n, round(regr_slope(ref, value), 6) AS gain, round(regr_intercept(ref, value), 6) AS bias, round(avg(value - ref), 6) AS mean_diff FROM d GROUP BY k",
    "speed_percent_threshold": f"{_W}, {_ALIGNED}, d AS (SELECT utn, value, {_REF} AS ref FROM aligned WHERE {_MATCHED}) SELECT utn, count(*) FILTER (WHERE abs(ref - value) <= greatest(20, value * 0.3::DOUBLE)) AS n_ok, count(*) AS n FROM d GROUP BY utn",
    "angle_min_diff": f"{_W}, {_ALIGNED}, d AS (SELECT utn, hi_value, value - lo_value + 180 AS x FROM aligned WHERE {_MATCHED} AND lo_t <> t) SELECT utn, count(*) FILTER (WHERE hi_value >= 50 AND abs(x - 360 * floor(x / 360) - 180) <= 45) AS n_ok, count(*) FILTER (WHERE hi_value >= 50) AS n_used FROM d GROUP BY utn",
    "extra_data": f"{_W}, {_PERIODS}, c AS (SELECT r.utn, EXISTS (SELECT 1 FROM periods p WHERE p.utn = r.utn AND r.t BETWEEN period_begin AND period_end) AS ok FROM reports r WHERE source = 'click') SELECT utn, count(*) FILTER (WHERE NOT ok) AS n_extra, count(*) FILTER (WHERE ok) AS n_ok, round(count(*) FILTER (WHERE NOT ok) / count(*), 9) AS p_extra FROM c GROUP BY utn",
    "extra_tracks": f"{_W}, k AS (SELECT utn, min(t) AS a, max(t) AS b FROM reports WHERE code % 3 = 0 GROUP BY utn) SELECT r.id FROM reports r JOIN k ON k.utn = r.utn AND r.code % 3 <> 0 AND r.t BETWEEN a AND b",
    "dubious_targets": f"""{_W}, d AS (SELECT utn, t, (t - lag(t) OVER w) / {float(HOUR)}::DOUBLE AS dt, abs(value - lag(value) OVER w) AS dv, abs(code - lag(code) OVER w) AS dc FROM reports WINDOW w AS (PARTITION BY utn ORDER BY t)),
b AS (SELECT utn, t, coalesce(dt > 0 AND dv / dt > 20, false) AS bv, coalesce(dt > 0 AND dc / dt > 10, false) AS bc FROM d),
a AS (SELECT utn, count(*) AS n_updates, (max(t) - min(t)) / {float(HOUR)}::DOUBLE AS duration, count(*) FILTER (WHERE bv OR bc) AS n_dubious, count(*) FILTER (WHERE bv) AS n_value, count(*) FILTER (WHERE bc) AS n_code FROM b GROUP BY utn),
r AS (SELECT utn, n_updates, round(duration, 6) AS duration, n_dubious, n_value, n_code, CASE WHEN n_updates < 30 THEN 'few updates' WHEN duration < 240 THEN 'short' WHEN n_dubious > 0.3::DOUBLE * n_updates THEN 'changes' END AS reason FROM a)
SELECT *, reason IS NOT NULL AS is_dubious FROM r""",
    "interest_levels": f"{_W}, {_COUNTS}, i AS (SELECT n_different, CASE WHEN n_different / n_updates >= 0.3 THEN 2 WHEN n_different / n_updates >= 0.15 THEN 1 ELSE 0 END AS interest FROM counts) SELECT interest, count(*) FILTER (WHERE n_different > 5) AS n_failed, count(*) FILTER (WHERE n_different > 5) = 0 AS passed FROM i GROUP BY interest",
}
