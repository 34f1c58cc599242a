"""Queries of loading, filtering, changing and summing up content tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import aggregates as A
from trackloom.operators import filters as P
from trackloom.operators import tables as T
from trackloom.plans.common import HOUR, REPORTS, reports, table


def scan_filter_select(spark, sf):
    li = table(spark, sf, "lineitem")
    kept = li.where(P.compare("l_quantity", ">=", 30) & P.compare("l_discount", "<", 0.05) & P.compare("l_returnflag", "IN", ["A", "R"]))
    return kept.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


SCAN = "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag IN ('A', 'R')"


def _with_nulls(spark, sf):
    return reports(spark, sf).withColumn("code", F.when(F.col("code") % 7 != 0, F.col("code")))


_NULLS = "n AS (SELECT id, utn, t, source, value, CASE WHEN code % 7 <> 0 THEN code END AS code FROM reports)"


def filter_in_or_null(spark, sf):
    return _with_nulls(spark, sf).where(P.codes("code", "10, 11, 77, NULL", 8)).select("id", "code")


def filter_like_any(spark, sf):
    return table(spark, sf, "part").where(P.contains_any(["p_name", "p_type"], ["widget", "SMA"])).select("p_partkey", "p_name")


def filter_excluded_windows(spark, sf):
    day = lambda d: d * 24 * HOUR + 1704067200_000000
    r = reports(spark, sf).where(P.between("t", day(2), day(25)) & P.outside_windows("t", [(day(4), day(6)), (day(10), day(11))]))
    return r.select("id", "utn", "source")


def filter_quality_versions(spark, sf):
    bounds = {("A",): F.col("l_quantity") >= 40, ("N", "R"): F.col("l_quantity") <= 5}
    return table(spark, sf, "lineitem").where(P.quality_by_version("l_returnflag", bounds)).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"))


def filter_tuple_in(spark, sf):
    r = reports(spark, sf)
    wanted = r.groupBy("utn", "source").agg(F.count("*").alias("n")).where("n >= 12")
    return P.sources(r, wanted, ["utn", "source"]).select("id", "utn", "source")


def filter_hypot(spark, sf):
    return table(spark, sf, "lineitem").where(P.accuracy_within("l_discount", "l_tax", 0.05)).select("l_orderkey", "l_discount", "l_tax")


def json_member(spark, sf):
    r = reports(spark, sf).withColumn("receivers", F.concat(F.lit("["), F.col("code").cast("string"), F.lit(","), (F.col("id") % 5).cast("string"), F.lit("]")))
    return r.where(P.json_has_any("receivers", [3, 42])).select("id", "receivers")


def null_count_any(spark, sf):
    return A.null_rows(_with_nulls(spark, sf), ["code", "value"])


def min_max_all_columns(spark, sf):
    o = table(spark, sf, "orders")
    return A.min_max_columns(o, o.columns)


def group_min_max(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(*(f(c).alias(f"{n}_{c}") for c in ("l_quantity", "l_discount") for n, f in (("min", F.min), ("max", F.max))))


def target_summary(spark, sf):
    return A.target_summary(reports(spark, sf), "utn", "t", "source", "code", "value")


def source_counts(spark, sf):
    return reports(spark, sf).withColumn("line", F.col("id") % 4).groupBy("source", "line").agg(F.count("*").alias("n"), F.count_if(F.col("code") < 10).alias("n_low"))


def distinct_with_counts(spark, sf):
    return A.distinct_counts(_with_nulls(spark, sf), "code")


def column_fill(spark, sf):
    return A.column_fill(_with_nulls(spark, sf), ["id", "code", "source"])


def robust_statistics(spark, sf):
    out = A.robust(reports(spark, sf), ["source"], "value")
    return out.select("source", *(F.round(c, 6).alias(c) for c in ("median", "iqr", "mad")))


def weighted_mean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(A.weighted_mean(F.col("l_extendedprice"), 1 / F.col("l_quantity")), 4).alias("mean"))


def update_from_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    changes = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 20 == 0, -F.col("o_totalprice")).alias("o_totalprice"))
    return T.update_by_key(o, changes, "o_orderkey", ["o_totalprice"])


def upsert_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    rows = c.where("c_custkey % 9 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    return T.upsert(c, rows, "c_custkey")


def delete_rows(spark, sf):
    r = _with_nulls(spark, sf)
    return T.delete(r, (F.col("source") == "click") & (F.col("code") > 30)).select("id", "source", "code")


def union_all_time_order(spark, sf):
    r = reports(spark, sf)
    contents = {"click": r.where("source = 'click'").select("id", "t", "value"), "view": r.where("source = 'view'").select("id", "t", "code")}
    return T.union_contents(contents)


def retention_cut(spark, sf):
    return T.retained(reports(spark, sf), "t", 72 * HOUR).select("id", "utn")


def representation_format(spark, sf):
    r = reports(spark, sf)
    return r.select(
        "id", S.octal_text(F.col("code")).alias("mode3a"), S.octal_value(S.octal_text(F.col("code"))).alias("back"), S.hex_text(F.col("utn") * 4099 + F.col("code")).alias("address"),
        F.round(S.flight_level(F.col("value") * 100), 2).alias("fl"), S.climb_text(F.col("id") % 5).alias("climb"), S.time_text((F.col("id") % 86400).cast("double")).alias("tod"),
        S.source_id(F.col("id") % 200, F.col("code")).alias("ds_id"), S.record_number(F.col("id"), F.lit(21)).alias("rec_num"),
    )


def derived_columns(spark, sf):
    r = reports(spark, sf).withColumn("vx", F.col("value") - 250.0).withColumn("vy", F.col("code") - 50.0)
    r = r.withColumn("speed", S.ground_speed_knots(F.col("vx"), F.col("vy"))).withColumn("angle", S.track_angle(F.col("vx"), F.col("vy")))
    return r.select("id", F.round("speed", 6).alias("speed"), F.round("angle", 6).alias("angle"), F.round(S.convert_unit(F.col("value"), "length", "ft", "m"), 6).alias("metres"))


SQL = {
    "scan_filter_select": SCAN,
    "filter_in_or_null": f"WITH {REPORTS}, {_NULLS} SELECT id, code FROM n WHERE code IN (8, 9, 63) OR code IS NULL",
    "filter_like_any": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%' OR p_name LIKE '%SMA%' OR p_type LIKE '%widget%' OR p_type LIKE '%SMA%'",
    "filter_excluded_windows": "SELECT event_id AS id, user_id AS utn, event_type AS source FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-26' AND NOT (ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07' OR ts BETWEEN TIMESTAMP '2024-01-11' AND TIMESTAMP '2024-01-12')",
    "filter_quality_versions": "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS sum_qty FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity >= 40) OR (l_returnflag IN ('N', 'R') AND l_quantity <= 5) GROUP BY l_returnflag",
    "filter_tuple_in": f"WITH {REPORTS} SELECT id, utn, source FROM reports WHERE (utn, source) IN (SELECT (utn, source) FROM reports GROUP BY utn, source HAVING count(*) >= 12)",
    "filter_hypot": "SELECT l_orderkey, l_discount, l_tax FROM lineitem WHERE sqrt(l_discount * l_discount + l_tax * l_tax) <= 0.05",
    "json_member": f"WITH {REPORTS} SELECT id, '[' || code || ',' || (id % 5) || ']' AS receivers FROM reports WHERE code IN (3, 42) OR id % 5 IN (3, 42)",
    "null_count_any": f"WITH {REPORTS}, {_NULLS} SELECT count(*) FILTER (WHERE code IS NULL OR value IS NULL) AS n_null, count(*) AS n_rows FROM n",
    "min_max_all_columns": " UNION ALL ".join(f"SELECT '{c}' AS name, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    "group_min_max": "SELECT l_suppkey, l_returnflag, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_discount) AS min_l_discount, max(l_discount) AS max_l_discount FROM lineitem GROUP BY ALL",
    "target_summary": f"WITH {REPORTS} SELECT utn, count(*) AS n_updates, min(t) AS first, max(t) AS last, count(DISTINCT source) AS n_sources, string_agg(DISTINCT lpad(code::VARCHAR, 4, '0'), ',' ORDER BY lpad(code::VARCHAR, 4, '0')) AS codes, min(value) AS min_height, max(value) AS max_height FROM reports GROUP BY utn",
    "source_counts": f"WITH {REPORTS} SELECT source, id % 4 AS line, count(*) AS n, count(*) FILTER (WHERE code < 10) AS n_low FROM reports GROUP BY ALL",
    "distinct_with_counts": f"WITH {REPORTS}, {_NULLS} SELECT code, count(*) AS n FROM n WHERE code IS NOT NULL GROUP BY code",
    "column_fill": f"WITH {REPORTS}, {_NULLS} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS n_null, count({c}) = 0 AS all_null, count({c}) = count(*) AS never_null FROM n" for c in ("id", "code", "source")),
    "robust_statistics": f"WITH {REPORTS}, m AS (SELECT source, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM reports GROUP BY source) SELECT source, round(any_value(median), 6) AS median, round(any_value(iqr), 6) AS iqr, round(median(abs(value - median)), 6) AS mad FROM reports JOIN m USING (source) GROUP BY source",
    "weighted_mean": "SELECT l_linestatus, round(sum(l_extendedprice / l_quantity) / sum(1 / l_quantity), 4) AS mean FROM lineitem GROUP BY l_linestatus",
    "update_from_join": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 20 = 0 THEN -o_totalprice WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders",
    "upsert_rows": "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 AND c_custkey % 2 = 1 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, 'NEW' FROM customer WHERE c_custkey % 18 = 0",
    "delete_rows": f"WITH {REPORTS}, {_NULLS} SELECT id, source, code FROM n WHERE NOT coalesce(source = 'click' AND code > 30, false)",
    "union_all_time_order": f"WITH {REPORTS} SELECT id, t, value, NULL::BIGINT AS code, 'click' AS content FROM reports WHERE source = 'click' UNION ALL SELECT id, t, NULL, code, 'view' FROM reports WHERE source = 'view'",
    "retention_cut": f"WITH {REPORTS} SELECT id, utn FROM reports WHERE t >= (SELECT max(t) FROM reports) - {72 * HOUR}",
    "representation_format": f"WITH {REPORTS} SELECT id, lpad(printf('%o', code), 4, '0') AS mode3a, code AS back, lpad(printf('%X', utn * 4099 + code), 6, '0') AS address, round(value, 2) AS fl, CASE id % 5 WHEN 0 THEN 'LVL' WHEN 1 THEN 'CLB' WHEN 2 THEN 'DSC' ELSE 'OTHER' END AS climb, lpad(((id % 86400) // 3600)::VARCHAR, 2, '0') || ':' || lpad(((id % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((id % 60)::VARCHAR, 2, '0') || '.000' AS tod, (id % 200) * 255 + code AS ds_id, id * 256 + 21 AS rec_num FROM reports",
    "derived_columns": f"WITH {REPORTS}, d AS (SELECT id, value, value - 250.0::DOUBLE AS vx, code - 50.0::DOUBLE AS vy FROM reports) SELECT id, round(sqrt(vx * vx + vy * vy) / (1852.0::DOUBLE / 3600), 6) AS speed, round(CASE WHEN degrees(atan2(vx, vy)) < 0 THEN degrees(atan2(vx, vy)) + 360 ELSE degrees(atan2(vx, vy)) END, 6) AS angle, round(value * 0.3048::DOUBLE, 6) AS metres FROM d",
}
