"""The driver's tables as target reports, and constants scaled to their sparse times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.scalar import micros

HOUR = 3_600_000_000
REACH = 12 * HOUR
INTERVAL = 6 * HOUR

#: The same reports in SQL.
REPORTS = """reports AS (
  SELECT event_id AS id, user_id AS utn, epoch_us(ts) AS t, event_type AS source, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS code FROM events
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, utn, t in microseconds, source, value, code."""
    e = table(spark, sf_dir, "events")
    code = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("utn"), micros(F.col("ts")).alias("t"), F.col("event_type").alias("source"), "value", code.alias("code"))


#: The reports with what surveillance reports carry, derived from value and code; nulls where code is a multiple.
FLIGHTS = f"""{REPORTS}, flights AS (
  SELECT id, utn, t, source, code, CASE WHEN code % 4 <> 0 THEN CASE WHEN code % 10 = 1 THEN 1 ELSE utn * 37 % 4096 END END AS mode_a,
    CASE WHEN code % 5 <> 0 THEN utn * 1009 + CASE WHEN code % 12 = 1 THEN 1 ELSE 0 END END AS acad, CASE WHEN code % 6 <> 0 THEN CASE WHEN code % 9 = 1 THEN 'OTHER' ELSE 'TGT' || utn END END AS acid,
    CASE WHEN code % 7 <> 0 THEN value * 100 END AS mode_c, CASE WHEN code % 13 <> 0 THEN 47 + (utn % 10) * 1e-1 + code * 1e-3 END AS lat, CASE WHEN code % 13 <> 0 THEN 13 + value * 1e-3 END AS lon,
    100 + value AS speed, code * 36e-1 AS angle, code % 3 AS track, code % 2 AS line, CASE WHEN code % 8 <> 1 THEN code % 8 = 0 END AS ground
  FROM reports
)"""


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, utn, t, source, code, mode_a, acad, acid, mode_c, lat, lon, speed, angle, track, line, ground."""
    r = reports(spark, sf_dir)
    code, unless = F.col("code"), lambda n, value: F.when(F.col("code") % n != 0, value)
    return r.select(
        "id", "utn", "t", "source", "code", unless(4, F.when(code % 10 == 1, 1).otherwise(F.col("utn") * 37 % 4096)).alias("mode_a"),
        unless(5, F.col("utn") * 1009 + F.when(code % 12 == 1, 1).otherwise(0)).alias("acad"), unless(6, F.when(code % 9 == 1, "OTHER").otherwise(F.concat(F.lit("TGT"), "utn"))).alias("acid"),
        unless(7, F.col("value") * 100).alias("mode_c"), unless(13, 47 + (F.col("utn") % 10) * 1e-1 + code * 1e-3).alias("lat"), unless(13, 13 + F.col("value") * 1e-3).alias("lon"),
        (100 + F.col("value")).alias("speed"), (code * 36e-1).alias("angle"), (code % 3).alias("track"), (code % 2).alias("line"), F.when(code % 8 != 1, code % 8 == 0).alias("ground"),
    )
