"""Queries that run a stream over the events to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators.staging import scratch
from trackloom.plans.common import FLIGHTS, flights
from trackloom.streaming.live import accepted, keep_in_store, live_filters, read_store


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # the folder of one table is read as a stream of files
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")


def live_store(spark, sf):
    """Micro-batches cleaned of repeats and future reports into an hourly store, read back by source."""
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    home = scratch(spark, "live")
    rows = accepted(_events(spark, sf), "ts", now, "3 minutes", "60 days")
    keep_in_store(rows, f"{home}/store", "ts", lambda df: df.dropDuplicates(["event_id"]), f"{home}/state").awaitTermination()
    return read_store(spark, f"{home}/store").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def retained_store(spark, sf):
    """A store that keeps three days: what is left after the stream, by day."""
    home = scratch(spark, "live")
    keep_in_store(_events(spark, sf), f"{home}/store", "ts", lambda df: df, f"{home}/state", "day", "3 days").awaitTermination()
    return read_store(spark, f"{home}/store").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


def live_filtered(spark, sf):
    """The live filters on a table; streams take the same columns."""
    return live_filters(flights(spark, sf), modes="45,112,NULL", identifications=["TGT1", "TGT2"], heights=(1000.0, 30000.0)).select("id", "acid")


QUERIES = {"live_store": live_store, "retained_store": retained_store, "live_filtered": live_filtered}
SQL = {
    "retained_store": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE date_trunc('day', ts) >= (SELECT date_trunc('day', max(ts) - INTERVAL 3 DAY) FROM events) GROUP BY 1",
    "live_filtered": f"WITH {FLIGHTS} SELECT id, acid FROM flights WHERE (mode_a IN (37, 74) OR mode_a IS NULL) AND (acid LIKE '%TGT1%' OR acid LIKE '%TGT2%') AND (mode_c BETWEEN 1000 AND 30000 OR mode_c IS NULL)",
    "live_store": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:03:00' AND ts >= TIMESTAMP '2023-11-21' GROUP BY event_type",
}
