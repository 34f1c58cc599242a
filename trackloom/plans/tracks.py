"""Queries of tracking, which SQL can't express; tests compare them with a plain filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators.tracking import reference_tracks
from trackloom.plans.common import reports


def _points(spark, sf):
    """Reports as positions on a plane; times are shrunk so that tracks hold together."""
    return reports(spark, sf).select("utn", (F.col("t") / 1e6 / 10000).alias("s"), F.col("value").alias("x"), (F.col("code") * 5.0).alias("y"))


def smoothed_tracks(spark, sf):
    return reference_tracks(_points(spark, sf), "utn", "s", "x", "y")


def resampled_tracks(spark, sf):
    return reference_tracks(_points(spark, sf), "utn", "s", "x", "y", step=2.0)


QUERIES = {"smoothed_tracks": smoothed_tracks, "resampled_tracks": resampled_tracks}
