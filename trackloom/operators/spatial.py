"""Sectors and distances. Sectors are few and small: they become literals of the plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalar import FOOT, haversine, polar_to_position
from trackloom.operators.filters import all_of, any_of


@dataclass(frozen=True)
class Sector:
    """A polygon of (x, y) corners with an optional altitude range; exclusions cut holes into their layer."""

    name: str
    corners: tuple[tuple[float, float], ...]
    low: float | None = None
    high: float | None = None
    exclusion: bool = False


def in_box(sector: Sector, x: Column, y: Column) -> Column:
    xs, ys = zip(*sector.corners, strict=True)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))


def in_polygon(sector: Sector, x: Column, y: Column) -> Column:
    """G1: an odd number of edges to the right of the point; the box is tested first, as Parquet can skip by it."""
    edges = list(zip(sector.corners, sector.corners[1:] + sector.corners[:1], strict=True))
    crossed = [((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) for (x1, y1), (x2, y2) in edges if y1 != y2]
    return in_box(sector, x, y) & (sum((c.cast("int") for c in crossed), F.lit(0)) % 2 == 1)


def inside_sector(sector: Sector, x: Column, y: Column, altitude: Column | None = None, ground: Column | None = None) -> Column:
    """G1: altitude limits hold for positions with an altitude; those on ground aren't above a lower limit."""
    terms = [in_polygon(sector, x, y)]
    if altitude is not None:
        terms += [F.coalesce(altitude >= sector.low, F.lit(True))] * (sector.low is not None) + [F.coalesce(altitude <= sector.high, F.lit(True))] * (sector.high is not None)
    if ground is not None and sector.low is not None:
        terms.append(~F.coalesce(ground, F.lit(False)))
    return all_of(terms)


def inside_layer(sectors: list[Sector], x: Column, y: Column, altitude: Column | None = None, ground: Column | None = None) -> Column:
    """In any sector of the layer and in none of its exclusions."""
    of = lambda kind: any_of(inside_sector(s, x, y, altitude, ground) for s in sectors if s.exclusion == kind)
    return of(False) & ~of(True)


def layer_flags(df: DataFrame, layers: dict[str, list[Sector]], x: str, y: str, altitude: str | None = None) -> DataFrame:
    """A boolean column for each layer."""
    h = None if altitude is None else F.col(altitude)
    return df.withColumns({name: inside_layer(s, F.col(x), F.col(y), h) for name, s in layers.items()})


def covered(circles: list[tuple[float, float, float]], lat: Column, lon: Column) -> Column:
    """Within the range in metres of a sensor; without sensors everything is covered."""
    return any_of(haversine(F.lit(a), F.lit(b), lat, lon) <= r for a, b, r in circles) if circles else F.lit(True)


def above_minimum_height(layers: list[tuple[Sector, float]], x: Column, y: Column, height: Column) -> Column:
    """Not below the least height of any airspace sector in which the position lies; unknown heights pass."""
    below = any_of(in_polygon(s, x, y) & (height < least) for s, least in layers)
    return ~F.coalesce(below, F.lit(False))


def fill_positions(plots: DataFrame, radars: DataFrame, source: str, slant: str, azimuth: str, height_ft: str) -> DataFrame:
    """Lat and lon of plots that lack them from range, azimuth and height, by their radar: radars(source, lat, lon, altitude).

    A plot whose radar is unknown, or without range or azimuth, stays without a position.
    """
    r = radars.select(F.col(source).alias("_src"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("altitude").alias("_alt"))
    rows = plots.join(r, F.col(source) == F.col("_src"), "left")
    lat, lon = polar_to_position(F.col("_lat"), F.col("_lon"), F.col(slant), F.col(azimuth), F.col(height_ft) * FOOT, F.col("_alt"))
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    return rows.withColumn("_a", lat).withColumn("_o", lon).withColumns({"lat": F.when(missing, F.col("_a")).otherwise(F.col("lat")), "lon": F.when(missing, F.col("_o")).otherwise(F.col("lon"))}).select(*plots.columns)
