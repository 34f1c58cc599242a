"""Views as query shapes: histograms, grids, scatter series, tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.near import regions_of


def histogram(df: DataFrame, value: str, n: int = 20, by: list[str] | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
    """V1, V2, V4, V5: rows (by..., bin, n): n equal bins, the last one closed; -1 for values without a bin, null for nulls.

    Bounds come from the finite values, or are given to zoom in. With a single value there is one bin.
    """
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    if bounds is None:
        low, high = df.where(finite).agg(F.min(v), F.max(v)).first()
        low, high = (low or 0.0), (high or 0.0)
    else:
        low, high = bounds
    step = (high - low) / n
    place = F.least(F.floor((v - low) / step), F.lit(n - 1)) if step > 0 else F.lit(0)
    bin_ = F.when(v.isNull(), F.lit(None)).when(finite & v.between(low, high), place).otherwise(-1)
    return df.groupBy(*(by or []), bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def integer_bins(low: int, high: int, n: int) -> tuple[int, int]:
    """V3: number and width of the bins of whole numbers."""
    return (max(1, high - low), 1) if (high - low) // n == 0 else (n, (high - low) // n)


def category_histogram(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """V1: a bin for each value."""
    return df.groupBy(*(by or []), value).agg(F.count("*").alias("n"))


def cell_index(value: Column, low: float, high: float, n: int) -> Column:
    """V7: the right edge belongs to the last cell; null outside."""
    return F.when(value.between(low, high), F.least(F.floor((value - low) * (n / (high - low))), F.lit(n - 1)).cast("long"))


def grid(df: DataFrame, x: str, y: str, value: str, box: tuple[float, float, float, float], cells: tuple[int, int]) -> DataFrame:
    """V6, V7: for each cell number, NaNs, extremes, mean, population variance and deviation; rows outside are left out."""
    x0, x1, y0, y1 = box
    rows = df.withColumn("cx", cell_index(F.col(x), x0, x1, cells[0])).withColumn("cy", cell_index(F.col(y), y0, y1, cells[1])).where("cx is not null and cy is not null")
    v = F.col(value).cast("double")
    good = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return rows.groupBy("cx", "cy").agg(
        F.count(good).alias("n"), F.count_if(v.isNotNull() & good.isNull()).alias("n_nan"), F.min(good).alias("min"), F.max(good).alias("max"),
        F.avg(good).alias("mean"), F.var_pop(good).alias("variance"), F.stddev_pop(good).alias("stddev"),
    )


def grid_shape(low: float, high: float, cell: float) -> tuple[float, float, int]:
    """V8: bounds widened to whole cells, and their number."""
    n = max(1, math.ceil((high - low) / cell))
    return low, low + n * cell, n


def scatter_bounds(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Bounds of each series."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.where(known).groupBy(*by).agg(F.count("*").alias("n"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


def report_page(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """A sorted table cut to a number of rows."""
    return df.orderBy(*order).limit(rows)


def surroundings(df: DataFrame, marks: DataFrame, t: str, height: str, around_t: int, around_h: float, box: tuple[str, str] | None = None, identities: tuple[str, ...] = ()) -> DataFrame:
    """Rows near the marked rows, all of them together: in time and height, unknown heights included.

    With box, the two columns of the position: within the marks' box widened by a tenth, at most 0.1, on
    each side. With identities: each of these columns is one of the marks' values, by a semi-join, or null.
    """
    sides = [(c, f"{n}_{c}", f) for c in (box or ()) for n, f in (("min", F.min), ("max", F.max))]
    m = marks.agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.min(height).alias("h0"), F.max(height).alias("h1"), *(f(c).alias(n) for c, n, f in sides)).first()
    if m.t0 is None:
        return df.limit(0)
    near = F.col(t).between(m.t0 - around_t, m.t1 + around_t)
    if m.h0 is not None:
        near &= F.col(height).between(m.h0 - around_h, m.h1 + around_h) | F.col(height).isNull()
    for c in box or ():
        if m[f"min_{c}"] is not None:
            wider = min(0.1, (m[f"max_{c}"] - m[f"min_{c}"]) * 0.1)
            near &= F.col(c).between(m[f"min_{c}"] - wider, m[f"max_{c}"] + wider)
    out = df.where(near)
    for c in identities:
        values = marks.where(F.col(c).isNotNull()).select(F.col(c).alias("_of")).distinct()
        out = out.where(F.col(c).isNull()).unionByName(out.join(values, F.col(c) == F.col("_of"), "left_semi"))
    return out


def surroundings_of_each(df: DataFrame, marks: DataFrame, target: str, key: str, t: str, height: str, around_t: int, around_h: float, box: tuple[str, str], width: int) -> DataFrame:
    """V15 over several targets: the rows near any of them, each within its own times, heights and box: the columns of df, key, once each.

    Each target's region is one row; rows meet regions by time slice, so that neither many targets nor a
    long one goes through the driver. In a slice, rows near to each other meet the regions together.
    """
    sides = [f(c).alias(f"_{n}_{c}") for c in box for n, f in (("min", F.min), ("max", F.max))]
    regions = marks.groupBy(F.col(target).alias("_of")).agg((F.min(t) - around_t).alias(f"low_{t}"), (F.max(t) + around_t).alias(f"high_{t}"), (F.min(height) - around_h).alias(f"low_{height}"), (F.max(height) + around_h).alias(f"high_{height}"), *sides)
    for c in box:
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        wider = F.least(F.lit(0.1), (high - low) * 0.1)
        regions = regions.withColumns({f"low_{c}": low - wider, f"high_{c}": high + wider})
    return regions_of(df.where(F.col(t).isNotNull()), regions, key, [t, height, *box], height, width)


def choose_histogram(df: DataFrame, value: str, n: int = 20, by: list[str] | None = None) -> DataFrame:
    """V1: bins of a range for measures and times, else, for text and for whole numbers with fewer values than bins, one bin a value.

    -> (by..., bin as text, n): the number of the bin, or the value.
    """
    kind = df.schema[value].dataType.simpleString()
    measure = kind in ("float", "double") or kind.startswith(("decimal", "timestamp"))
    few = kind == "string" or kind == "boolean" or not measure and df.select(value).distinct().limit(n).count() < n
    if few:
        return category_histogram(df, value, by).select(*(by or []), F.col(value).cast("string").alias("bin"), "n")
    if measure:
        return histogram(df, value, n, by).withColumn("bin", F.col("bin").cast("string"))
    low, high = df.agg(F.min(value), F.max(value)).first()
    bins, step = integer_bins(low, high, n)
    place = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).cast("string")
    return df.groupBy(*(by or []), place.alias("bin")).agg(F.count("*").alias("n"))


def feature_histograms(details: DataFrame, features: dict[str, str], by: list[str], n: int = 20) -> DataFrame:
    """Histograms of the details of requirements: (feature, by..., bin, n)."""
    parts = [histogram(details, c, n, by).withColumn("feature", F.lit(name)) for name, c in features.items()]
    return reduce(DataFrame.unionByName, parts)


def feature_grids(details: DataFrame, features: dict[str, str], x: str, y: str, box: tuple[float, float, float, float], cells: tuple[int, int] = (512, 512)) -> DataFrame:
    """Grids of the details of requirements over their positions: (feature, cx, cy, statistics)."""
    parts = [grid(details, x, y, c, box, cells).withColumn("feature", F.lit(name)) for name, c in features.items()]
    return reduce(DataFrame.unionByName, parts)


def dropped_of_grid(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """V7: rows inside and outside the box of a grid."""
    inside = F.coalesce(F.col(x).between(box[0], box[1]) & F.col(y).between(box[2], box[3]), F.lit(False))
    return df.agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_dropped"))


def scatter(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The points of series: by..., x, y of rows that have both."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
