"""Aggregates over content tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.staging import stage


def min_max_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A2: smallest and largest value of each column as text, one row for each column."""
    one = df.agg(*(f(c).cast("string").alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"min_{c}").alias("least"), F.col(f"max_{c}").alias("greatest")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in one of the columns, and all rows."""
    some = F.greatest(*(F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 1
    return df.agg(F.count_if(some).alias("n_null"), F.count("*").alias("n_rows"))


def distinct_counts(df: DataFrame, column: str) -> DataFrame:
    """A5: distinct values, nulls aside, with their numbers."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def column_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column the nulls and whether it is empty or full."""
    one = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("name"), (F.col("_n") - F.col(c)).alias("n_null"), (F.col(c) == 0).alias("all_null"), (F.col(c) == F.col("_n")).alias("never_null")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def target_summary(df: DataFrame, key: str, t: str, source: str, code: str, height: str) -> DataFrame:
    """For each target updates, times, sources, code set and height range."""
    return df.groupBy(key).agg(
        F.count("*").alias("n_updates"), F.min(t).alias("first"), F.max(t).alias("last"), F.count_distinct(F.col(source)).alias("n_sources"),
        F.array_join(F.sort_array(F.collect_set(F.lpad(F.col(code).cast("string"), 4, "0"))), ",").alias("codes"), F.min(height).alias("min_height"), F.max(height).alias("max_height"),
    )


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of each group: by..., one column for each share.

    Different values are counted first and sorted by range into partitions of about as many; a value's
    place is its place in its partition plus the counts of the partitions before, and the values at the
    places asked for are minima. Partitions follow ranks, not the range of the values, so that neither a
    large group nor an outlier leaves one task with the rest.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    counts = stage(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # one row for each group and partition that it is in
    parts = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*by, "_part", before.alias("_before"), F.sum("_m").over(group).alias("_all"))
    at = {n: (F.col("_all") - 1) * s for n, s in shares.items()}
    placed = counts.join(parts, [*by, "_part"])
    placed = placed.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v")))
    bounds = [F.min(F.when(F.col("_upto") > f(p), F.col("_v"))).alias(f"_{side}_{n}") for n, p in at.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    out = placed.groupBy(*by).agg(F.max("_all").alias("_all"), *bounds)
    share = lambda n: at[n] - F.floor(at[n])
    return out.select(*by, *((F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * share(n)).alias(n) for n in shares))


def robust(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, quartile distance and median absolute deviation."""
    middle = quantiles(df, by, value, {"median": 0.5, "_q1": 0.25, "_q3": 0.75})
    middle = stage(middle.select(*by, "median", (F.col("_q3") - F.col("_q1")).alias("iqr")))
    spread = quantiles(df.join(middle, by).withColumn("_off", F.abs(F.col(value) - F.col("median"))), by, "_off", {"mad": 0.5})
    return middle.join(spread, by)


def weighted_mean(value: Column, weight: Column) -> Column:
    """A12."""
    return F.sum(value * weight) / F.sum(weight)


def top_trimmed_mean(df: DataFrame, by: list[str], value: str, removed: float) -> DataFrame:
    """The mean of each group's values up to the quantile 1 - removed."""
    limit = quantiles(df, by, value, {"_limit": 1 - removed})
    return df.join(limit, by).where(F.col(value) <= F.col("_limit")).groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def unique_values(df: DataFrame, value: str, index: str) -> DataFrame:
    """Each value that isn't null, with its first index and its number of rows."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(index).alias("first_index"), F.count("*").alias("n"))


def values_with_indexes(df: DataFrame, value: str, index: str, most: int) -> DataFrame:
    """A5: each value with its number of rows and its `most` smallest indexes: the list is a report's, the rows stay in df."""
    place = Window.partitionBy(value).orderBy(index)
    few = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(place))
    lists = few.where(F.col("_n") <= most).groupBy(value).agg(F.sort_array(F.collect_list(index)).alias("indexes"))
    return distinct_counts(df, value).join(lists, value)


def null_indexes(df: DataFrame, column: str, index: str) -> DataFrame:
    """The indexes of rows without a value."""
    return df.where(F.col(column).isNull()).select(index)


def weighted_deviation(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and deviation from sums alone, which add up over parts."""
    v, w = F.col(value), F.col(weight)
    sums = df.groupBy(*by).agg(F.sum(w).alias("_w"), F.sum(w * v).alias("_wv"), F.sum(w * v * v).alias("_wvv"))
    mean = F.col("_wv") / F.col("_w")
    return sums.select(*by, mean.alias("mean"), F.sqrt(F.greatest(F.col("_wvv") / F.col("_w") - mean * mean, F.lit(0.0))).alias("stddev"))


def extent(contents: list[DataFrame], t: str, x: str, y: str) -> DataFrame:
    """First and last time and the box of all contents; one without a column counts by what it has."""
    one = [df.select(*((F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in (t, x, y))) for df in contents]
    return reduce(DataFrame.unionByName, one).agg(*(f(c).alias(f"{n}_{c}") for c in (t, x, y) for n, f in (("min", F.min), ("max", F.max))))


def target_details(df: DataFrame, key: str, t: str, identities: dict[str, str], x: str, y: str, height: str, primary: Column) -> DataFrame:
    """For each target updates, duration, sets of identities, box, heights and whether it has primary reports only.

    identities: name -> column; their sets are sorted lists of what isn't null.
    """
    sets = [F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(n) for n, c in identities.items()]
    box = [f(c).alias(f"{n}_{c}") for c in (x, y, height) for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(key).agg(F.count("*").alias("n_updates"), (F.max(t) - F.min(t)).alias("duration"), *sets, *box, (F.min(F.coalesce(primary, F.lit(False)).cast("int")) == 1).alias("primary_only"))
