"""Changes of content tables as new DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.staging import row_numbers


def update_by_key(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of rows whose key is in changes take the new values, nulls too. Keys of changes are unique."""
    new = changes.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    rows = df.join(new, df[key] == F.col("_k"), "left")
    return rows.withColumns({c: F.when(F.col("_k").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def upsert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of their key and are added."""
    return df.join(rows.select(key).distinct(), key, "left_anti").select(*df.columns).unionByName(rows.select(*df.columns))


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is null stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def set_null(df: DataFrame, column: str) -> DataFrame:
    """S9."""
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def union_contents(contents: dict[str, DataFrame]) -> DataFrame:
    """All contents under one another, columns they lack as nulls, with their name as content."""
    named = [df.withColumn("content", F.lit(name)) for name, df in contents.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def cut_prefix(df: DataFrame, t: str, newest: Column | int) -> DataFrame:
    """Rows from a time on."""
    return df.where(F.col(t) >= newest)


def retained(df: DataFrame, t: str, keep: int) -> DataFrame:
    """T2 in batch: rows at most `keep` older than the newest."""
    return df.where(F.col(t) >= df.agg(F.max(t)).first()[0] - keep) if not df.isEmpty() else df


def numbered(df: DataFrame, order: list[Column], content: int) -> DataFrame:
    """Record numbers: a counter in the given order with the content id packed in; no task sees all rows."""
    rows = row_numbers(df, order, "rec_num")
    return rows.withColumn("rec_num", F.col("rec_num") * 256 + content)


def append_numbered(df: DataFrame, new: DataFrame, order: list[Column], content: int) -> DataFrame:
    """New rows go on from the largest record number that is there."""
    largest = df.agg(F.max("rec_num")).first()[0] or 0
    more = numbered(new, order, content)
    return df.unionByName(more.withColumn("rec_num", F.col("rec_num") + F.lit(largest - largest % 256)))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns with nulls only go."""
    filled = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if filled[c]))


def update_cell(df: DataFrame, key: str, value, column: str, new) -> DataFrame:
    """One column of the rows of a key takes a value."""
    return df.withColumn(column, F.when(F.col(key) == value, F.lit(new)).otherwise(F.col(column)).cast(df.schema[column].dataType))


def delete_sources(df: DataFrame, source: str, values: list, line: tuple[str, int] | None = None) -> DataFrame:
    """Reports of sources, of one of their lines if given, go."""
    gone = F.col(source).isin(values)
    return delete(df, gone if line is None else gone & (F.col(line[0]) == line[1]))


def compacted(df: DataFrame, by: list[str], files: int) -> DataFrame:
    """Rows dealt to so many files, in order of the columns by which they are read, ready to be written elsewhere."""
    return df.repartitionByRange(files, *by).sortWithinPartitions(*by)


def scaled(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Columns multiplied by factors."""
    return df.withColumns({c: F.col(c) * f for c, f in factors.items()})
