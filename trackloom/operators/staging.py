"""Written tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which the driver and all executors see.

    Where it is unset, as in tests, a local session takes a temporary folder; on a cluster that would lose
    what other machines write, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/trackloom-shared"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(found)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, "staged")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_numbers(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with the place of each row in a total order, from 1, without a window over all rows.

    The rows are sorted by range into partitions and counted in each; the partitions before, one row for
    each, are added.
    """
    placed = stage(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as the sort has partitions: the bound of the broadcast
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(parts), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).select(*df.columns, name)
