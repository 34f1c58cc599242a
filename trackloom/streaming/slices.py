"""Reconstruction slice by slice, on a table or on a stream, with what was found carried from slice to slice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackloom.operators.graph import connected
from trackloom.operators.reconstruction import Limits, Names, reconstruct


@dataclass
class Slices:
    """A store of reports, results and state under a path; slice k reads [k * step, k * step + width) and writes its first `step`.

    step is width less overlap, which must be at least the window of the limits. A slice is judged when a
    report as late as its end has been seen, so that its result doesn't depend on how reports came in
    batches; a report that comes after its slice was written is too late and stays out of the results.

    A slice is judged together with a few reports of earlier ones, whose targets are known: the last of
    each track, the last of each identification with an address, and those within the window before the
    slice. Later evidence may join two known targets: `joins` says so, and `targets` follows it.

    Each folder is written as a whole and counts when it is complete; the state is written last, so that
    after a restart a slice that was not finished is judged again from the same input.
    """

    path: str
    names: Names
    limits: Limits
    width: int
    overlap: int

    @property
    def step(self) -> int:
        return self.width - self.overlap

    def add(self, batch: DataFrame, number: int) -> None:
        """A batch of reports; the same number again overwrites what it wrote before."""
        rows = batch.select("id", *self.names.every).where(F.col(self.names.t).isNotNull()).withColumn("slot", F.floor(F.col(self.names.t) / self.step))
        rows.write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/reports/batch={number}")

    def advance(self, spark: SparkSession, to_end: bool = False) -> None:
        """Judge the slices that are complete, or all up to the last report."""
        done = self._done(spark, "state", "slice")
        slots = [slot for _, slot in self._slots(spark)]
        if not slots:
            return
        newest = self._reports(spark).where(F.col("slot") == max(slots)).agg(F.max(self.names.t)).first()[0]
        k = max(done) + 1 if done else min(slots)
        while k <= max(slots) and (to_end or newest >= k * self.step + self.width):
            self._judge(spark, k, k - 1 if done or k > min(slots) else None)
            k += 1

    def _judge(self, spark: SparkSession, k: int, before: int | None) -> None:
        c, begin, end = self.names, k * self.step, (k + 1) * self.step
        rows = self._reports(spark).where(F.col("slot").between(k, k + -(-self.width // self.step)) & (F.col(c.t) < begin + self.width))
        rows = rows.dropDuplicates(["id"]).select("id", *c.every).withColumn("known_key", F.lit(None).cast("string"))
        if before is not None:
            rows = rows.unionByName(spark.read.parquet(f"{self.path}/state/slice={before}"))
        found = reconstruct(rows, c, self.limits, new=f"@{k}").withColumnRenamed("target_key", "found")
        both = rows.join(found, "id").cache()
        both.where(F.col("known_key").isNull() & (F.col(c.t) < end)).select("id", F.col("found").alias("target_key")).write.mode("overwrite").parquet(f"{self.path}/targets/slice={k}")
        joins = both.where("known_key <> found").select(F.col("known_key").alias("one"), F.col("found").alias("two")).distinct()
        joins.write.mode("overwrite").parquet(f"{self.path}/joins/slice={k}")
        self._state(both.where((F.col(c.t) < end) & F.col("found").isNotNull()), end).write.mode("overwrite").parquet(f"{self.path}/state/slice={k}")
        both.unpersist()

    def _state(self, rows: DataFrame, end: int) -> DataFrame:
        """What later slices need of the reports judged so far, a subset of them."""
        c = self.names
        order = F.struct(c.t, "id")
        last = lambda some, by: some.groupBy(*by).agg(F.max_by("id", order).alias("id")).select("id")
        needed = last(rows.where(F.col(c.track).isNotNull() & (F.col(c.rank) < 2)), [c.source, c.track])
        needed = needed.unionByName(last(rows.where(F.col(c.identification).isNotNull() & F.col(c.address).isNotNull()), [c.identification, c.rank]))
        # one without an address keeps its name by its last report
        needed = needed.unionByName(last(rows.where(F.col(c.identification).isNotNull()), [c.identification]))
        needed = needed.unionByName(rows.where(F.col(c.t) >= end - self.limits.window).select("id"))
        return rows.join(needed.distinct(), "id", "left_semi").select("id", *c.every, F.col("found").alias("known_key"))

    def targets(self, spark: SparkSession) -> DataFrame:
        """id, target_key of all slices judged so far, joined targets under the smallest key, which has the address if one has."""
        found, joins = (spark.read.parquet(f"{self.path}/{kind}") for kind in ("targets", "joins"))
        parts = connected(joins.select(F.col("one").alias("a"), F.col("two").alias("b")))
        return found.join(parts.withColumnRenamed("node", "target_key"), "target_key", "left").select("id", F.coalesce("component", "target_key").alias("target_key"))

    def run(self, reports: DataFrame) -> DataFrame:
        """The slices of a table in order."""
        self.add(reports, 0)
        self.advance(reports.sparkSession, to_end=True)
        return self.targets(reports.sparkSession)

    def stream(self, reports: DataFrame, checkpoint: str) -> StreamingQuery:
        """The same on a stream; each batch is stored, then the slices that have become complete are judged."""

        def write(batch: DataFrame, number: int) -> None:
            self.add(batch, number)
            self.advance(batch.sparkSession)

        return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _reports(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/reports").parquet(f"{self.path}/reports").drop("batch")

    def _files(self, spark: SparkSession, pattern: str) -> list[str]:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern))
        return [s.getPath().toString() for s in found or []]

    def _slots(self, spark: SparkSession) -> list[tuple[str, int]]:
        return [(f, int(f.rpartition("=")[2])) for f in self._files(spark, "reports/batch=*/slot=*")]

    def _done(self, spark: SparkSession, kind: str, name: str) -> list[int]:
        return [int(f.rpartition("/")[0].rpartition("=")[2]) for f in self._files(spark, f"{kind}/{name}=*/_SUCCESS")]
