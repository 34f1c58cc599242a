"""Live operation with Structured Streaming: retention, filters and an online tracker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.operators import filters as P
from trackloom.operators.tracking import RESET, motion


def accepted(stream: DataFrame, ts: str, now: Column, latest: str = "3 minutes", skew: str = "60 seconds") -> DataFrame:
    """Reports neither from the future nor too late to be worth showing."""
    t = F.col(ts)
    return stream.where((t <= now + F.expr(f"interval {latest}")) & (t >= now - F.expr(f"interval {skew}")))


def without_repeats(stream: DataFrame, ts: str, keys: list[str], keep: str = "5 minutes") -> DataFrame:
    """Each report once within the retention; state older than it is dropped with the watermark."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark(keys)


def rates(stream: DataFrame, ts: str, by: list[str], every: str, late: str) -> DataFrame:
    """Reports by source and tumbling window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), *by).agg(F.count("*").alias("n"))


def track_sessions(stream: DataFrame, ts: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of tracks on a stream."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


def keep_in_store(stream: DataFrame, path: str, ts: str, transform: Callable[[DataFrame], DataFrame], checkpoint: str, by: str = "hour", keep: str | None = None) -> StreamingQuery:
    """Every micro-batch is transformed and stored by time (part) and batch; what is older than `keep` goes.

    A batch owns its folders batch=<id>/part=<time>: one that is run again after a restart overwrites what
    it wrote before, so that nothing is doubled. With keep, an interval such as "60 minutes", each batch
    deletes the parts that end before the newest time less keep, whole folders at a time: the newest of
    this batch or the begin of the newest part in the store, so that a late batch neither keeps nor
    restores what is too old. Reports without a time can't grow old; they aren't stored.
    """
    name = "yyyy-MM-dd HH'h'mm"

    def write(batch: DataFrame, number: int) -> None:
        time = F.col(ts).cast("timestamp")
        rows = transform(batch).where(time.isNotNull()).withColumn("part", F.date_format(F.date_trunc(by, time), name))
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")
        if keep is not None:
            parts = _parts(batch.sparkSession, path)
            last = F.to_timestamp(F.lit(max(parts, default=None)), name)
            newest = rows.agg(F.date_format(F.date_trunc(by, F.greatest(F.max(time), F.first(last)) - F.expr(f"interval {keep}")), name)).first()[0]
            _drop_before(batch.sparkSession, path, newest or (max(parts) if parts else None))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str):
    """(file system, folder, name of the part) of the parts of a store, by its own file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "batch=*/part=*")) or []:
        yield files, status.getPath(), jvm.java.net.URLDecoder.decode(status.getPath().getName(), "UTF-8")[len("part=") :]


def _parts(spark: SparkSession, path: str) -> list[str]:
    return [part for _, _, part in _folders(spark, path)]


def _drop_before(spark: SparkSession, path: str, newest: str | None) -> None:
    """Delete the folders of parts before newest."""
    for files, folder, part in _folders(spark, path):
        if newest is not None and part < newest:
            files.delete(folder, True)


def admitted(write: Callable[[DataFrame, int], None], ts: str, most: float, now: Callable[[], float], log: str) -> Callable[[DataFrame, int], None]:
    """A writer of micro-batches that skips whole ones when it lags behind, and says what it skipped.

    A batch whose newest report is more than `most` seconds old, by the clock `now` in epoch seconds when
    its turn comes, isn't written: what waits behind it gets its time. log gets a row for each batch:
    batch, n, latency, skipped; a batch that is run again after a restart replaces its row.
    """

    def run(batch: DataFrame, number: int) -> None:
        seen = batch.agg(F.count("*").alias("n"), F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("newest")).first()
        latency = None if seen.newest is None else now() - seen.newest / 1e6
        skipped = latency is not None and latency > most
        if not skipped:
            write(batch, number)
        row = [(number, seen.n, latency, skipped)]
        batch.sparkSession.createDataFrame(row, "batch long, n long, latency double, skipped boolean").coalesce(1).write.mode("overwrite").parquet(f"{log}/part={number}")

    return run


_STATE = "t double, x double, vx double, y double, vy double, p array<double>"


def online_tracks(stream: DataFrame, key: str, sigma: float = 30.0, noise: float = 3.0) -> DataFrame:
    """A Kalman filter for each target over a stream of (key, t, x, y); late reports of a batch are put in order.

    The state is one position, velocity and covariance a target; it goes when a target is silent for long.
    """

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("t")
        t, s, p = None, None, None
        if state.exists:
            t, *s, p = state.get
            s, p = np.array(s), np.array(p).reshape(4, 4)
        out = []
        for r in rows.itertuples():
            z = np.array([r.x, r.y])
            if t is None or r.t - t > RESET or r.t < t:
                if t is not None and r.t < t:
                    continue
                s, p = np.array([r.x, 0.0, r.y, 0.0]), np.diag([sigma**2, 1e4, sigma**2, 1e4])
            else:
                f, q = motion(r.t - t, noise)
                s, p = f @ s, f @ p @ f.T + q
                h = np.eye(4)[[0, 2]]
                gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.eye(2) * sigma**2)
                s, p = s + gain @ (z - h @ s), (np.eye(4) - gain @ h) @ p
            t = r.t
            out.append((keys[0], t, s[0], s[2], s[1], s[3]))
        if t is not None:
            state.update((float(t), *map(float, s), [float(x) for x in p.ravel()]))
            state.setTimeoutDuration(60_000)
        yield pd.DataFrame(out, columns=["key", "t", "x", "y", "vx", "vy"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"key {kind}, t double, x double, y double, vx double, vy double", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_filters(df: DataFrame, modes: str | None = None, addresses: str | None = None, identifications: list[str] | None = None, heights: tuple[float, float] | None = None, primary: bool = False) -> DataFrame:
    """The filters that run live, the same columns on a stream as on a table."""
    if modes is not None:
        df = df.where(P.codes("mode_a", modes, 8))
    if addresses is not None:
        df = df.where(P.codes("acad", addresses, 16))
    if identifications is not None:
        df = df.where(P.contains_any(["acid"], identifications))
    if heights is not None:
        df = df.where(P.between("mode_c", *heights, null=True))
    return df.where(P.all_of(F.col(c).isNull() for c in ("mode_a", "acad", "acid"))) if primary else df


def read_store(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The reports of a store, from a time on by whole partitions; repeats of a restarted batch don't occur."""
    df = spark.read.parquet(path)
    return df if since is None else df.where(F.col("part") >= since)
