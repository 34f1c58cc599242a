import os

import pandas as pd
from pyspark.sql import functions as F

from trackloom.streaming import live


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _run(out, name, empty="false"):
    # a processing-time timeout asks for empty batches without end; windows are only closed by one
    out.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", empty)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return out.sparkSession.table(name)


def test_repeats_and_future(spark, tmp_path):
    s = _stream(spark, tmp_path, [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00")], "id long, at string").withColumn("ts", F.to_timestamp("at"))
    now = F.to_timestamp(F.lit("2024-01-01 00:00:30"))
    got = _run(live.without_repeats(live.accepted(s, "ts", now), "ts", ["id"]), "t_repeats").collect()
    assert [r.id for r in got] == [1]


def test_online_tracks(spark, tmp_path):
    rows = [(1, float(t), 100.0 * t, 0.0) for t in (4, 0, 2, 6, 8)] + [(2, 0.0, 5.0, 5.0)]
    s = _stream(spark, tmp_path, rows, "k long, t double, x double, y double")
    got = _run(live.online_tracks(s, "k"), "t_tracks").toPandas()
    one = got[got.key == 1].sort_values("t")
    assert list(one.t) == [0, 2, 4, 6, 8] and abs(one.vx.iloc[-1] - 100) < 10 and len(got) == 6 and isinstance(got, pd.DataFrame)


def test_store_is_written_once_and_forgets(spark, tmp_path):
    """A batch that runs again overwrites what it wrote; parts older than the retention go."""
    rows = [(i, f"2024-01-01 {h:02d}:10:00") for i, h in enumerate((1, 2, 3, 5, 6))]
    s = _stream(spark, tmp_path, rows, "id long, at string").withColumn("ts", F.to_timestamp("at"))
    store, state = str(tmp_path / "store"), tmp_path / "state"
    live.keep_in_store(s, store, "ts", lambda df: df, str(state), "hour", "90 minutes").awaitTermination()
    assert sorted(r.id for r in live.read_store(spark, store).collect()) == [3, 4]
    (state / "commits" / "0").unlink()  # as if the driver was lost after the write and before the commit
    for crc in (state / "commits").glob(".0*"):
        crc.unlink()
    live.keep_in_store(s, store, "ts", lambda df: df, str(state), "hour", "90 minutes").awaitTermination()
    assert sorted(r.id for r in live.read_store(spark, store).collect()) == [3, 4]
    assert [r.id for r in live.read_store(spark, store, "2024-01-01 06").collect()] == [4]


def test_rates_sessions_and_filters_on_a_stream(spark, tmp_path):
    rows = [(1, "a", f"2024-01-01 00:00:{i:02d}", 8 * i) for i in range(0, 60, 10)] + [(2, "a", "2024-01-01 00:20:00", 8)]
    s = _stream(spark, tmp_path, rows, "id long, src string, at string, mode_a long").withColumn("ts", F.to_timestamp("at"))
    plain = lambda df: df.where("window.start < '2024-01-01 00:10:00'")
    got = _run(live.rates(s, "ts", ["src"], "30 seconds", "1 second"), "t_rates", "true")
    assert sorted(r.n for r in plain(got).collect()) == [3, 3]
    got = _run(live.live_filters(s, modes="0,10").select("id", "mode_a"), "t_filters")
    assert sorted(r.mode_a for r in got.collect()) == [0, 8]
    got = _run(live.track_sessions(s, "ts", ["src"], "5 minutes", "1 second"), "t_sessions", "true")
    assert [r.n for r in got.collect()] == [6]


def test_late_and_timeless_reports_leave_the_store(spark, tmp_path):
    store, batches = str(tmp_path / "store"), [[(1, "10:10"), (2, "11:10")], [(3, "03:10"), (4, None)], [(5, "15:10")], [(6, "14:50"), (7, "09:00")]]
    left = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, at string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema("id long, at string").parquet(str(tmp_path / "in")).withColumn("ts", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "at")))
        live.keep_in_store(s, store, "ts", lambda df: df, str(tmp_path / "state"), "hour", "60 minutes").awaitTermination()
        left.append(sorted(r.id for r in live.read_store(spark, store).collect()))
        assert n < 4
    assert left == [[1, 2], [1, 2], [5], [5, 6]]


def test_a_slow_consumer_skips_whole_batches(spark, tmp_path):
    """Files arrive every 30 s; writing one takes 50 s, skipping none: it falls behind, skips, and is in time again."""
    for i in range(12):
        spark.createDataFrame([(i, 30.0 * i), (100 + i, 30.0 * i - 5)], "id long, t double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if f.stat().st_mtime > 1e9:  # the new one: files are read in the order of their times
                os.utime(f, (i + 1, i + 1))
    clock, wrote = [0.0], []

    def write(batch, number):
        wrote.extend(r.id for r in batch.collect())
        clock[0] += 50

    def now():
        newest = 30.0 * len(seen)
        seen.append(1)
        clock[0] = max(clock[0], newest)
        return clock[0]

    seen: list[int] = []
    s = spark.readStream.schema("id long, t double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    log = str(tmp_path / "log")
    s.writeStream.foreachBatch(live.admitted(write, "ts", 60.0, now, log)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = sorted(spark.read.parquet(log).collect(), key=lambda r: r.batch)
    assert len(rows) == 12 and {r.skipped for r in rows} == {True, False}
    assert all(r.skipped == (r.latency > 60) for r in rows) and len(wrote) == sum(r.n for r in rows if not r.skipped)
    assert not rows[-1].skipped or not rows[-2].skipped
