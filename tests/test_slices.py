import random

import pytest
from test_reconstruction import SCHEMA, frame, traffic
from trackloom.operators.association import hash_associations
from trackloom.operators.reconstruction import Limits, Names
from trackloom.operators.timeline import day_rollover_reset
from trackloom.streaming.slices import Slices

LIMITS = Limits(track_gap=50, window=15, good=1.0, dubious=2.0, not_ok=5.0)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small steps: more tasks would only take longer."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    """Any split into batches, with a stop in between, and each report is written once."""
    rows = [r for r in traffic(5, 160, 4) if r["t"] < 200]
    whole = Slices(f"{tmp_path}/whole", Names(), LIMITS, 120, 20)
    want = {r.id: r.target_key for r in whole.run(frame(spark, rows)).collect()}
    assert set(want) == {r["id"] for r in rows}
    r = random.Random(1)
    in_time = sorted(rows, key=lambda x: (x["t"], x["id"]))
    cuts = sorted(r.sample(range(1, len(rows)), 3))
    parts = [in_time[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    parts = [r.sample(p, len(p)) for p in parts]
    sliced = Slices(f"{tmp_path}/stream", Names(), LIMITS, 120, 20)
    for n, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n in (1, 3):
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            sliced.stream(stream, f"{tmp_path}/checkpoint").awaitTermination()
    sliced.advance(spark, to_end=True)
    got = sliced.targets(spark).collect()
    assert len(got) == len(want) and {r.id: r.target_key for r in got} == want
    # nothing is left to do, and a second run changes nothing
    sliced.advance(spark, to_end=True)
    assert {r.id: r.target_key for r in sliced.targets(spark).collect()} == want


def automaton(times, near=300.0, far=600.0):
    """The sequential rule."""
    day, late, recent, out = 0, False, False, []
    for tod in times:
        if tod is None or not 0 <= tod <= 86400:
            out.append(None)
            continue
        late |= tod >= 86400 - near
        vicinity = tod <= near or tod >= 86400 - near
        outside = tod <= 86400 - far if tod > 43200 else tod >= far
        if recent and outside:
            recent = False
        if vicinity and not recent and late and tod <= near:
            day, recent = day + 1, True
        out.append((day - (1 if vicinity and tod > near and day else 0)) * 86400 + tod)
        if outside:
            recent = late = False
    return out


def test_rollover_with_reset(spark):
    r = random.Random(2)
    places = [0.0, 100.0, 300.0, 301.0, 599.0, 600.0, 5000.0, 43200.0, 80000.0, 85800.0, 85801.0, 86099.0, 86100.0, 86390.0, 86400.0, 90000.0, -1.0, None]
    rows, want = [], {}
    for s in range(30):
        times = [r.choice(places) for _ in range(60)]
        rows += [(s, 3 * i, t) for i, t in enumerate(times)]
        want |= {(s, 3 * i): x for i, x in enumerate(automaton(times))}
    df = spark.createDataFrame(rows, "s long, i long, tod double").repartition(4)
    for width in (5, 40, 1000):
        got = {(x.s, x.i): x.seconds for x in day_rollover_reset(df, "s", "i", "tod", width=width).collect()}
        assert got == want


def test_hashes(spark):
    r = random.Random(3)
    users = [(i, r.randrange(1000), ";".join(r.choice("abcde") for _ in range(r.randrange(3)))) for i in range(80)]
    given = [(1000 + i, r.randrange(1000), r.choice("abcd")) for i in range(120)]
    got = hash_associations(spark.createDataFrame(users, "id long, t long, hashes string"), spark.createDataFrame(given, "id long, t long, h string"), "hashes", "h", "t", 60, 5, 30, 20, 2, 60)
    want = set()
    first, last = min(u[1] for u in users), max(u[1] for u in users)
    for i, t, hashes in users:
        for h in {x for x in hashes.split(";") if x}:
            met = sorted((abs(g - t), j, g - t) for j, g, k in given if k == h and -60 <= g - t <= 5)
            close = [d for _, _, d in met if -20 <= d <= 2]
            if not met:
                want.add((i, h, None, None, 0, "missing at an end" if t - first <= 60 or last - t <= 60 else "missing"))
            else:
                d = met[0][2]
                want.add((i, h, met[0][1], d, len(met), "dubious distant" if d <= -30 else "dubious collision" if -20 <= d <= 2 and len(close) > 1 else "found"))
    assert {tuple(x) for x in got.collect()} == want and len({w[-1] for w in want}) == 5
