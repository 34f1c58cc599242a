import math
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from trackloom.llm import mixing
from trackloom.llm.mixing import SHARE, WEIGHTS, source_targets, systematic_copies

SCHEMA = "doc_id long, text string, source string"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = SHARE * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            out[s] = 2 * sizes[s] if full else per * weight[s]
            left -= out[s]
        open_ -= full or open_
    return out


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = targets(dict(sizes)), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    return {s: (taken[s], want[s]) for s in want}


def test_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000000)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 2000000))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = systematic_copies(docs).collect()
    longest = max(r.size for r in got)
    for taken, want in check(rows, got).values():
        assert abs(taken - want) <= 0.05 * want + longest
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, systematic_copies(docs).collect()), key=str)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x y", None), (3, "one two three", "b"), (3, "one two three", "b")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", size int, class int")
    check(rows, systematic_copies(docs).collect())
    assert systematic_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.taken for r in systematic_copies(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()] == [0]


@pytest.mark.parametrize("rows_of_slice", [3, 50_000])
def test_copies_against_a_plain_prefix_sum(spark, sf_dir, monkeypatch, rows_of_slice):
    """Along the stated order, a document is taken once for each integer that the running sum of expected copies crosses."""
    monkeypatch.setattr(mixing, "ROWS", rows_of_slice)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    docs = docs.unionByName(spark.createDataFrame([(None, f"null {i}", "en", "src0", 9) for i in range(20)] + [(10**6, "long " * 300_000, "en", "src1", 1)], docs.schema))
    n = docs.count()
    hashes = docs.select("doc_id", "text", "source", F.xxhash64("doc_id", "text", F.lit(0)).alias("h"), (F.pmod(F.xxhash64("source", F.lit(0), F.lit("offset")), F.lit(1 << 40)) / float(1 << 40)).alias("offset")).collect()
    sizes = defaultdict(int)
    for r in hashes:
        sizes[r.source] += len((r.text or "").split())
    want, rate = [], {s: t / sizes[s] if sizes[s] else 0 for s, t in targets(dict(sizes)).items()}
    for source in sizes:
        own = []
        for r in hashes:
            if r.source == source:
                size = len((r.text or "").split())
                own.append((math.floor(math.log2(size + 1) * mixing.CLASSES), r.h % (1 + n // rows_of_slice), r.h, size, r.doc_id, r.offset))
        for i, (*_, size, doc_id, offset) in enumerate(sorted(own, key=lambda x: x[:3])):
            want.append((doc_id, size, math.floor((i + 1) * rate[source] + offset) - math.floor(i * rate[source] + offset)))
    got = [(r.doc_id, r.size, r.copies) for r in systematic_copies(docs).collect()]
    differ = set(got) ^ set(want)
    assert len(got) == len(want) == n and len(differ) <= 2  # a sum that rounds to just beside an integer


def test_equal_rows_are_ordered_as_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 7)
    rows = [(None, "", "a")] * 300 + [(5, "same words here", "a")] * 200 + [(i, "one two " * (i % 5), "a" if i % 3 else None) for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = systematic_copies(docs).collect()
    for taken, want in check(rows, got).values():
        assert abs(taken - want) <= 0.05 * want + 10
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, len(t.split())) for d, t, _ in rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, systematic_copies(docs.repartition(3)).collect()), key=str)


def test_many_sources(spark):
    rows = [(f"host{i * 7919 % 5000}", i % 13) for i in range(5000)] + [(None, 4)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long").repartition(7)).collect()}
    want = targets(dict(rows))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in got)
