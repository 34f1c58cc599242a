import importlib.util

import pytest
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline as cp
from trackloom.llm.pii import base_spans


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = []
    for name, f in cp.STAGES:
        out = f(spark, docs, sf_dir)
        out = out.cache()
        if name != "mix":
            assert out.columns == cp.COLUMNS
        assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
        ids.append({r.doc_id for r in out.select("doc_id").collect()})
        if name == "personal_data":
            assert not any(base_spans(r.text) for r in out.collect())
            changed = out.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").where("text <> was").collect()
            assert changed and all(base_spans(r.was) for r in changed) and all(r.n_chars == len(r.text) for r in changed)
        docs = out
    assert len(ids[0]) > len(ids[1]) > len(ids[2]) == len(ids[3])
    assert docs.count() > 0 and docs.agg(F.max("copy")).first()[0] == 2


def test_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy int"
    words = " ".join(f"word{i}" for i in range(50))
    docs = spark.createDataFrame([(1, words, None, None, None, 1), (1, words, None, None, None, 1), (2, None, "en", "a", 0, 1), (3, "", "en", "a", 0, 1), (None, words, "en", "a", 0, 1), (4, words + " a@b.cc", "en", "a", 0, 1)], schema)
    for name, f in cp.STAGES:
        for d in (docs, docs.limit(0)):
            rows = f(spark, d, sf_dir).collect()
            assert d is docs or rows == []
            if name == "near_dedup" and d is docs:
                assert sorted(r.doc_id or 0 for r in rows) == [1, 2, 3]


def test_rows_with_null_and_shared_ids(spark, sf_dir):
    """Each row is judged by itself; nothing leaks or vanishes by its doc_id."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    clean = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(None, item), (None, clean[0]), (7, item), (7, clean[1]), (8, "long " + " ".join(f"w{i}" for i in range(200_000)) + " " + item), (9, clean[2]), (9, clean[2] + " end"), (None, clean[3]), (None, clean[3])]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], schema)
    left = sorted((r.doc_id or 0, r.text[:2]) for r in cp.decontaminate(spark, docs, sf_dir).collect())
    assert left == [(0, "a0"), (0, "d0"), (0, "d0"), (7, "b0"), (9, "c0"), (9, "c0")]
    left = sorted((r.doc_id or 0, r.text[:2]) for r in cp.near_dedup(spark, docs, sf_dir).collect())
    assert left == sorted([(0, "a0"), (7, item[:2]), (7, "b0"), (8, "lo"), (9, "c0"), (0, "d0")])
    assert cp.personal_data(spark, docs, sf_dir).count() == len(rows)
    assert all(r.source_target and r.copy in (1, 2) for r in cp.mix(spark, docs, sf_dir).collect())


def test_numbers_stay_however_scans_are_split(spark, sf_dir):
    docs = cp.keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    seen, name = [], "spark.sql.files.minPartitionNum"
    try:
        for n in (2, 12, 31):
            spark.conf.set(name, n)
            seen.append({(r.row, r.doc_id) for r in docs.select("row", "doc_id").collect()})
    finally:
        spark.conf.unset(name)
    assert seen[0] == seen[1] == seen[2] and len({r for r, _ in seen[0]}) == docs.count()
