import hashlib

import pytest
from pyspark.sql import functions as F

from trackloom.llm.warc import _RECORDS, page_captures, read_warc, transactions, write_warc

SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_warc(pages, str(tmp_path / "w"))
    rows = transactions(read_warc(spark, str(tmp_path / "w")))
    got = rows.select(F.col("metadata")[0]["fields"]["pageid"].cast("long"), F.col("response.target_uri"), F.col("response.payload").cast("string"), F.size("requests")).collect()
    want = [(r.page_id, r.url, r.html, 1) for r in pages.collect()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows(spark):
    a, b = "x" * 99, "\r\n\r\nWARC/1.1 ü" * 20
    rows = [(1, "u", None), (2, None, ""), (3, "a b\nc", a), (4, "u", a), (7, "u", b), (6, "v", b), (6, "v", b), (9, "w", b), (None, None, b)]
    got = page_captures(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", key int")).collect()
    size = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    want = [(i, *size(t), "response", None) for i, _, t in rows[:4]] + [(7, *size(b), "revisit", 6), (6, *size(b), "response", None), (6, *size(b), "revisit", 6), (9, *size(b), "revisit", 6), (None, *size(b), "revisit", 6)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert page_captures(spark.createDataFrame([], SCHEMA)).collect() == []


def test_archives_of_others(spark, tmp_path):
    write_warc(spark.createDataFrame([(1, "u", "text")], SCHEMA), str(tmp_path / "w"))
    archive = next((tmp_path / "w").glob("part-*")).read_bytes()
    (tmp_path / "v").mkdir()
    for name in ("CC-MAIN-1.warc.gz", "x.warc", "part-1.gz", "_SUCCESS", ".x.warc.crc"):
        (tmp_path / "v" / name).write_bytes(b"no archive" if name[0] in "_." else archive)
    assert read_warc(spark, str(tmp_path / "v")).count() == 9
    assert read_warc(spark, str(tmp_path / "v"), "*.warc").count() == 3


def test_transactions_with_odd_ids(spark):
    """Requests and metadata without their capture, doubled or without any id: each comes out once, none is lost."""
    empty = {"refers_to": None, "target_uri": None, "stated_digest": None, "http_status": None, "fields": {}, "payload_bytes": 0, "payload_digest": "", "payload": b""}
    rows = [("c1", "response", None), ("r1", "request", "c1"), ("r1", "request", "c1"), ("m1", "metadata", "c1"), ("r2", "request", "gone"), ("m3", "metadata", None), ("c4", "revisit", "x"), ("w", "warcinfo", None)]
    records = spark.createDataFrame([{"record_id": i, "type": t, "concurrent_to": c} | empty for i, t, c in rows], _RECORDS)
    got = {r.capture_id: (r.response is not None, len(r.requests or ()), len(r.metadata or ())) for r in transactions(records).collect()}
    assert got == {"c1": (True, 2, 1), "gone": (False, 1, 0), "m3": (False, 0, 1), "c4": (True, 0, 0)}
    assert transactions(records.limit(0)).collect() == []


def test_broken_archive(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"no archive at all")
    with pytest.raises(Exception, match="not the start of a WARC record"):
        read_warc(spark, str(tmp_path)).collect()
