"""WARC archives: written from pages, read back, and assembled into one nested row for each capture."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm.common import batches, scratch, stage

#: Payloads of fewer bytes are never deduplicated.
LEAST_BYTES = 100
#: About so many bytes of payload go into one archive.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, stated_digest string, "
    "http_status string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"
)
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "stated_digest", "http_status")]
    + [("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)
_BREAK = "\r\n"


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str | Column, own: Column, block: Column, content: str, *headers: Column) -> Column:
    """One record without the two line breaks that end it; null headers are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), own), F.lit(f"WARC-Date: {DATE}"), *headers, F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_BREAK, *lines), F.lit(_BREAK * 2), block)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def write_warc(pages: DataFrame, path: str) -> None:
    """Write a request, a response or revisit, and a metadata record for each row of pages(page_id, url, html).

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of LEAST_BYTES or more,
    that with the smallest page_id (nulls last, then the smallest url) is a response and the others
    revisit it; of fully equal rows one counts as the first. Smaller payloads are all responses. A null
    url is written as no target; blanks and control characters in urls are escaped; a null page_id is
    left out of the metadata. Extra columns are ignored; an empty table makes an archive without records.

    Spark's text writer ends each row with the two line breaks that end a WARC record. Payloads move
    once, by a key of their own page, so that a payload shared by very many pages gathers nowhere.
    """
    uri = F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    rows = rows.withColumn("key", F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest", "uri"))
    small = stage(rows.select("page_id", "uri", "bytes", "digest", "key"))
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("uri").alias("uri"), F.col("key").alias("key"))
    first = small.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min(order)["key"].alias("first"))
    refs = small.select("key", "digest").distinct().join(first, "digest").select("key", "first")
    total = small.agg(F.sum("bytes")).first()[0] or 0
    rows = rows.repartition(max(1, -(-total // ARCHIVE_BYTES)), "key").join(refs, "key", "left")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("bytes")).cast("string"))
    own = _urn(F.col("key"), F.col("copy"))
    revisit = F.col("first").isNotNull() & ((F.col("first") != F.col("key")) | (F.col("copy") != "1"))
    http = F.lit(_BREAK.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""]))
    target = _header("WARC-Target-URI", F.col("uri"))
    capture = _record(
        F.when(revisit, "revisit").otherwise("response"), own, F.when(revisit, http).otherwise(F.concat(http, "payload")), "application/http; msgtype=response", target,
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), F.when(revisit, _header("WARC-Refers-To", _urn(F.col("first"), F.lit("1")))), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
    )
    related = _header("WARC-Concurrent-To", own)
    asked = F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(" HTTP/1.1" + _BREAK * 2))
    request = _record("request", _urn(F.col("key"), F.col("copy"), F.lit("request")), asked, "application/http; msgtype=request", target, related)
    fields = F.concat(F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(_BREAK)), F.lit("")), F.lit("via: pages" + _BREAK))
    metadata = _record("metadata", _urn(F.col("key"), F.col("copy"), F.lit("metadata")), fields, "application/warc-fields", target, related)
    out = rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    out.write.option("lineSep", _BREAK * 2).option("compression", "gzip").text(path)


def _lines(block: bytes) -> dict[str, str]:
    found = {}
    for line in block.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def _parse(archive: bytes) -> Iterator[dict]:
    """The records of an archive, compressed or not, one in memory at a time."""
    f = gzip.GzipFile(fileobj=io.BytesIO(archive)) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive)
    f = io.BufferedReader(f, 1 << 16)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
        head = []
        while (line := f.readline()).strip():
            head.append(line)
        headers = _lines(b"".join(head))
        block = f.read(int(headers.get("content-length", 0)))
        out = {
            "record_id": headers.get("warc-record-id"), "type": headers.get("warc-type"), "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"),
            "target_uri": headers.get("warc-target-uri"), "stated_digest": headers.get("warc-payload-digest"), "fields": [],
        }
        content, payload = headers.get("content-type", ""), block
        if content.startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            out["http_status"] = (top.split(b"\r\n")[0].split(b" ") + [b""])[1].decode("latin-1") if out["type"] != "request" else None
            out["fields"] = list(_lines(top).items())
        elif content.startswith("application/warc-fields"):
            out["fields"] = list(_lines(block).items())
        yield out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload}


def _read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for i in range(batch.num_rows):
            yield from batches(_parse(batch.column("content")[i].as_py()), _ARROW, 256)


def read_warc(spark: SparkSession, path: str, glob: str = "[!._]*") -> DataFrame:
    """The records of the archives under path, one row each: ids, kind, fields, payload and its digest.

    All files whose name matches glob are archives, by default all but those that begin with _ or a dot.
    They are read by Spark and handed out whole, one to a task at a time; those of write_warc hold
    about ARCHIVE_BYTES. A broken record raises ValueError.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content").mapInArrow(_read, _RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """records -> one nested row for each capture: capture_id, response, requests, metadata.

    A response or revisit is joined with the requests and metadata records whose WARC-Concurrent-To is
    its id. Requests and metadata of a capture that isn't there come as a row with a null response;
    those that name no capture come under their own id. Repeated captures are rows of their own, each with
    all requests and metadata of their id; the order within a list isn't defined. Extra columns are
    ignored. No records give no rows.
    """
    response = F.struct("type", "target_uri", "refers_to", "http_status", "stated_digest", "payload_bytes", "payload_digest", "payload")
    captures = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), response.alias("response"))
    others = records.where(F.col("type").isin("request", "metadata"))
    others = others.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "fields"))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
    )
    return captures.join(others, "capture_id", "full_outer")


def page_captures(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read and assemble them, and describe each capture.

    -> page_id, payload_bytes, payload_digest, record_type, refers_to: the page_id of the response that a
    revisit names, null otherwise. For revisits, size and digest are those of that response's payload.

    One row for each row of pages: null html is an empty payload, a null page_id comes back as null,
    repeated rows are captures of their own, of which with equal payloads of LEAST_BYTES or more one is
    the response. Very long pages are written and read whole, up to 2 GB. Extra columns are ignored. An
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path)
    rows = transactions(read_warc(spark, path))
    rows = rows.select("capture_id", F.col("metadata")[0]["fields"]["pageid"].cast("long").alias("page_id"), "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest")
    rows = stage(rows)
    of = rows.where("type = 'response'").select(F.col("capture_id").alias("of"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"))
    out = rows.withColumnRenamed("refers_to", "named").join(of, F.col("named") == F.col("of"), "left")
    return out.select("page_id", F.coalesce("of_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("of_digest", "payload_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("of_page").alias("refers_to"))
