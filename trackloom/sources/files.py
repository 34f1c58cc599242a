"""Files in and out: JSON with a mapping, GPS trails, sectors, saved views, CSV and JSON sinks."""

from __future__ import annotations

import gzip
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import scalar as S
from trackloom.operators.spatial import Sector
from trackloom.operators.tables import union_contents


@dataclass(frozen=True)
class Field:
    """A target column from a path of keys; rows without a mandatory value are left out."""

    name: str
    path: str
    kind: str = "string"
    mandatory: bool = False
    base: int | None = None
    factor: float = 1.0


def read_json(spark: SparkSession, path: str, fields: list[Field], container: str | None = None, where: tuple[str, str] | None = None) -> DataFrame:
    """Objects of JSON files, plain or gzipped, one a line or whole files, mapped to columns.

    container: the key of an array whose elements are the objects; where: (path, value) that they must have.
    Paths are dotted; values that don't parse are null.
    """
    raw = spark.read.text(path, wholetext=container is not None).select(F.col("value").alias("o"))
    if container is not None:
        items = F.from_json(F.get_json_object("o", f"$.{container}"), "array<string>")
        raw = raw.select(F.explode(items).alias("o"))
    if where is not None:
        raw = raw.where(F.get_json_object("o", f"$.{where[0]}") == where[1])
    return map_objects(raw, fields)


def _value(f: Field) -> Column:
    text = F.get_json_object("o", f"$.{f.path}")
    if f.kind.startswith("array"):
        return F.from_json(text, f.kind)
    if f.base is not None:
        return F.conv(text, f.base, 10).try_cast(f.kind)
    value = text.try_cast(f.kind)
    return value if f.factor == 1.0 else value * f.factor


def read_gps_csv(spark: SparkSession, path: str, layout: str = "yyyy-MM-dd HH:mm:ss.SSS") -> DataFrame:
    """Timestamp, latitude, longitude, altitude; broken lines are left out."""
    rows = spark.read.csv(path, schema="ts string, lat double, lon double, altitude double", mode="PERMISSIVE")
    rows = rows.withColumn("ts", F.try_to_timestamp("ts", F.lit(layout)).cast("timestamp_ntz"))
    return rows.where("ts is not null and lat is not null and lon is not null")


def read_nmea(spark: SparkSession, path: str, day: str, offset: float = 0.0) -> DataFrame:
    """GGA sentences with a fix and a right checksum: tod, ts, lat, lon, quality, altitude in metres."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\$..GGA,"))
    body = F.regexp_extract("value", r"^\$([^*]*)", 1)
    part = lambda i: F.get(F.split(body, ","), i)
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.ascii(c))
    total = F.aggregate(codes, F.lit(0), lambda a, c: a.bitwiseXOR(c))
    stated = F.conv(F.regexp_extract("value", r"\*([0-9A-Fa-f]{2})", 1), 16, 10).try_cast("int")
    degrees = lambda text, n: F.substring(text, 1, n).try_cast("double") + F.substring(text, n + 1, 20).try_cast("double") / 60
    time = part(1)
    tod = F.substring(time, 1, 2).try_cast("double") * 3600 + F.substring(time, 3, 2).try_cast("double") * 60 + F.substring(time, 5, 20).try_cast("double")
    rows = lines.where(stated.isNull() | (stated == total)).select(
        F.pmod(tod + offset, F.lit(86400.0)).alias("tod"), (degrees(part(2), 2) * F.when(part(3) == "S", -1).otherwise(1)).alias("lat"),
        (degrees(part(4), 3) * F.when(part(5) == "W", -1).otherwise(1)).alias("lon"), part(6).try_cast("int").alias("quality"), part(9).try_cast("double").alias("altitude"),
    )
    rows = rows.where("quality > 0 and lat is not null and lon is not null and tod is not null")
    since = F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("tod"))
    return rows.withColumn("ts", since)


def read_sectors(text: str) -> dict[str, list[Sector]]:
    """Layers of sectors from a text: a JSON list of name, layer_name, points, low, high, exclusion, or GeoJSON, or GML."""
    layers: dict[str, list[Sector]] = {}
    for s in _sectors(text):
        corners = tuple((float(x), float(y)) for x, y in s["points"])
        layers.setdefault(s.get("layer_name", s["name"]), []).append(Sector(s["name"], corners, s.get("low"), s.get("high"), bool(s.get("exclusion"))))
    return layers


def read_sector_files(spark: SparkSession, path: str) -> DataFrame:
    """The sectors of all files that a path or pattern names, as a table: layer, sector, corners (x, y), low, high, exclusion.

    Each file is parsed by a task, so that thousands of sectors don't pass through the driver; corners are
    as `raster.sector_index` takes them, x for latitude. Kinds of files as in `read_sectors`.
    """
    schema = "layer string, sector string, corners array<struct<x: double, y: double>>, low double, high double, exclusion boolean"

    def parse(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        to = pa.schema([("layer", pa.string()), ("sector", pa.string()), ("corners", pa.list_(point)), ("low", pa.float64()), ("high", pa.float64()), ("exclusion", pa.bool_())])
        for batch in stream:
            for text in batch.column(0).to_pylist():
                rows = [
                    {"layer": s.get("layer_name", s["name"]), "sector": s["name"], "corners": [{"x": float(x), "y": float(y)} for x, y in s["points"]], "low": s.get("low"), "high": s.get("high"), "exclusion": bool(s.get("exclusion"))}
                    for s in _sectors(text)
                ]
                yield pa.RecordBatch.from_pylist(rows, to)

    return spark.read.text(path, wholetext=True).mapInArrow(parse, schema)


def _sectors(text: str) -> list[dict]:
    """Of GeoJSON and GML features, polygons count with their outer ring; holes are exclusions of their layer."""
    if text.lstrip().startswith("<"):
        return [s for feature in _features(ElementTree.fromstring(text.strip())) for s in _rings(feature)]
    found = json.loads(text)
    return [s for feature in found.get("features", []) for s in _rings(feature)] if isinstance(found, dict) else found


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _features(root: ElementTree.Element) -> Iterator[dict]:
    """The features of a GML collection in the form of GeoJSON's: its members' children, with simple elements as properties."""
    for member in root:
        if _local(member) not in ("featureMember", "featureMembers", "member", "members"):
            continue
        for feature in member:
            own = {_local(e): e.text.strip() for e in feature if e.text and e.text.strip() and len(e) == 0}
            limits = {k: float(own[k]) for k in ("low", "high") if k in own}
            ids = [v for k, v in feature.attrib.items() if k.rpartition("}")[2] in ("id", "fid")]
            polygons = [[_ring(r, _crs(feature, p)) for r in p.iter() if _local(r) == "LinearRing"] for p in feature.iter() if _local(p) in ("Polygon", "PolygonPatch")]
            yield {"id": (ids or ["sector"])[0], "properties": own | limits, "geometry": {"type": "MultiPolygon", "coordinates": [[r for r in p if r] for p in polygons]}}


def _crs(feature: ElementTree.Element, polygon: ElementTree.Element) -> str:
    """The reference system that a polygon states, else the one around it."""
    around = [e.get("srsName") for e in feature.iter() if e.get("srsName") and (e is polygon or any(x is polygon for x in e.iter()) or any(x is e for x in polygon.iter()))]
    return around[-1] if around else ""


def _ring(ring: ElementTree.Element, crs: str) -> list[tuple[float, float]]:
    """(longitude, latitude) of a ring in the notations posList, pos and coordinates; systems named by URN or URL put the latitude first."""
    points: list[list[float]] = []
    for e in ring.iter():
        if _local(e) in ("posList", "pos"):
            n = int(e.get("srsDimension") or ring.get("srsDimension") or (len(e.text.split()) if _local(e) == "pos" else 2))
            numbers = [float(x) for x in e.text.split()]
            points += [numbers[i : i + n] for i in range(0, len(numbers), n)]
        elif _local(e) == "coordinates":
            points += [[float(x) for x in p.split(",")] for p in e.text.split()]
    return [(p[1], p[0]) if crs.startswith(("urn:", "http")) else (p[0], p[1]) for p in points]


def _rings(feature: dict) -> Iterator[dict]:
    shape, own = feature.get("geometry") or {}, feature.get("properties") or {}
    many = {"Polygon": [shape.get("coordinates")], "MultiPolygon": shape.get("coordinates")}.get(shape.get("type"), [])
    name = str(own.get("name", feature.get("id", "sector")))
    for polygon in many:
        for i, ring in enumerate(polygon):
            # positions are (longitude, latitude), and the last repeats the first
            points = [(p[1], p[0]) for p in ring[: -1 if ring[0] == ring[-1] else None]]
            yield {"name": name, "layer_name": own.get("layer_name", name), "points": points, "low": own.get("low"), "high": own.get("high"), "exclusion": i > 0}


def write_csv(df: DataFrame, path: str, shown: dict[str, str] | None = None, selected: str | None = None) -> None:
    """A header, nulls as empty fields, and columns in the form named in shown: octal, hex, time or fl; of selected rows only if asked."""
    df = df if selected is None else df.where(F.col(selected))
    forms = {"octal": S.octal_text, "hex": S.hex_text, "time": S.time_text, "fl": S.flight_level}
    out = df.select(*(forms[shown[c]](F.col(c)).alias(c) if shown and c in shown else F.col(c) for c in df.columns))
    out.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_merged_csv(contents: dict[str, DataFrame], t: str, path: str) -> None:
    """All contents in order of time."""
    union_contents(contents).orderBy(t).write.option("header", True).option("nullValue", "").csv(path)


def to_json_rows(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Rows as JSON text, cut to a number of rows as the command asks."""
    return df.select(F.to_json(F.struct(*columns)).alias("row")).limit(most)


def write_partitioned(df: DataFrame, path: str, t: str) -> None:
    """Append as Parquet by day, which prunes time windows and drops old days whole."""
    df.withColumn("day", F.to_date(t)).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def content_schema(variables: dict[str, str], units: dict[str, str] | None = None) -> T.StructType:
    """1.4: a declared schema whose fields keep their unit."""
    fields = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in variables.items()))
    return T.StructType([T.StructField(f.name, f.dataType, True, {"unit": (units or {}).get(f.name, "")}) for f in fields])


def _objects(data: bytes) -> Iterator[str]:
    """The JSON objects of a file, one after another, whatever stands between them; gzip and zip archives are opened."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for name in sorted(archive.namelist()):
                yield from _objects(archive.read(name))
        return
    text, decoder, at = data.decode("utf-8", "replace"), json.JSONDecoder(), 0
    while (at := text.find("{", at)) >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            at += 1
            continue
        yield text[at:end]
        at = end


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Column o with each object of files that hold JSON objects one after another, plain, gzipped or in zip archives.

    A file is read whole by one task, so it must be below 2 GB; files with an object a line are read by
    read_json without that limit. What isn't JSON between objects is skipped.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for data in batch.column("content"):
                held: list[str] = []
                for text in _objects(data.as_py()):
                    held.append(text)
                    if len(held) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(held)], names=["o"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["o"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "o string")


def map_objects(raw: DataFrame, fields: list[Field]) -> DataFrame:
    """The objects of column o mapped to columns; rows without a mandatory value are left out.

    Fields of one name are appended: their column is the array of those of their values that are there.
    """
    names = list(dict.fromkeys(f.name for f in fields))
    of = {n: [_value(f) for f in fields if f.name == n] for n in names}
    rows = raw.select(*((v[0] if len(v) == 1 else F.array_compact(F.array(*v))).alias(n) for n, v in of.items()))
    needed = [f.name for f in fields if f.mandatory]
    return rows.dropna(subset=needed) if needed else rows


def read_csv_mapped(spark: SparkSession, path: str, fields: list[Field]) -> DataFrame:
    """CSV files with a header, their columns mapped as objects' members are: path is a column's name."""
    raw = spark.read.option("header", True).csv(path)
    return map_objects(raw.select(F.to_json(F.struct(*raw.columns)).alias("o")), fields)


def read_view_points(spark: SparkSession, path: str, container: str = "view_points") -> DataFrame:
    """Id, name, type, status and spec, the whole object, of the view points of JSON files; those without an id are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", f"$.{container}"), "array<string>")).alias("spec"))
    part = lambda name: F.get_json_object("spec", f"$.{name}")
    return raw.select(part("id").try_cast("long").alias("id"), part("name").alias("name"), part("type").alias("type"), part("status").alias("status"), "spec").where("id is not null")


def write_report(sections: dict[str, DataFrame], path: str, most: int | None = None) -> None:
    """A report's tables as JSON rows, a folder for each section, cut to a number of rows if asked."""
    for name, df in sections.items():
        (df if most is None else df.limit(most)).write.mode("overwrite").json(f"{path}/section={name}")
