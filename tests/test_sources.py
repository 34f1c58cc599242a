import datetime
import gzip
import json
import zipfile

from pyspark.sql import functions as F

from trackloom.operators import raster as X
from trackloom.sources import files as S


def test_json_mapping(spark, tmp_path):
    rows = [{"kind": "a", "id": {"code": "0017"}, "alt": "100", "pos": {"lat": 1.5}}, {"kind": "a", "id": {"code": "77"}, "alt": "x"}, {"kind": "b", "pos": {"lat": 2}}]
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)))
    fields = [S.Field("mode3a", "id.code", "long", base=8), S.Field("altitude", "alt", "double", factor=0.5), S.Field("lat", "pos.lat", "double", mandatory=True)]
    assert [tuple(r) for r in S.read_json(spark, str(tmp_path), fields, where=("kind", "a")).collect()] == [(15, 50.0, 1.5)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/all.json").write_text(json.dumps({"data": rows}))
    assert S.read_json(spark, str(tmp_path / "c"), [S.Field("lat", "pos.lat", "double")], container="data").count() == 3


def test_gps(spark, tmp_path):
    (tmp_path / "g.csv").write_text("2024-01-02 03:04:05.500,48.1,16.2,300\nbroken,1,2,3\n2024-01-02 03:04:06.500,,16,1\n")
    assert [tuple(r) for r in S.read_gps_csv(spark, str(tmp_path / "g.csv")).collect()] == [(datetime.datetime(2024, 1, 2, 3, 4, 5, 500000), 48.1, 16.2, 300.0)]
    good = "GPGGA,123519,4807.038,N,01131.000,W,1,08,0.9,545.4,M,46.9,M,,"
    check = 0
    for c in good:
        check ^= ord(c)
    (tmp_path / "n.txt").write_text(f"${good}*{check:02X}\n${good}*{check ^ 1:02X}\n${good.replace(',1,08', ',0,08')}\n$GPRMC,1\n")
    rows = S.read_nmea(spark, str(tmp_path / "n.txt"), "2024-05-06").collect()
    assert len(rows) == 1 and abs(rows[0].lat - 48.1173) < 1e-6 and abs(rows[0].lon + 11.516667) < 1e-5
    assert rows[0].ts == datetime.datetime(2024, 5, 6, 12, 35, 19) and rows[0].altitude == 545.4


def test_sectors_and_sinks(spark, tmp_path):
    layers = S.read_sectors('[{"name": "a", "layer_name": "l", "points": [[0, 0], [1, 0], [1, 1]], "low": 5}, {"name": "h", "layer_name": "l", "points": [[0, 0], [0.1, 0], [0, 0.1]], "exclusion": true}]')
    assert [s.exclusion for s in layers["l"]] == [False, True] and layers["l"][0].low == 5
    df = spark.createDataFrame([(1, 8, None), (2, 63, "x")], "t long, code long, v string")
    S.write_csv(df.coalesce(1), str(tmp_path / "out"), {"code": "octal"})
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "out")).collect())) == [("1", "0010", None), ("2", "0077", "x")]
    S.write_merged_csv({"a": df, "b": df.select("t", F.lit(1).alias("w"))}, "t", str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 4
    assert [json.loads(r.row) for r in S.to_json_rows(df, ["t", "v"], 1).collect()] == [{"t": 1}]
    S.write_partitioned(df.withColumn("ts", F.timestamp_seconds("t")), str(tmp_path / "p"), "ts")
    assert spark.read.parquet(str(tmp_path / "p")).where("day = '1970-01-01'").count() == 2
    schema = S.content_schema({"lat": "double", "code": "long"}, {"lat": "deg"})
    assert schema["lat"].metadata == {"unit": "deg"} and schema["code"].dataType.simpleString() == "bigint"


def test_concatenated_objects_and_archives(spark, tmp_path):
    text = '{"a": {"b": 1}, "s": "}{"} {"a": {"b": 2}}\n,{"a": {}}broken{{"a": {"b": "x", "c": [1, 2]}, "d": 7}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text(text)
    (tmp_path / "in/y.json.gz").write_bytes(gzip.compress(b'{"a": {"b": 10}}{"a": {"b": 11}}'))
    with zipfile.ZipFile(tmp_path / "in/z.zip", "w") as z:
        z.writestr("1.json", '{"a": {"b": 20}}')
        z.writestr("2.json", '[{"a": {"b": 21}}, {"a": {"b": 22}}]')
    raw = S.read_objects(spark, str(tmp_path / "in"))
    fields = [S.Field("b", "a.b", "long", mandatory=True), S.Field("all", "a.b", "long"), S.Field("all", "d", "long")]
    assert sorted(r.b for r in S.map_objects(raw, fields).collect()) == [1, 2, 10, 11, 20, 21, 22]
    assert sorted(map(tuple, S.map_objects(raw, [S.Field("c", "a.c", "array<int>", mandatory=True), *fields[1:]]).collect())) == [([1, 2], [7])]


def test_view_points_reports_and_csv(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"view_points": [{"id": 1, "name": "n", "type": "t", "filters": {"UTN": [3]}}, {"name": "without id"}]}))
    (one,) = S.read_view_points(spark, str(tmp_path / "v.json")).collect()
    assert (one.id, one.name, one.type, one.status) == (1, "n", "t", None) and json.loads(one.spec)["filters"] == {"UTN": [3]}
    df = spark.createDataFrame([(1, 8, True), (2, 63, False)], "t long, code long, selected boolean")
    S.write_report({"a": df, "b": df.where("t = 1")}, str(tmp_path / "r"), 10)
    assert {(r.section, r.n) for r in spark.read.json(str(tmp_path / "r")).groupBy("section").agg(F.count("*").alias("n")).collect()} == {("a", 2), ("b", 1)}
    S.write_csv(df, str(tmp_path / "s"), {"code": "octal"}, "selected")
    rows = S.read_csv_mapped(spark, str(tmp_path / "s"), [S.Field("mode_a", "code", "long", base=8), S.Field("t", "t", "long")]).collect()
    assert [tuple(r) for r in rows] == [(8, 1)]


def test_geojson_sectors():
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a", "layer_name": "l", "low": 5}, "geometry": {"type": "Polygon", "coordinates": [[[13, 47], [14, 47], [14, 48], [13, 47]], [[13.5, 47.1], [13.6, 47.1], [13.6, 47.2], [13.5, 47.1]]]}}]}
    layers = S.read_sectors(json.dumps(shape))
    assert [(s.corners[0], s.low, s.exclusion) for s in layers["l"]] == [((47.0, 13.0), 5, False), ((47.1, 13.5), 5, True)]


GML = """<?xml version="1.0" encoding="utf-8"?>
<ogr:FeatureCollection xmlns:ogr="http://ogr.maptools.org/" xmlns:gml="http://www.opengis.net/gml/3.2">
  <ogr:featureMember><ogr:area gml:id="a.0"><ogr:name>north</ogr:name><ogr:layer_name>fir</ogr:layer_name><ogr:low>10.5</ogr:low>
    <ogr:geometryProperty><gml:MultiSurface srsName="urn:ogc:def:crs:EPSG::4326"><gml:surfaceMember><gml:Polygon>
      <gml:exterior><gml:LinearRing><gml:posList>47 13 48 13 48 14 47 14 47 13</gml:posList></gml:LinearRing></gml:exterior>
      <gml:interior><gml:LinearRing><gml:posList srsDimension="3">47.4 13.4 0 47.6 13.4 0 47.6 13.6 0 47.4 13.4 0</gml:posList></gml:LinearRing></gml:interior>
    </gml:Polygon></gml:surfaceMember></gml:MultiSurface></ogr:geometryProperty></ogr:area></ogr:featureMember>
  <ogr:featureMember><ogr:area fid="a.1"><ogr:geometryProperty><gml:Polygon srsName="EPSG:4326"><gml:outerBoundaryIs><gml:LinearRing>
    <gml:coordinates>13,45 14,45 14,46 13,45</gml:coordinates></gml:LinearRing></gml:outerBoundaryIs></gml:Polygon></ogr:geometryProperty></ogr:area></ogr:featureMember>
  <ogr:featureMember><ogr:area fid="a.2"><ogr:geometryProperty><gml:Point><gml:pos>1 2</gml:pos></gml:Point></ogr:geometryProperty></ogr:area></ogr:featureMember>
</ogr:FeatureCollection>"""


def test_sector_files_as_a_table(spark, tmp_path):
    """GML of both generations and JSON give rows that the index of sectors takes."""
    (tmp_path / "a.gml").write_text(GML)
    (tmp_path / "b.json").write_text('[{"name": "box", "layer_name": "l", "points": [[0, 0], [2, 0], [2, 2], [0, 2]], "low": 5}]')
    table = S.read_sector_files(spark, str(tmp_path / "*"))
    got = {(r.sector, r.exclusion): (r.layer, [tuple(p) for p in r.corners], r.low) for r in table.collect()}
    assert got[("north", False)] == ("fir", [(47, 13), (48, 13), (48, 14), (47, 14)], 10.5)
    assert got[("north", True)] == ("fir", [(47.4, 13.4), (47.6, 13.4), (47.6, 13.6)], 10.5)
    assert got[("a.1", False)] == ("a.1", [(45, 13), (45, 14), (46, 14)], None) and got[("box", False)][2] == 5 and len(got) == 4
    points = spark.createDataFrame([(1, 47.5, 13.5), (2, 45.2, 13.5), (3, 1.0, 1.0), (4, 80.0, 0.0)], "id long, x double, y double")
    found = {(r.id, r.sector) for r in X.sectors_of(points, X.sector_index(table.where("not exclusion")), "x", "y").collect()}
    assert found == {(1, "north"), (2, "a.1"), (3, "box")}
    assert [s.exclusion for s in S.read_sectors(GML)["fir"]] == [False, True]
