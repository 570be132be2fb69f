import json
import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from shorewise.config import FeatureService
from shorewise.functions import geometry as G
from shorewise.operators import regions
from shorewise.sources import binary, geojson, wfs, wkt

FEATURES = [
    {"type": "Feature", "properties": {"id": "a", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}},
    {"type": "Feature", "properties": {"id": "b"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1, 9]]}},
    {"type": "Feature", "properties": {"id": "c"}, "geometry": {"type": "Point", "coordinates": [2, 3, 0]}},
]


def test_geojson_round_trip(spark, tmp_path):
    path = tmp_path / "c.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::28992"}}, "features": FEATURES}))
    df, crs = geojson.read_geojson(spark, str(path))
    rows = {r.properties["id"]: r for r in df.collect()}
    assert crs.first().srid_urn.endswith("28992")
    assert tuple(rows["c"].point) == (2, 3) and [tuple(p) for p in rows["b"].line] == [(0, 0), (1, 1)]
    assert df.where("gtype = 'Polygon'").select(G.area(F.col("polygon"))).first()[0] == 16
    polygons = df.where("gtype = 'Polygon'").select(F.col("properties")["id"].alias("id"), "polygon")
    geojson.write_geojson(polygons, str(tmp_path / "out"), "Polygon", "polygon", ["id"])
    back = geojson.read_geojson_lines(spark, str(tmp_path / "out")).first()
    assert back.properties["id"] == "a" and len(back.polygon[0]) == 5


def _odd_collection(n):
    """Features with braces, quotes and backslashes in their strings, of different lengths and nesting, beside other members."""
    tricky = ['plain', '}', '{"type": "Feature"}', '"features": [{', 'a \\ b \\\\" }', 'é ü 🙂 }{', '\\', '"', "x" * 700 + "}"]
    made = [{"type": "Feature", "id": k, "properties": {"id": str(k), "t": tricky[k % len(tricky)], "more": {"a": [{"b": "]}"}]}}, "geometry": {"type": "Point", "coordinates": [k, -k]}} for k in range(n)]
    return {"type": "FeatureCollection", "bbox": [0, 1], "links": [{"type": "other", "x": "}"}], "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::28992"}}, "features": made, "last": {"features": [{"y": 1}]}}


@pytest.mark.parametrize("layout", [{"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_geojson_in_byte_ranges(spark, tmp_path, layout):
    """Ranges that begin anywhere, also within strings, give what one range gives."""
    whole = _odd_collection(300)
    path = tmp_path / "big.geojson"
    path.write_text(json.dumps(whole, **layout) + ("\n" if "indent" in layout else ""), encoding="utf-8")
    want = sorted((f["properties"]["id"], f["properties"]["t"], float(f["id"])) for f in whole["features"])
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for size, tasks in (("128m", 1), ("6000", 8)):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], "1")
            if size != "128m":
                assert geojson._ranges(spark, str(path)).rdd.getNumPartitions() >= tasks
            df, crs = geojson.read_geojson(spark, str(path))
            assert sorted((r.properties["id"], r.properties["t"], r.point.x) for r in df.collect()) == want, size
            assert [r.srid_urn for r in crs.collect()] == ["urn:ogc:def:crs:EPSG::28992"]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@pytest.mark.parametrize("layout", [{"indent": 1}, {"separators": (",", ":")}])
def test_geojson_pieces_of_any_ranges(layout):
    """Cut at any braces, the pieces put together are the features, and nothing of them is in the frame."""
    whole, rng = _odd_collection(60), random.Random(3)
    texts = json.dumps(whole, **layout).split("}")[:-1]
    for chance in (0.02, 0.2, 1.0):
        cuts = [0, *[k for k in range(1, len(texts)) if rng.random() < chance], len(texts)]
        ranges = [(a, texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        effects = [dict(zip(("c0", "o0", "q0", "c1", "o1", "q1"), [*geojson.effect(iter(t), False), *geojson.effect(iter(t), True)], strict=True), file="f", start=a) for a, t in ranges]
        known, got, frame, open_ = geojson.starts(effects), [], "", None
        for a, t in ranges:
            for kind, text in geojson.pieces(iter(t), *known["f", a]):
                if kind == "frame":
                    frame += text
                else:
                    open_ = text if kind in ("whole", "head") else open_ + text
                    got += [json.loads(open_)] if kind in ("whole", "tail") else []
        assert got == [*whole["links"][:0], *whole["links"], *whole["features"]] and "geometry" not in frame


def test_layers_of_any_type(spark, tmp_path):
    """Geometries of one and of several parts, mixed in one layer, meet regions; a null one is left out."""
    kinds = {
        "MultiPoint": [[50, 50], [3, 3, 1]], "MultiLineString": [[[60, 60], [70, 70]], [[-5, 2], [15, 2]]], "MultiPolygon": [[[[1, 1], [3, 1], [3, 2], [1, 1]]], [[[80, 0], [82, 0], [82, 2], [80, 0]]]],
        "Point": [20, 20], "LineString": [[20, 0], [20, 9]], "Polygon": [[[9, 9], [30, 9], [30, 30], [9, 9]]],
    }
    made = [{"type": "Feature", "properties": {"k": k}, "geometry": {"type": k, "coordinates": c}} for k, c in kinds.items()] + [{"type": "Feature", "properties": {"k": "none"}, "geometry": None}]
    (tmp_path / "x.json").write_text(json.dumps({"type": "FeatureCollection", "features": made}))
    df = regions.shapes_of(geojson.read_geojson(spark, str(tmp_path / "x.json"))[0].withColumn("k", F.col("properties")["k"]), "any")
    areas = spark.createDataFrame([(1, [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]])], f"location_id int, polygon {G.POLYGON}")
    assert {r.k for r in regions.spatial_pairs(areas, df, kind="any").collect()} == {"MultiPoint", "MultiLineString", "MultiPolygon", "Polygon"}
    (r,) = regions.intersecting(areas, df, "k", kind="any").collect()
    assert (r["count"], r.total_area, r.majority_class_k) == (4, 1 + 2 + 220.5, "MultiLineString")
    clipped = regions.clip_layer(df.union(df).drop("properties"), areas, kind="any")
    assert sorted(x.k for x in clipped.collect()) == sorted(["MultiPoint", "MultiLineString", "MultiPolygon", "Polygon"] * 2)
    with pytest.raises(Exception, match="only line geometries"):
        regions.shapes_of(geojson.read_geojson(spark, str(tmp_path / "x.json"))[0], "line").select("shape").collect()


def test_geojson_of_several_files_and_none(spark, tmp_path):
    for name, features in (("a", FEATURES[:2]), ("b", FEATURES[2:]), ("c", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"features": features, "type": "FeatureCollection"}))
    df, crs = geojson.read_geojson(spark, str(tmp_path))
    assert sorted(r.properties["id"] for r in df.collect()) == ["a", "b", "c"] and [r.srid_urn for r in crs.collect()] == [None] * 3


def test_timestamped_features(spark):
    df = spark.sql("SELECT 5.0 AS distance_to_erosion, timestamp'2025-01-01' AS timestamp UNION ALL SELECT -1.0, timestamp'2026-01-01'")
    got = [json.loads(r.value) for r in geojson.timestamped_features(df, G.line([(0, 0), (4, 0)])).collect()]
    assert [g["properties"]["style"]["color"] for g in got] == ["green", "red"]
    assert got[0]["geometry"] == {"type": "Point", "coordinates": [2.0, 0.0]} and got[0]["properties"]["times"] == ["2025-01-01T00:00:00"]


def test_wkt(spark):
    df = spark.sql("SELECT 'LINESTRING (1 2, 3.5 -4e1)' AS a, 'POLYGON ((0 0, 2 0, 2 2, 0 0), (1 1, 1.5 1, 1 1.5, 1 1))' AS b, 'POINT (7 8)' AS c")
    r = df.select(wkt.parse_line(F.col("a")).alias("a"), wkt.parse_polygon(F.col("b")).alias("b"), wkt.parse_point(F.col("c")).alias("c"), wkt.parse_line(F.col("c")).alias("d")).first()
    assert [tuple(p) for p in r.a] == [(1, 2), (3.5, -40)] and len(r.b) == 2 and tuple(r.c) == (7, 8) and r.d is None


def _answers(total, fail=0):
    calls = []

    def fetch(n, start):
        calls.append((n, start))
        if len(calls) <= fail:
            raise OSError("later")
        part = [{"i": i} for i in range(start, min(start + min(n, 4), total))]
        return {"features": part} | ({"crs": {"properties": {"name": "EPSG::28992"}}} if part else {})

    return fetch, calls


def test_pages():
    fetch, calls = _answers(10)
    got = [f["i"] for found, crs in wfs.pages(fetch) for f in found]
    assert got == list(range(10)) and calls == [(10000, 0), (4, 4), (4, 8), (4, 12)]
    assert list(wfs.pages(_answers(0)[0])) == []
    fetch, calls = _answers(3, fail=2)
    assert sum(len(f) for f, _ in wfs.pages(fetch, pause=0)) == 3
    with pytest.raises(OSError):
        list(wfs.pages(_answers(3, fail=9)[0], pause=0))
    with pytest.raises(RuntimeError):
        list(wfs.pages(_answers(100)[0], max_pages=2))


FAKE = """
def answer(url, query):
    layer = query.get("typeName") or query.get("typeNames")
    one = {"type": "Feature", "properties": {"layer": layer, "bbox": query.get("bbox")}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    return {"features": [one] * (3 if query["startIndex"] == 0 else 0), "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::28992"}}}
"""


def test_data_source(spark, tmp_path):
    (tmp_path / "fake_wfs.py").write_text(FAKE)
    spark.sparkContext.addPyFile(str(tmp_path / "fake_wfs.py"))
    spark.dataSource.register(wfs.FeatureServiceSource)
    rows = spark.read.format("wfs").options(url="http://nowhere", layers="a,b:c", version="2.0.0", boxes="0 0 1 1;2 2 3 3", transport="fake_wfs:answer").load()
    assert {(r.layer, r.box): r["count"] for r in rows.groupBy("layer", "box").count().collect()} == {(k, b): 3 for k in ("a", "b:c") for b in ("0 0 1 1", "2 2 3 3")}
    row = geojson.with_geometry(rows.select(F.from_json("feature", geojson._FEATURE).alias("feature"))).first()
    assert tuple(row.point) == (1, 2)


def service(counts=True, ids=True, limit=50, per_page=7):
    """A service of points on a lattice, many of them near (1, 1), that refuses starts beyond a limit."""
    points = [(x, y) for x in range(20) for y in range(20)] + [(1 + k / 1000, 1 + k / 2000) for k in range(300)] + [(1.1, 1.05)] * (1 if ids else 3)

    def answer(url, query):
        if query["startIndex"] > limit:
            raise ValueError(f"start {query['startIndex']} is refused")
        layer = query.get("typeName") or query.get("typeNames")
        x0, y0, x1, y1 = map(float, query["bbox"].split(","))
        inside = [k for k, (x, y) in enumerate(points) if x0 <= x <= x1 and y0 <= y <= y1 and (layer != "even" or k % 2 == 0)]
        a, n = query["startIndex"], min(per_page, query.get("count", query.get("maxFeatures")))
        made = [{"type": "Feature", **({"id": f"{layer}.{k}"} if ids else {}), "properties": {"url": url}, "geometry": {"type": "Point", "coordinates": points[k]}} for k in inside[a : a + n]]
        return {"features": made, "crs": {"properties": {"name": "EPSG::28992"}}} | ({"numberMatched": len(inside)} if counts else {"numberMatched": "unknown"})

    return points, answer


@pytest.mark.parametrize(("counts", "ids"), [(True, True), (True, False), (False, True), (False, False)])
def test_services_that_refuse_to_go_on(spark, counts, ids):
    """Boxes that overlap and hold more than a service gives: every feature once, with and without counts and ids."""
    points, answer = service(counts, ids)
    boxes = spark.createDataFrame([(0.0, 0.0, 19.0, 19.0), (0.0, 0.0, 3.0, 3.0), (1.0, 1.0, 19.0, 2.0)], "xmin double, ymin double, xmax double, ymax double")
    services = [FeatureService("one", "http://nowhere", ("all", "even")), FeatureService("two", "http://there", ("all",), "2.0.0")]
    rows = wfs.read_services(spark, services, boxes, transport=answer, ask=None, page=100, max_start=50, pause=0)
    assert rows.columns == ["service", "layer", "id", "feature", "crs"]
    got = {}
    for r in rows.collect():
        got.setdefault((r.service, r.layer), []).append(tuple(json.loads(r.feature)["geometry"]["coordinates"]))
    every = sorted(map(tuple, map(list, points)))
    assert sorted(got["one", "all"]) == sorted(got["two", "all"]) == every
    assert sorted(got["one", "even"]) == sorted(p for k, p in enumerate(points) if k % 2 == 0)


def test_services_checks_and_boxes(spark):
    one = [FeatureService("one", "http://nowhere", ("all",))]
    none = spark.createDataFrame([], "xmin double, ymin double, xmax double, ymax double")
    with pytest.raises(ValueError, match="unknown service"):
        wfs.read_services(spark, one, none, only="three", ask=None)
    with pytest.raises(ValueError, match="one: all"):
        wfs.read_services(spark, one, none, ask=lambda url, query: OFFER)
    assert wfs.read_services(spark, one, none, transport=service()[1], ask=None).count() == 0
    same = [(0.5, 0.5)] * 99
    crowd = lambda url, query: {"features": [{"id": k} for k in range(99)][query["startIndex"] :][:7], "numberMatched": 99 if same else 0}
    with pytest.raises(Exception, match="more features than the service gives"):
        wfs.read_services(spark, one, spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], none.schema), transport=crowd, ask=None, max_start=50, pause=0).collect()
    areas = spark.createDataFrame([([[(0.0, 0.0), (4.0, 0.0), (0.0, 3.0), (0.0, 0.0)]],), (None,)], f"polygon {G.POLYGON}")
    assert [tuple(r) for r in wfs.boxes_of(areas, 2.0).collect()] == [(-2.0, -2.0, 6.0, 5.0)]


OFFER = b"""<w:Capabilities xmlns:w="http://www.opengis.net/wfs"><w:Name>service</w:Name><w:FeatureTypeList>
<w:FeatureType><w:Name>b:c</w:Name><w:Title>x</w:Title></w:FeatureType><w:FeatureType><w:Name> a </w:Name></w:FeatureType><w:FeatureType><w:Name/></w:FeatureType>
</w:FeatureTypeList></w:Capabilities>"""


def test_layer_check():
    assert wfs.layers_offered(OFFER) == {"a", "b:c", "c"}
    asked = []
    ask = lambda url, query: asked.append((url, query["request"], query["version"])) or OFFER
    wfs.check_layers([FeatureService("one", "http://nowhere", ("a", "b:c")), FeatureService("two", "http://here", ("c",), "2.0.0")], ask)
    assert asked == [("http://nowhere", "GetCapabilities", "1.0.0"), ("http://here", "GetCapabilities", "2.0.0")]
    with pytest.raises(ValueError, match="one: x, two: y"):
        wfs.check_layers([FeatureService("one", "http://nowhere", ("a", "x")), FeatureService("two", "http://here", ("y",))], ask)


def _wkb_polygon(rings):
    return b"\x01" + struct.pack("<II", 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_contents (table_name TEXT)")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    for layer in ("plots", "multi"):
        con.execute("INSERT INTO gpkg_contents VALUES (?)", (layer,))
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (layer,))
        con.execute(f"CREATE TABLE {layer} (id INTEGER, name TEXT, geom BLOB)")
    head = b"GP\x00\x01" + struct.pack("<i", 28992)
    con.execute("INSERT INTO plots VALUES (1, 'p', ?)", (head + _wkb_polygon([SQUARE]),))
    con.execute("INSERT INTO plots VALUES (2, 'q', NULL)")
    multi = b"\x01" + struct.pack("<II", 6, 2) + _wkb_polygon([SQUARE]) * 2
    con.execute("INSERT INTO multi VALUES (3, 'm', ?)", (head + multi,))
    con.execute("CREATE TABLE others (id INTEGER, geom BLOB)")
    con.execute("INSERT INTO gpkg_contents VALUES ('others')")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('others', 'geom')")
    dot = lambda x: b"\x01" + struct.pack("<I2d", 1, x, x)
    way = lambda x: b"\x01" + struct.pack("<II4d", 2, 2, x, 0, x, 9)
    con.execute("INSERT INTO others VALUES (4, ?)", (head + b"\x01" + struct.pack("<II", 4, 2) + dot(1.0) + dot(7.0),))
    con.execute("INSERT INTO others VALUES (5, ?)", (head + b"\x01" + struct.pack("<II", 5, 2) + way(2.0) + way(8.0),))
    con.commit()
    con.close()
    df = binary.read_geopackage(spark, path, "plots")
    assert df.count() == 2 and df.where("gtype IS NOT NULL").select(G.area(F.col("polygon"))).first()[0] == 16
    assert json.loads(df.where("gtype IS NOT NULL").first().properties) == {"id": 1, "name": "p"}
    whole = binary.read_geopackage(spark, path, "multi")
    assert whole.count() == 1 and whole.select(G.parts_area(F.col("parts"))).first()[0] == 32
    assert {r.layer for r in binary.list_layers(spark, path).collect()} == {"plots", "multi", "others"}
    others = {r.gtype: r for r in binary.read_geopackage(spark, path, "others").collect()}
    assert [tuple(p) for p in others["MultiPoint"].points] == [(1, 1), (7, 7)] and [tuple(p) for line in others["MultiLineString"].lines for p in line] == [(2, 0), (2, 9), (8, 0), (8, 9)]


def test_shapefile(spark, tmp_path):
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    rings = [SQUARE[::-1], hole]
    body = struct.pack("<i4d2i", 5, 0, 0, 4, 4, 2, 10) + struct.pack("<2i", 0, 5) + b"".join(struct.pack("<2d", *p) for r in rings for p in r)
    point = struct.pack("<i2d", 1, 7, 8)
    records = b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate((body, point, struct.pack("<i", 0))))
    (tmp_path / "x.shp").write_bytes(b"\x00" * 100 + records)
    rows = binary.read_shapefile(spark, str(tmp_path / "x.shp"))
    assert [(r.gtype, r.properties) for r in rows.collect()] == [("Polygon", "{}"), ("Point", "{}"), (None, "{}")]
    assert rows.where("gtype = 'Polygon'").select(G.area(F.col("polygon"))).first()[0] == 15
    assert regions.shapes_of(rows.where("gtype = 'Polygon'"), "polygon").select(G.parts_area(F.col("shape"))).first()[0] == 15
    with pytest.raises(Exception, match="only polygon geometries"):
        regions.shapes_of(rows, "polygon").select("shape").collect()


FIELDS = [("name", "C", 12, 0), ("n", "N", 8, 0), ("share", "N", 10, 3), ("seen", "D", 8, 0), ("ok", "L", 1, 0), ("wide", "F", 12, 2)]


def _write_shapefile(folder, name, records, encoding="utf-8", index=True):
    """records: (deleted, shape as bytes, values)."""
    at, shapes, places, rows = 100, b"", b"", b""
    for k, (deleted, shape, values) in enumerate(records):
        shapes += struct.pack(">2i", k + 1, len(shape) // 2) + shape
        places += struct.pack(">2i", at // 2, len(shape) // 2)
        at += 8 + len(shape)
        rows += b"*" if deleted else b" "
        for (_, kind, width, _), v in zip(FIELDS, values, strict=True):
            text = (v.encode(encoding) if kind == "C" else v.encode()) if v is not None else b""
            rows += text.ljust(width) if kind == "C" else text.rjust(width)
    width = 1 + sum(f[2] for f in FIELDS)
    head = 32 + 32 * len(FIELDS) + 1
    described = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in FIELDS)
    (folder / f"{name}.shp").write_bytes(b"\0" * 100 + shapes)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<4BI2H", 3, 120, 1, 1, len(records), head, width) + b"\0" * 20 + described + b"\r" + rows + b"\x1a")
    (folder / f"{name}.cpg").write_text(encoding.upper())
    if index:
        (folder / f"{name}.shx").write_bytes(b"\0" * 100 + places)


@pytest.mark.parametrize("index", [True, False])
def test_shapefile_attributes_in_ranges(spark, tmp_path, index):
    """Names, numbers, dates and deleted records, over many ranges of records, with and without an index."""
    point = lambda x: struct.pack("<i2d", 1, x, -x)
    line = struct.pack("<i4d2i", 3, 0, 0, 4, 4, 2, 4) + struct.pack("<2i", 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 2, 2, 3, 3)
    records = [(k % 7 == 3, point(k), (f"plaats é {k}", str(k), f"{k / 8:.3f}", f"2024{k % 12 + 1:02}15", "TF?"[k % 3], f"{k}.5")) for k in range(53)]
    records += [(False, line, ("two parts", "1", None, None, "Y", "-1.25")), (False, struct.pack("<i", 0), (None, "x", "***", "notadate", None, None))]
    _write_shapefile(tmp_path, "layer", records, index=index)
    rows = binary.read_shapefile(spark, str(tmp_path / "layer.shp"), range_records=10)
    got = [(r.gtype, json.loads(r.properties), r.point.x if r.point else None) for r in rows.collect()]
    want = [("Point", {"name": v[0], "n": k, "share": k / 8, "seen": f"2024-{k % 12 + 1:02}-15", "ok": [True, False, None][k % 3], "wide": k + 0.5}, float(k)) for k, (deleted, _, v) in enumerate(records[:53]) if not deleted]
    assert sorted((x for x in got if x[0] == "Point"), key=lambda x: x[2]) == want
    assert [x[1] for x in got if x[0] == "LineString"] == [{"name": "two parts", "n": 1, "share": None, "seen": None, "ok": True, "wide": -1.25}] * 2
    assert [x[1] for x in got if x[0] is None] == [dict.fromkeys(n for n, *_ in FIELDS)]
    _write_shapefile(tmp_path, "other", records[:2], encoding="latin-1")
    both = binary.read_shapefile(spark, str(tmp_path))
    assert both.count() == len(got) + 2 and both.select("layer").distinct().count() == 2
    assert json.loads(both.where("layer LIKE '%other.shp'").orderBy("properties").first().properties)["name"] == "plaats é 0"
