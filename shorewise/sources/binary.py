"""GeoPackage and shapefile layers.

The files come through Spark's binary reader, so any file system that Spark knows
will do. A GeoPackage is decoded by one task, from a scratch copy in the task's own
temporary folder, gone when the task ends. A shapefile, which by its format has at most
2 GB, is read by one task, cut into ranges of records by its index, and decoded range by range
in parallel, each with its rows of the attribute table; without an index the records' own
lengths tell the ranges, and without a table properties are empty. Records that the table marks as deleted are left out.
Rows are (layer, properties as JSON text, gtype, polygons as rings of points; a
point or a line is one ring of one polygon). An object is one row, however many
polygons it has; a shapefile's line of several parts is one row for each.
"""

from __future__ import annotations

import json
import math
import sqlite3
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewise.functions.geometry import LINE, POLYGON

_SCHEMA = f"layer string, properties string, gtype string, polygons array<{POLYGON}>"

# fixed values: codes of the WKB and shapefile formats
WKB_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
SHAPE_TYPES = {1: "Point", 3: "LineString", 5: "Polygon"}
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def decode_wkb(data: bytes, at: int = 0) -> tuple[str, list, int]:
    """Type, rings (one for points and lines; a geometry of several parts has the rings of each instead) and the place after it; z and m are dropped."""
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    dims = 2 + (code & 0x80000000 != 0) + (code & 0x40000000 != 0)
    code &= 0x1FFFFFFF
    dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    kind, at = WKB_TYPES.get(code % 1000), at + 5
    if kind is None:
        raise ValueError(f"WKB type {code} isn't supported")

    def points(n: int, at: int) -> tuple[list, int]:
        flat = struct.unpack_from(f"{order}{n * dims}d", data, at)
        return [{"x": flat[i * dims], "y": flat[i * dims + 1]} for i in range(n)], at + 8 * n * dims

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == "Point":
        ring, at = points(1, at)
        return kind, [ring], at
    n, at = count(at)
    if kind == "LineString":
        ring, at = points(n, at)
        return kind, [ring], at
    rings: list = []
    for _ in range(n):
        if kind == "Polygon":
            m, at = count(at)
            ring, at = points(m, at)
            rings.append(ring)
        else:
            _, part, at = decode_wkb(data, at)
            rings.append(part)
    return kind, rings, at


def decode_geopackage_blob(blob: bytes) -> tuple[str, list]:
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return decode_wkb(blob, 8 + ENVELOPE_BYTES[blob[3] >> 1 & 7])[:2]


def _layers(con: sqlite3.Connection) -> list[tuple[str, str]]:
    return con.execute("SELECT c.table_name, g.column_name FROM gpkg_contents c LEFT JOIN gpkg_geometry_columns g USING (table_name) ORDER BY 1").fetchall()


def _geopackages(layer: str | None):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with tempfile.NamedTemporaryFile(suffix=".gpkg") as scratch:
                    scratch.write(content)
                    scratch.flush()
                    con = sqlite3.connect(scratch.name)
                    rows: list[tuple] = []
                    for name, column in _layers(con):
                        if layer in (None, name) and column:
                            cursor = con.execute(f'SELECT * FROM "{name}"')  # noqa: S608
                            names = [d[0] for d in cursor.description]
                            for r in cursor:
                                values = dict(zip(names, r, strict=True))
                                blob = values.pop(column)
                                kind, rings = decode_geopackage_blob(blob) if blob else (None, None)
                                rows.append((name, json.dumps(values, default=str), kind, rings if kind is None or kind.startswith("Multi") else [rings]))
                                if len(rows) == RANGE_RECORDS:
                                    yield pd.DataFrame(rows, columns=["layer", "properties", "gtype", "polygons"])
                                    rows = []
                    con.close()
                yield pd.DataFrame(rows, columns=["layer", "properties", "gtype", "polygons"])

    return f


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Features of one layer, or of all."""
    return with_shapes(spark.read.format("binaryFile").load(path).select("content").mapInPandas(_geopackages(layer), _SCHEMA))


def list_layers(spark: SparkSession, path: str) -> DataFrame:
    """(layer): the feature layers of GeoPackages."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with tempfile.NamedTemporaryFile(suffix=".gpkg") as scratch:
                    scratch.write(content)
                    scratch.flush()
                    con = sqlite3.connect(scratch.name)
                    yield pd.DataFrame({"layer": [n for n, _ in _layers(con)]})
                    con.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(f, "layer string").distinct()


def decode_shape(data: bytes, at: int) -> list[tuple[str | None, list | None]]:
    """Type and polygons of the record's shape at `at` (a point or a line as one ring of one), each part of a line by itself; a null shape is (None, None). A clockwise ring begins a polygon, others are its holes."""
    (code,) = struct.unpack_from("<i", data, at)
    kind = SHAPE_TYPES.get(code % 10) if code else None
    if code and kind is None:
        raise ValueError(f"shape type {code} isn't supported")
    if kind is None:
        return [(None, None)]
    if kind == "Point":
        x, y = struct.unpack_from("<2d", data, at + 4)
        return [(kind, [[[{"x": x, "y": y}]]])]
    parts, points = struct.unpack_from("<2i", data, at + 36)
    starts = [*struct.unpack_from(f"<{parts}i", data, at + 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", data, at + 44 + 4 * parts)
    rings = [[{"x": flat[2 * i], "y": flat[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    if kind == "LineString":
        return [(kind, [[ring]]) for ring in rings]
    polygons: list[list] = []
    for ring in rings:
        turn = sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring[:-1], ring[1:], strict=True))
        if not polygons or turn < 0:
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return [(kind if len(polygons) == 1 else "MultiPolygon", polygons)]


def record_places(shp: bytes, shx: bytes | None) -> list[tuple[int, int]]:
    """Where each record begins and ends: from the index, or record by record."""
    if shx:
        n = (len(shx) - 100) // 8
        words = struct.unpack_from(f">{2 * n}i", shx, 100)
        return [(2 * p, 2 * p + 8 + 2 * length) for p, length in zip(words[::2], words[1::2], strict=True)]
    at, out = 100, []
    while at + 8 <= len(shp):
        end = at + 8 + 2 * struct.unpack_from(">i", shp, at + 4)[0]
        out.append((at, end))
        at = end
    return out


def table_fields(dbf: bytes) -> tuple[int, int, list[tuple[str, str, int]]]:
    """Length of an attribute table's head and of its rows, and name, type and length of each field."""
    head, row = struct.unpack_from("<2H", dbf, 8)
    fields, at = [], 32
    while at + 32 <= head and dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(dbf[at + 11]), dbf[at + 16]))
        at += 32
    return head, row, fields


def table_row(row: bytes, fields: list[tuple[str, str, int]], encoding: str) -> dict | None:
    """A row's values by field: text, numbers, ISO dates, booleans; None for a row marked as deleted. What is blank or can't be read is null."""
    if row[:1] == b"*":
        return None
    values, at = {}, 1
    for name, kind, length in fields:
        raw = row[at : at + length]
        at += length
        if kind == "I":
            values[name] = struct.unpack("<i", raw)[0] if length == 4 else None
            continue
        text = raw.decode(encoding, "replace").strip(" \0")
        if not text:
            value = None
        elif kind in "NF":
            try:
                value = int(text) if kind == "N" and "." not in text and "e" not in text.lower() else float(text)
                value = value if math.isfinite(value) else None
            except ValueError:
                value = None
        elif kind == "D":
            value = f"{text[:4]}-{text[4:6]}-{text[6:8]}" if len(text) == 8 and text.isdigit() else None
        elif kind == "L":
            value = {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        else:
            value = text
        values[name] = value
    return values


#: Records that a task decodes at once.
RANGE_RECORDS = 5000
_RANGE = "layer string, first long, places array<long>, shapes binary, rows binary, width int, fields string, encoding string"


def _record_ranges(range_records: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                places = record_places(r.shp, r.shx)
                head, width, fields = table_fields(r.dbf) if r.dbf else (0, 0, [])
                encoding = bytes(r.cpg).decode("ascii", "replace").strip() if r.cpg else "latin-1"
                try:
                    "".encode(encoding)
                except LookupError:
                    encoding = "latin-1"
                for a in range(0, len(places), range_records):
                    some = places[a : a + range_records]
                    low, high = min(p for p, _ in some), max(e for _, e in some)
                    rows = r.dbf[head + a * width : head + (a + len(some)) * width] if r.dbf else b""
                    yield pd.DataFrame([(r.layer, a, [p - low for p, _ in some], r.shp[low:high], rows, width, json.dumps(fields), encoding)], columns=["layer", "first", "places", "shapes", "rows", "width", "fields", "encoding"])

    return f


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            fields, rows = json.loads(r.fields), []
            for k, at in enumerate(r.places):
                row = r.rows[k * r.width : (k + 1) * r.width]
                values = table_row(row, fields, r.encoding) if row else {}
                if values is not None:
                    text = json.dumps(values, ensure_ascii=False)
                    rows += [(r.layer, text, kind, polygons) for kind, polygons in decode_shape(r.shapes, int(at) + 8)]
            yield pd.DataFrame(rows, columns=["layer", "properties", "gtype", "polygons"])


def read_shapefile(spark: SparkSession, path: str, range_records: int = RANGE_RECORDS) -> DataFrame:
    """Shapes and attributes (as JSON text) of a .shp file, or of all in a folder; the layer is the .shp file's path. Index, table and code page lie beside it under the same name."""
    reader = spark.read.format("binaryFile")
    files = reader.load(path[:-4] + ".{shp,shx,dbf,cpg}") if path.lower().endswith(".shp") else reader.option("pathGlobFilter", "*.{shp,shx,dbf,cpg}").load(path)
    own = F.regexp_extract("path", r"^(.*)\.(\w+)$", 1)
    kinds = [F.max(F.when(F.col("path").endswith(f".{k}"), F.col("content"))).alias(k) for k in ("shp", "shx", "dbf", "cpg")]
    whole = files.groupBy(F.concat(own, F.lit(".shp")).alias("layer")).agg(*kinds).where("shp IS NOT NULL")
    ranges = whole.mapInPandas(_record_ranges(range_records), _RANGE)
    return with_shapes(ranges.repartition("layer", "first").mapInPandas(_decoded, _SCHEMA))


def with_shapes(rows: DataFrame) -> DataFrame:
    """point, line, polygon, parts, points and lines beside the type: the one that fits is set, and parts for polygons of one and of several parts."""
    first = F.get("polygons", F.lit(0))
    ring = F.get(first, F.lit(0))
    of = lambda kind, shape: F.when(F.col("gtype") == kind, shape)
    parts = F.when(F.col("gtype").isin("Polygon", "MultiPolygon"), F.col("polygons"))
    return rows.select(
        "layer", "properties", "gtype",
        of("Point", F.get(ring, F.lit(0))).alias("point"), of("LineString", ring).cast(LINE).alias("line"), of("Polygon", first).alias("polygon"), parts.alias("parts"),
        of("MultiPoint", F.transform("polygons", lambda p: p[0][0])).alias("points"), of("MultiLineString", F.transform("polygons", lambda p: p[0])).alias("lines"),
    )
