"""GeoJSON feature collections, and features one a line.

A collection is read in byte ranges. Spark's text reader splits it at closing braces,
whatever lies around them. A first pass reduces each range to what it does to
the nesting: how many brackets it closes, which it leaves open, and whether it ends within a string, for
both cases of its start. These few values, in order, give how each range starts. A second
pass then knows where features begin and end; those that a range's end cuts are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shorewise.functions.geometry import LINE, POINT, POLYGON, interpolate

_FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def _point(xy: Column) -> Column:
    return F.struct(F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"))


def _nested(text: Column, depth: int) -> Column:
    kind = "array<" * depth + "double" + ">" * depth
    value = F.from_json(text, kind)
    if depth == 1:
        return _point(value)
    if depth == 2:
        return F.transform(value, _point)
    if depth == 3:
        return F.transform(value, lambda r: F.transform(r, _point))
    return F.transform(value, lambda p: F.transform(p, lambda r: F.transform(r, _point)))


def with_geometry(features: DataFrame) -> DataFrame:
    """(properties, gtype, point, line, polygon, parts, points, lines): the one that fits the type is set, and parts for polygons of one and of several parts; a third dimension is dropped."""
    kind, text = F.col("feature.geometry.type"), F.col("feature.geometry.coordinates")
    of = lambda name, depth, cast: F.when(kind == name, _nested(text, depth)).cast(cast)
    polygon = of("Polygon", 3, POLYGON)
    return features.select(
        F.col("feature.properties").alias("properties"), kind.alias("gtype"),
        of("Point", 1, POINT).alias("point"), of("LineString", 2, LINE).alias("line"), polygon.alias("polygon"),
        F.coalesce(F.when(kind == "Polygon", F.array(polygon)), of("MultiPolygon", 4, f"array<{POLYGON}>")).alias("parts"),
        of("MultiPoint", 2, LINE).alias("points"), of("MultiLineString", 3, POLYGON).alias("lines"),
    )


_MARKS = re.compile(r'[{}\[\]"]')
#: The nesting within which a collection's features lie.
_INSIDE = "{["


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): text up to a closing brace, without it, in order within each range of a file."""
    return spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """Each range with its texts."""
    flat = ((f, s, v) for b in batches for f, s, v in zip(*(c.to_pylist() for c in b.columns), strict=True))
    held = next(flat, None)
    while held is not None:
        file, start, _ = held

        def texts() -> Iterator[str]:
            nonlocal held
            while held is not None and held[0] == file and held[1] == start:  # noqa: B023
                yield held[2]
                held = next(flat, None)

        yield file, start, texts()


def effect(texts: Iterator[str], quoted: bool) -> tuple[int, str, bool]:
    """What a range does to the nesting: brackets that it closes, those that it leaves open, and whether it ends in a string."""
    closes, opened = 0, []
    for text in texts:
        plain = (re.sub(r"\\.", "", text, flags=re.DOTALL) if "\\" in text else text) + "}"
        for mark in _MARKS.findall(plain):
            if mark == '"':
                quoted = not quoted
            elif not quoted:
                if mark in "{[":
                    opened.append(mark)
                elif opened:
                    opened.pop()
                else:
                    closes += 1
    return closes, "".join(opened), quoted


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, start, texts in _rows(batches):
        held = list(texts)
        (c0, o0, q0), (c1, o1, q1) = effect(held, False), effect(held, True)
        yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "c0": c0, "o0": o0, "q0": q0, "c1": c1, "o1": o1, "q1": q1}])


def starts(effects: list) -> dict[tuple[str, int], tuple[str, bool]]:
    """How each range starts: the brackets that are open, and whether a string is."""
    out, file, nesting, quoted = {}, None, "", False
    for r in sorted(effects, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, nesting, quoted = r["file"], "", False
        out[file, r["start"]] = nesting, quoted
        closes, opened, quoted = (r["c1"], r["o1"], r["q1"]) if quoted else (r["c0"], r["o0"], r["q0"])
        nesting = nesting[: max(0, len(nesting) - closes)] + opened
    return out


def pieces(texts: Iterator[str], nesting: str, quoted: bool) -> Iterator[tuple[str, str]]:
    """Features as (whole, text); what a range's end cuts as head, middle or tail; and the rest of the collection as frame."""
    depth, feature, inside, frame = list(nesting), [], len(nesting) > 2 and nesting.startswith(_INSIDE), []
    cut = inside
    for text in texts:
        text += "}"
        begin = at = 0
        while at < len(text):
            found = re.compile(r'["\\]' if quoted else r'[{}\[\]"]').search(text, at)
            if not found:
                break
            mark, at = found[0], found.end()
            if mark == "\\":
                at += 1
            elif mark == '"':
                quoted = not quoted
            elif mark in "{[":
                if not inside and mark == "{" and "".join(depth) == _INSIDE:
                    frame.append(text[begin : at - 1])
                    inside, begin = True, at - 1
                depth.append(mark)
            elif depth:
                depth.pop()
                if inside and "".join(depth) == _INSIDE:
                    feature.append(text[begin:at])
                    yield ("tail" if cut else "whole"), "".join(feature)
                    feature, inside, cut, begin = [], False, False, at
            else:  # what follows the collection
                text = text[: at - 1]
        (feature if inside else frame).append(text[begin:])
    if inside:
        yield ("middle" if cut else "head"), "".join(feature)
    yield "frame", "".join(frame)


def _pieces(known: dict[tuple[str, int], tuple[str, bool]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, texts in _rows(batches):
            rows: list[dict] = []
            for kind, text in pieces(texts, *known[file, start]):
                rows.append({"file": file, "start": start, "kind": kind, "text": text})
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)

    return f


_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("text", pa.string())])


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features of collections, read in byte ranges, and for each file a row (srid_urn) with the collection's CRS name.

    How the ranges start goes to the tasks as a row for each range of spark.sql.files.maxPartitionBytes.
    """
    ranges = _ranges(spark, path)
    effects = ranges.mapInArrow(_effects, "file string, start long, c0 long, o0 string, q0 boolean, c1 long, o1 string, q1 boolean")
    found = ranges.mapInArrow(_pieces(starts([r.asDict() for r in effects.collect()])), "file string, start long, kind string, text string")
    # a feature that a range's end cuts is known by the range in which it began
    began = F.last(F.when(F.col("kind") == "head", F.col("start")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start", F.col("kind") == "head"))
    cut = found.where("kind IN ('head', 'middle', 'tail')").withColumn("began", began)
    joined = cut.groupBy("file", "began").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p")).select(F.array_join(F.col("p.text"), "").alias("text"))
    texts = found.where("kind = 'whole'").select("text").union(joined)
    features = texts.select(F.from_json("text", _FEATURE).alias("feature")).where("feature.type = 'Feature'")
    frame = found.where("kind = 'frame'").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"))
    # what is left of the list of features is commas
    rest = F.regexp_replace(F.array_join(F.col("p.text"), ""), r"\[[\s,]*\]", "[]")
    urn = F.from_json(rest, "crs struct<type:string,properties:struct<name:string>>")["crs"]["properties"]["name"]
    return with_geometry(features), frame.select(urn.alias("srid_urn"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features one a line, read in parallel."""
    return with_geometry(parsed(F.col("value"), spark.read.text(path)))


def parsed(text: Column, df: DataFrame) -> DataFrame:
    """df with one column, feature: its features' JSON text taken apart."""
    return df.select(F.from_json(text, _FEATURE).alias("feature"))


def _pairs(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["x"], p["y"]))


def geometry_json(gtype: str, shape: Column) -> Column:
    """A geometry as a GeoJSON struct."""
    of = {"Point": lambda: F.array(shape["x"], shape["y"]), "LineString": lambda: _pairs(shape), "Polygon": lambda: F.transform(shape, _pairs)}
    return F.struct(F.lit(gtype).alias("type"), of[gtype]().alias("coordinates"))


def features(df: DataFrame, gtype: str, shape: str, properties: list[str]) -> DataFrame:
    """One feature as JSON text a row, in the column value."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry_json(gtype, F.col(shape)).alias("geometry"))).alias("value"))


def write_geojson(df: DataFrame, path: str, gtype: str, shape: str, properties: list[str]) -> None:
    """Features one a line, written in parallel."""
    features(df, gtype, shape, properties).write.mode("overwrite").text(path)


def timestamped_features(df: DataFrame, line: Column, distance: str = "distance_to_erosion", timestamp: str = "timestamp", keep: Sequence[str] = ()) -> DataFrame:
    """Features of the lines' middles with their time and the columns of keep, green where the distance is positive and red elsewhere."""
    color = F.when(F.col(distance) > 0, "green").otherwise("red")
    style = F.struct(color.alias("color"), F.lit(3).alias("weight"), F.lit(0.6).alias("opacity"))
    times = F.array(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"))
    made = df.select(interpolate(line, F.lit(0.5), normalized=True).alias("middle"), times.alias("times"), style.alias("style"), *keep)
    return features(made, "Point", "middle", ["times", "style", *keep])
