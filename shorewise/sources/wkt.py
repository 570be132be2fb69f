"""Points, lines and polygons from well-known text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def _points(text: Column) -> Column:
    def one(pair: Column) -> Column:
        numbers = F.regexp_extract_all(pair, F.lit(_NUMBER), F.lit(0))
        return F.struct(F.get(numbers, F.lit(0)).cast("double").alias("x"), F.get(numbers, F.lit(1)).cast("double").alias("y"))

    return F.transform(F.split(text, ","), one)


def parse_point(wkt: Column) -> Column:
    return F.when(F.upper(wkt).rlike(r"^\s*POINT"), F.get(_points(wkt), F.lit(0)))


def parse_line(wkt: Column) -> Column:
    return F.when(F.upper(wkt).rlike(r"^\s*LINESTRING"), _points(wkt))


def parse_polygon(wkt: Column) -> Column:
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.when(F.upper(wkt).rlike(r"^\s*POLYGON"), F.transform(rings, _points))
