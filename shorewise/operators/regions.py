"""Aggregations of a layer's objects by region.

Regions carry a polygon. An object's `shape` is a point, a line, a polygon or an
array of polygons (an object of several parts); `kind` says which of the first
three, and parts go as polygons. Objects of the kind `any` have a geometry.ANY. The spatial join is an equi-join on the cells of a
tree that is built from a sample of the boxes (see spatial), with an exact predicate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorewise.config import FeatureGeneration
from shorewise.functions import crs
from shorewise.functions import geometry as G
from shorewise.functions import meets
from shorewise.functions.curves import rings_of
from shorewise.operators.nearest import nearest_of_regions, segments_of
from shorewise.operators.packed import PackedSegments
from shorewise.operators.rows import spread
from shorewise.operators.spatial import box_pairs
from shorewise.operators.sweep import covered_by, directed

#: Segments that a task may hold as a packed index; the lines of more are dealt over grids instead.
MAX_SEGMENTS = 1_000_000
STRIP_OBJECTS, MAX_STRIPS = 2000, 256
GEOMETRY_TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


def in_parts(df: DataFrame, shape: str = "shape") -> bool:
    """Whether the column holds arrays of polygons rather than polygons."""
    return df.schema[shape].dataType.simpleString().startswith("array<array<array<")


def shapes_of(features: DataFrame, kind: str) -> DataFrame:
    """Features as the readers give them, with their shape as `shape`; any that isn't of the kind stops the query, and null geometries are left out. The kind `any` takes all."""
    names = {"point": ("Point",), "line": ("LineString",), "polygon": ("Polygon", "MultiPolygon"), "any": tuple(GEOMETRY_TYPES)}[kind]
    wrong = F.raise_error(F.concat(F.lit(f"only {kind} geometries are allowed here, not "), F.col("gtype")))
    if kind == "any":
        there = {"points": F.coalesce("points", F.array("point")), "lines": F.coalesce("lines", F.array("line")), "parts": F.col("parts")}
        owned = {"points": ("Point", "MultiPoint"), "lines": ("LineString", "MultiLineString"), "parts": ("Polygon", "MultiPolygon")}
        shape = G.any_shape(**{n: F.when(F.col("gtype").isin(*owned[n]), c) for n, c in there.items()})
    else:
        shape = F.col({"polygon": "parts"}.get(kind, kind))
    return features.where("gtype IS NOT NULL").withColumn("shape", F.when(F.col("gtype").isin(*names), shape).when(F.col("gtype").isNotNull(), wrong))


def _boxed(df: DataFrame, shape: str, kind: str) -> DataFrame:
    if kind == "any":
        box = G.bounds(F.array(G.any_corners(F.col(shape))))
    elif kind == "polygon" and in_parts(df, shape):
        box = G.bounds(F.flatten(shape))
    elif kind == "point":
        box = F.struct(*[F.col(f"{shape}.{c}").alias(n) for n, c in (("xmin", "x"), ("ymin", "y"), ("xmax", "x"), ("ymax", "y"))])
    elif kind == "line":
        box = G.bounds(F.array(F.col(shape)))
    else:
        box = G.bounds(F.col(shape))
    return df.withColumn("__box", box).where("__box.xmin IS NOT NULL")


def _candidates(regions: DataFrame, objects: DataFrame, kind: str) -> DataFrame:
    """Regions (location_id, polygon) with the objects (all other columns) whose boxes meet theirs; the boxes as __a and __b."""
    a = _boxed(regions.select("location_id", "polygon"), "polygon", "polygon").withColumnRenamed("__box", "__a")
    b = _boxed(objects.drop("location_id", "polygon"), "shape", kind).withColumnRenamed("__box", "__b")
    return box_pairs(a, b)


def _meeting(candidates: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    polygon, shape = F.col("polygon"), F.col("shape")
    if kind == "point":
        return candidates.where((G.within if strict else G.covers)(polygon, shape["x"], shape["y"]))
    return candidates.where(meets.meets(polygon, shape, "parts" if kind == "polygon" and in_parts(candidates) else kind))


def spatial_pairs(regions: DataFrame, objects: DataFrame, *, kind: str = "polygon", strict: bool = False) -> DataFrame:
    """Regions (location_id, polygon) with the objects (shape, and all other columns but those two) that intersect them, or, if points, lie strictly within them."""
    return _meeting(_candidates(regions, objects, kind), kind, strict).drop("__a", "__b")


def pairs_within(regions: DataFrame, objects: DataFrame) -> DataFrame:
    """Regions with the polygons that lie in them, boundaries included. Boxes are compared before shapes."""
    held = [F.col(f"__b.{c}") >= F.col(f"__a.{c}") for c in ("xmin", "ymin")] + [F.col(f"__b.{c}") <= F.col(f"__a.{c}") for c in ("xmax", "ymax")]
    pairs = _candidates(regions, objects, "polygon").where(held[0] & held[1] & held[2] & held[3])
    return pairs.where(meets.polygon_within(F.col("shape"), F.col("polygon"))).drop("__a", "__b")


def _all(regions: DataFrame, found: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Every region, with the defaults where nothing was found."""
    joined = regions.select("location_id").join(found, "location_id", "left")
    return joined.select("location_id", *[F.coalesce(F.col(f"`{c}`"), v).alias(c) for c, v in defaults.items()])


def numerical_density(regions: DataFrame, points: DataFrame, **options) -> DataFrame:
    """Points strictly within a region by its area."""
    found = spatial_pairs(regions, points, kind="point", strict=True, **options).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))
    rows = regions.join(found, "location_id", "left")
    return rows.select("location_id", F.coalesce(F.try_divide(F.col("n").cast("double"), G.area(F.col("polygon"))), F.lit(0.0)).alias("numerical_density"))


def intersecting(regions: DataFrame, objects: DataFrame, columns: list[str] | str = (), *, kind: str = "polygon", **options) -> DataFrame:
    """count, total_area (whole areas, overlaps counted each time) and majority_class_{column} of the intersecting objects, in one pass. The smallest of equally frequent classes holds; nulls don't count."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    if missing := set(columns) - set(objects.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    own = {"any": G.any_area, "polygon": G.parts_area if in_parts(objects) else G.area}.get(kind)
    if own:  # once an object, not once a pair
        objects = objects.withColumn("__size", own(F.col("shape")))
    pairs = spatial_pairs(regions, objects.select("shape", *dict.fromkeys(columns), *(["__size"] if own else [])), kind=kind, **options)
    size = F.sum("__size") if own else F.lit(0.0)
    modes = [F.mode(F.col(f"`{c}`"), True).alias(f"majority_class_{c}") for c in columns]
    found = pairs.groupBy("location_id").agg(F.count(F.lit(1)).alias("count"), size.alias("total_area"), *modes)
    none = F.lit(None).cast("string")
    return _all(regions, found, {"count": F.lit(0), "total_area": F.lit(0.0), **{f"majority_class_{c}": none for c in columns}})


def covered_area(polygon: list[np.ndarray], objects: list[list[np.ndarray]], low: float = -np.inf, high: float = np.inf) -> float:
    """Area of the part of the polygon (rings of points) between x of low and high that any of the objects covers."""
    return covered_by(directed(polygon), list(map(directed, objects)), low, high)


def _strips(pairs: DataFrame, strip_objects: int) -> DataFrame:
    """(location_id, bounds): where each region is cut, so that about as many objects begin in each strip."""
    fractions = F.array(*[F.lit(k / MAX_STRIPS) for k in range(1, MAX_STRIPS)])
    found = pairs.groupBy("location_id").agg(F.least(F.lit(MAX_STRIPS), F.ceil(F.count(F.lit(1)) / strip_objects)).cast("int").alias("n"), F.percentile_approx("__b.xmin", fractions).alias("at"), F.first("__a").alias("__r"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.get(F.col("at"), (k * F.lit(MAX_STRIPS) / F.col("n")).cast("int") - 1))
    inner = F.filter(F.when(F.col("n") > 1, cuts).otherwise(F.array().cast("array<double>")), lambda x: (x > F.col("__r.xmin")) & (x < F.col("__r.xmax")))
    return found.select("location_id", F.array_sort(F.array_distinct(F.concat(F.array("__r.xmin"), inner, F.array("__r.xmax")))).alias("bounds"))


def area_fraction(regions: DataFrame, objects: DataFrame, *, strip_objects: int = STRIP_OBJECTS) -> DataFrame:
    """Share of a region's area that objects cover, overlaps counted once.

    A region with many objects is cut into upright strips, each a group of its own with
    one copy of the region's edges, so that no task holds all the objects of a crowded
    region; beyond MAX_STRIPS strips have more objects. A sweep measures each strip.
    """
    if in_parts(objects):  # each part covers for itself
        objects = objects.withColumn("shape", F.explode("shape"))
    # equal objects cover nothing more
    near = _candidates(regions, objects.select("shape").distinct(), "polygon")
    crowded = near.groupBy("location_id").count().where(F.col("count") > strip_objects)
    edges = G.directed_edges(F.col("shape")).alias("edges")
    if crowded.isEmpty():  # where boxes meet but shapes don't, nothing is covered
        rows = near.select("location_id", F.lit(0).alias("strip"), edges)
        own = regions.select("location_id", "polygon", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).alias("strip"))
    else:
        pairs = near.select("location_id", "__a", "__b", edges)
        cut = _strips(pairs, strip_objects)
        strip = F.filter(F.sequence(F.lit(0), F.greatest(F.size("bounds") - 2, F.lit(0))), lambda k: (F.get("bounds", k) <= F.col("__b.xmax")) & (F.get("bounds", k + 1) >= F.col("__b.xmin")))
        rows = pairs.join(cut, "location_id").select("location_id", F.explode(strip).alias("strip"), "edges")
        every = F.sequence(F.lit(0), F.greatest(F.size("bounds") - 2, F.lit(0)))
        own = regions.join(cut, "location_id").select("location_id", "polygon", "bounds", F.explode(every).alias("strip"))
        own = own.select("location_id", "polygon", F.get("bounds", F.col("strip")).alias("low"), F.get("bounds", F.col("strip") + 1).alias("high"), "strip")
    # a column of its own: both sides of the cogroup come from the same regions
    own = own.select(F.col("location_id").alias("location_id"), "strip", G.directed_edges(F.col("polygon")).alias("own"), "low", "high")

    def one(key: tuple, region: pd.DataFrame, inside: pd.DataFrame) -> pd.DataFrame:
        if region.empty or inside.empty or region["own"].iloc[0] is None:
            return pd.DataFrame({"location_id": [], "covered": []})
        r = region.iloc[0]
        return pd.DataFrame({"location_id": [key[0]], "covered": [covered_by(r["own"].reshape(-1, 4), [e.reshape(-1, 4) for e in inside["edges"]], r["low"], r["high"])]})

    kind = regions.schema["location_id"].dataType.simpleString()
    # few bytes and much work: not put together to few tasks
    own, rows = spread(own, "location_id", "strip"), spread(rows, "location_id", "strip")
    strips = own.groupBy("location_id", "strip").cogroup(rows.groupBy("location_id", "strip")).applyInPandas(one, f"location_id {kind}, covered double")
    found = regions.join(strips.groupBy("location_id").agg(F.sum("covered").alias("covered")), "location_id", "left")
    return found.select("location_id", F.coalesce(F.try_divide(F.col("covered"), G.area(F.col("polygon"))), F.lit(0.0)).alias("area_fraction"))


def nearest_region_line(regions: DataFrame, lines: DataFrame, order: str = "line_ord", line: str = "line", max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """Regions with the line nearest to each (the first of equally near ones); null without a polygon.

    Up to max_segments segments travel with the tasks as an index (see packed);
    those of more meet the regions over nested grids (see nearest), with the same result.
    """
    segments = segments_of(lines, order, line)
    n = segments.limit(max_segments + 1).count()
    if not n:
        raise ValueError("there are no lines")
    if n > max_segments:
        found = nearest_of_regions(regions, lines, segments, order, line).withColumnRenamed("polygon", "__polygon")
        return regions.join(found, F.col("polygon") == F.col("__polygon"), "left").drop("__polygon")
    index = PackedSegments.of(segments)

    @F.arrow_udf("struct<o: bigint, d: double>")
    def near(polygons: pa.Array) -> pa.Array:
        there = np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(polygons), 0), False).to_numpy(zero_copy_only=False))
        o, d, none = np.zeros(len(polygons), np.int64), np.zeros(len(polygons)), np.ones(len(polygons), bool)
        if len(there):
            o[there], d[there] = index.nearest_of_polygons(rings_of(polygons.take(pa.array(there))))
            none[there] = False
        return pa.StructArray.from_arrays([pa.array(o, mask=none), pa.array(d, mask=none)], names=["o", "d"])

    whole = lines.select(F.col(order).cast("long").alias("__o"), F.col(order).alias("line_ord"), F.col(line).alias("line"))
    found = regions.withColumn("__near", near(F.col("polygon")))
    return found.join(whole, F.col("__near.o") == F.col("__o"), "left").select(*regions.columns, "line_ord", "line", F.col("__near.d").alias("line_distance"))


def centerline_shape(regions: DataFrame, lines: DataFrame, neighbourhood_radius: float = 100.0) -> DataFrame:
    """How the nearest line bends near each region."""
    return nearest_region_line(regions, lines).select("location_id", G.line_shape(F.col("polygon"), F.col("line"), neighbourhood_radius).alias("centerline_shape"))


def clip_layer(objects: DataFrame, source: DataFrame, *, kind: str = "polygon", source_epsg: int | None = None, layer_epsg: int | None = None, **options) -> DataFrame:
    """Objects of a local layer that intersect any polygon of source, each once, in the source's CRS (the layer's is layer_epsg)."""
    if layer_epsg != source_epsg:
        move = lambda line: crs.transform(line, layer_epsg, source_epsg)
        one = lambda polygon: F.transform(polygon, move)
        if kind == "point":
            shape = F.get(crs.transform(F.array("shape"), layer_epsg, source_epsg), F.lit(0))
        elif kind == "line":
            shape = move(F.col("shape"))
        elif kind == "any":
            s = F.col("shape")
            shape = G.any_shape(move(s["points"]), F.transform(s["lines"], move), F.transform(s["parts"], one))
        else:
            shape = F.transform("shape", one) if in_parts(objects) else one(F.col("shape"))
        objects = objects.withColumn("shape", shape)
    rows = objects.select(F.struct("*").alias("object"), F.col("shape"), F.sha2(F.to_json(F.struct("*")).cast("binary"), 256).alias("mark"))
    found = spatial_pairs(source.select(F.lit(0).alias("location_id"), "polygon"), rows, kind=kind, **options)
    # equal objects are as many after the clip as before it
    copies = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("copies"))
    once = found.dropDuplicates(["mark"]).join(copies, "mark")
    return once.select("object.*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def region_features(regions: DataFrame, layer: str, objects: DataFrame, config: FeatureGeneration, kind: str = "polygon") -> DataFrame:
    """One row per region with the layer's configured aggregations, each named {layer}_{operation}; regions are joined by key."""
    out, active = regions.select("location_id"), config.active()
    classes = (config.majority_class or {}).get("columns", [])
    classes = [classes] if isinstance(classes, str) else classes
    parts: list[DataFrame] = []
    if "numerical_density" in active:
        parts.append(numerical_density(regions, objects))
    if {"count", "total_area", "majority_class"} & set(active):
        found = intersecting(regions, objects, classes if "majority_class" in active else [], kind=kind)
        parts.append(found.drop(*[c for c in ("count", "total_area") if c not in active]))
    if "area_fraction" in active:
        parts.append(area_fraction(regions, objects))
    if "centerline_shape" in active:
        parts.append(centerline_shape(regions, objects, **config.centerline_shape))
    for part in parts:
        out = out.join(part.withColumnsRenamed({c: f"{layer}_{c}" for c in part.columns if c != "location_id"}), "location_id", "left")
    return out


def attach(processed: DataFrame, features: DataFrame) -> DataFrame:
    """Processed rows with their region's features; all rows stay, and features that are already there are replaced."""
    names = [c for c in features.columns if c != "location_id"]
    return processed.drop(*names).join(features, "location_id", "left")
