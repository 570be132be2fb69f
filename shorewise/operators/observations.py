"""From dated point observations to one signed distance per region and time step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorewise.functions import geometry as G
from shorewise.operators.nearest import nearest_of_points, segments_of
from shorewise.operators.packed import PackedSegments

#: Segments of all candidate lines that a task may hold as a packed index; more are dealt over grids instead.
MAX_SEGMENTS = 1_000_000


def no_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    kinds = dict(df.dtypes)
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def in_known_regions(points: DataFrame, regions: DataFrame, key: str = "location_id") -> DataFrame:
    """Points whose region is known; a null region never is. Spark broadcasts the regions if they are small."""
    return points.join(regions.select(key).distinct(), key, "left_semi")


def certain_points(points: DataFrame, status: str = "status", good: str = "OK") -> DataFrame:
    return points.where(F.col(status) == good)


def _nearest(index: PackedSegments):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("__x", "__y"))
            there = np.isfinite(x) & np.isfinite(y)
            line, best = np.full(len(x), -1, np.int64), np.full((len(x), 3), np.nan)
            line[there], best[there, 0], best[there, 1:] = index.nearest(x[there], y[there])
            best[:, 0] = np.sqrt(best[:, 0])
            arrays = [pa.array(line, pa.int64(), mask=~there), *[pa.array(best[:, k], mask=~there) for k in range(3)]]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, "__line", "__distance", "__nx", "__ny"])

    return f


def nearest_line(points: DataFrame, lines: DataFrame, x: str = "x", y: str = "y", order: str = "line_ord", line: str = "line", prefix: str = "nearest", max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """points with {prefix}_line (its order; the first of equally near ones), {prefix}_distance, {prefix}_x and {prefix}_y.

    Up to max_segments segments travel with the tasks as an index (see packed), and
    points stay where they are. More segments meet the distinct places of the points
    over nested grids (see nearest); the result is the same.
    """
    if lines.isEmpty() or not lines.where(F.col(line).isNull()).isEmpty():
        raise ValueError("nearest lines need at least one line, and no null ones")
    segments = segments_of(lines, order, line)
    rows = points.select("*", F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    if segments.limit(max_segments + 1).count() > max_segments:
        found = nearest_of_points(rows.select(F.col("__x").alias("px"), F.col("__y").alias("py")), segments)
        found = found.withColumnsRenamed({"px": "__px", "py": "__py", "o": "__line", "distance": "__distance", "nx": "__nx", "ny": "__ny"})
        out = rows.join(found, (F.col("__x") == F.col("__px")) & (F.col("__y") == F.col("__py")), "left").drop("__px", "__py")
    else:
        kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "__line long", "__distance double", "__nx double", "__ny double"])
        out = rows.mapInArrow(_nearest(PackedSegments.of(segments)), kind)
    return out.drop("__x", "__y").withColumnsRenamed({"__line": f"{prefix}_line", "__distance": f"{prefix}_distance", "__nx": f"{prefix}_x", "__ny": f"{prefix}_y"})


def signed_distance(points: DataFrame, border: Column, lines: DataFrame, x: str = "x", y: str = "y", name: str = "distance_to_erosion_border") -> DataFrame:
    """points with the distance to the border: positive between the border and the point's nearest centerline, else negative."""
    px, py = F.col(x), F.col(y)
    found = nearest_line(points, lines, x, y, prefix="__c").withColumn("__p", G.nearest_point(border, px, py))
    factor = F.when(G.between(px, py, G.point(F.col("__c_x"), F.col("__c_y")), F.col("__p")), 1.0).otherwise(-1.0)
    far = F.sqrt((F.col("__p.x") - px) ** 2 + (F.col("__p.y") - py) ** 2)
    return found.withColumn(name, far * factor + F.lit(0.0)).drop("__p", "__c_line", "__c_distance", "__c_x", "__c_y")


def bottom_n_mean(points: DataFrame, keys: list[str], value: str, n: int = 3, name: str = "distance_to_erosion_border") -> DataFrame:
    """Mean of the n smallest values of each group; nulls come last and don't count; groups with a null key go."""
    rows = points.dropna(subset=keys).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())))
    return rows.where(F.col("__rank") <= n).groupBy(*keys).agg(F.avg(value).alias(name))


def time_since_last(df: DataFrame, key: str = "location_id", time: str = "ahn_version", name: str = "timesteps_since_last_measurement") -> DataFrame:
    """Time since the region's row before; 1 for its first."""
    w = Window.partitionBy(key).orderBy(time)
    return df.withColumn(name, F.coalesce((F.col(time) - F.lag(time).over(w)).cast("double"), F.lit(1.0)))


def process_observations(points: DataFrame, regions: DataFrame, config, border: Column | None = None, lines: DataFrame | None = None, value: str | None = None) -> DataFrame:
    """One row per region and time: bottom-n mean signed distance and time since the last. value names a distance that is already there."""
    key, time = config.prediction_region_id_column_name, config.timestamp_column_name
    rows = in_known_regions(no_nan(points), regions, key)
    rows = certain_points(rows) if config.use_only_certain_river_bank_points else rows
    if value is None:
        rows, value = signed_distance(rows, border, lines, name="__value"), "__value"
    mean = bottom_n_mean(rows, [key, time], value, config.no_of_points_for_distance_calculation)
    return time_since_last(mean, key, time)
