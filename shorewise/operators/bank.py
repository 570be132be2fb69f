"""Where the bank is predicted to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorewise.functions import geometry as G
from shorewise.operators.regions import nearest_region_line


def predicted_bank(predictions: DataFrame, regions: DataFrame, border: Column, lines: DataFrame, distance: str = "distance_to_erosion", key: str = "location_id") -> DataFrame:
    """predictions of known regions with line_ord, the nearest line, and bank: the region's part of the border, moved towards that line by the predicted distance.

    The part of the border, the line and the side are a region's own, whatever its predictions, and worked out once for each.
    """
    near = nearest_region_line(regions.select(key, "polygon"), lines).withColumn("scope", G.project_polygon(F.col("polygon"), border))
    own = near.select(key, "line_ord", "scope", G.side_of(F.col("scope"), F.col("line")).alias("side"))
    rows = predictions.join(own, key)
    return rows.withColumn("bank", G.offset(F.col("scope"), F.col(distance) * F.col("side"))).drop("scope", "side")
