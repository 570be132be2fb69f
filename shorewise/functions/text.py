"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epsg_from_urn(urn: Column) -> Column:
    """The EPSG code that a URN names; null without one, an error with several."""
    codes = F.regexp_extract_all(urn, F.lit(r"(?<=EPSG::)[0-9]{4,5}"), F.lit(0))
    return F.when(F.size(codes) > 1, F.raise_error(F.concat(F.lit("several EPSG codes: "), urn))).otherwise(F.get(codes, F.lit(0)))
