"""Reductions and selections of rows that the steps of an analysis share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorewise.functions import geometry as G


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, dealt over as many tasks as a shuffle has: for work that a row costs much of, where a small file would be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def value_counts(df: DataFrame, *columns: str, of: str | None = None, name: str = "n") -> DataFrame:
    """How often each combination of values occurs, or how often it does with a value of `of`; nulls are a value of their own."""
    return df.groupBy(*columns).agg(F.count(F.lit(1) if of is None else F.col(of)).alias(name)).orderBy(*columns)


def appended(first: DataFrame, *more: DataFrame) -> DataFrame:
    """The rows of all, by name; a column that one lacks is null there."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def reductions(df: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """Per key: whether any and whether every value is negative, the lowest and the highest, and the number of times."""
    v = F.col(value)
    return df.groupBy(key).agg(F.bool_or(v < 0).alias("any_negative"), F.bool_and(v < 0).alias("all_negative"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.countDistinct(time).alias("times"))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order."""
    return df.orderBy(*order).limit(n)


def ends(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Per key the value of its first and of its last row in an order."""
    at = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))


def sampled(df: DataFrame, key: str, share: float) -> DataFrame:
    """About a share of the rows: those whose key's digest is low, so that equal keys stay together and reruns agree. Null keys count as empty text."""
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(digest < F.lit(int(share * 2**32)))


def area_by(df: DataFrame, key: str, shape: Column, square_metres: float = 10_000.0, name: str = "area") -> DataFrame:
    """Per key the sum of areas, in a unit of so many square metres (hectares)."""
    return df.groupBy(key).agg((F.sum(G.area(shape)) / square_metres).alias(name))
