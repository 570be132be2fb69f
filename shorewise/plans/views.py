"""The tables' stand-ins for geometry, alike in Spark and in SQL.

bank: dated points; rects: overlapping regions; objs: small boxes with classes;
lines and border: fixed polylines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewise.functions import geometry as G
from shorewise.operators.rows import spread

LINES = {
    0: [(0, -50), (40, 200), (60, 600), (100, 1050)],
    1: [(20, 0), (20, 1000)],
    2: [(390, 0), (370, 500), (395, 1000)],
}
BORDER = [(250, -10), (255, 400), (245, 700), (250, 1010)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_folder(spark: SparkSession) -> str:
    """A new folder for what a query writes and reads again: in the one that all executors share, or a local one where the session has none and runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or 'file:///tmp'}/shorewise-{uuid.uuid4().hex}"


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("location_id"), F.floor((F.day("ts") - 1) / 7).cast("int").alias("ahn_version"), "event_type",
        F.when(F.col("event_type") == "error", "BAD").otherwise("OK").alias("status"), F.col("value").alias("x"), (F.col("event_id") % 1000).cast("double").alias("y"), (F.col("value") - 50).alias("d"),
    )


def known_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("location_id"))


def solvent_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of the regions, so that a semi join has rows to reject."""
    return read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("location_id"))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(read(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select(F.col("s_suppkey").alias("location_id"), ((F.col("s_suppkey") % 10) * 40.0).alias("xmin"), (F.floor(F.col("s_suppkey") / 10) * 90.0).alias("ymin"))
    return df.withColumn("polygon", G.rectangle(F.col("xmin"), F.col("ymin"), F.col("xmin") + 50, F.col("ymin") + 110))


def objs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    df = spread(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey").select(key.alias("object_id"), "p_brand", "p_type", ((key * 53) % 400).cast("double").alias("xmin"), ((key * 37) % 1000).cast("double").alias("ymin"), F.col("p_size").cast("double").alias("w"), (F.col("p_size") / 2.0).alias("h"))
    return df.withColumn("shape", G.rectangle(F.col("xmin"), F.col("ymin"), F.col("xmin") + F.col("w"), F.col("ymin") + F.col("h")))


def lines(spark: SparkSession) -> DataFrame:
    rows = [(k, [(float(x), float(y)) for x, y in v]) for k, v in LINES.items()]
    return spark.createDataFrame(rows, f"line_ord int, line {G.LINE}")


BANK_SQL = """bank AS (SELECT event_id, user_id AS location_id, CAST(floor((extract(day FROM ts) - 1) / 7) AS INT) AS ahn_version, event_type,
  CASE WHEN event_type = 'error' THEN 'BAD' ELSE 'OK' END AS status, value AS x, CAST(event_id % 1000 AS DOUBLE) AS y, value - 50 AS d FROM events)"""
REGIONS_SQL = "regions AS (SELECT c_custkey AS location_id FROM customer)"
PROCESSED_SQL = f"""{BANK_SQL}, {REGIONS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY location_id, ahn_version ORDER BY d) AS rn FROM bank WHERE status = 'OK' AND location_id IN (SELECT location_id FROM regions)),
mean AS (SELECT location_id, ahn_version, avg(d) AS distance_to_erosion_border FROM ranked WHERE rn <= 3 GROUP BY ALL),
processed AS (SELECT *, coalesce(CAST(ahn_version - lag(ahn_version) OVER (PARTITION BY location_id ORDER BY ahn_version) AS DOUBLE), 1.0) AS timesteps_since_last_measurement FROM mean)"""
MODEL_SQL = """steps AS (SELECT location_id, row_number() OVER w AS n, CAST(distance_to_erosion_border - lag(distance_to_erosion_border) OVER w AS DOUBLE) / (ahn_version - lag(ahn_version) OVER w) AS speed FROM processed WINDOW w AS (PARTITION BY location_id ORDER BY ahn_version)),
model AS (SELECT location_id, CASE WHEN count(*) FILTER (n > 1) > 0 AND count(*) FILTER (n > 1) = count(speed) THEN avg(speed) END AS erosion_speed FROM steps GROUP BY location_id)"""
RECTS_SQL = "rects AS (SELECT s_suppkey AS location_id, (s_suppkey % 10) * 40.0::DOUBLE AS xmin, floor(s_suppkey / 10) * 90.0::DOUBLE AS ymin, xmin + 50 AS xmax, ymin + 110 AS ymax FROM supplier)"
OBJS_SQL = "objs AS (SELECT p_partkey AS object_id, p_brand, p_type, CAST((p_partkey * 53) % 400 AS DOUBLE) AS xmin, CAST((p_partkey * 37) % 1000 AS DOUBLE) AS ymin, CAST(p_size AS DOUBLE) AS w, p_size / 2.0::DOUBLE AS h, xmin + w AS xmax, ymin + h AS ymax FROM part)"
PAIRS_SQL = f"{RECTS_SQL}, {OBJS_SQL}, pairs AS (SELECT r.location_id, r.xmin AS rx0, r.ymin AS ry0, r.xmax AS rx1, r.ymax AS ry1, o.* FROM rects r JOIN objs o ON r.xmin <= o.xmax AND o.xmin <= r.xmax AND r.ymin <= o.ymax AND o.ymin <= r.ymax)"


def segments_sql(name: str, polylines: dict[int, list]) -> str:
    """A relation (line_ord, seg, ax, ay, bx, by, len, cum) of literal polylines."""
    rows = [(k, i, *a, *b) for k, v in polylines.items() for i, (a, b) in enumerate(zip(v[:-1], v[1:], strict=True))]
    values = ", ".join(f"({k}, {i}, {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)" for k, i, ax, ay, bx, by in rows)
    return f"""{name} AS (SELECT *, sum(len) OVER (PARTITION BY line_ord ORDER BY seg) - len AS cum FROM
  (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM (VALUES {values}) v(line_ord, seg, ax, ay, bx, by_)))"""


def feet_sql(name: str, points: str, keys: str, seg: str) -> str:
    """A relation with each point's nearest place on each line: keys, x, y, line_ord, fx, fy, dist, pos."""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, line_ord ORDER BY d2, seg) AS rk FROM
  (SELECT *, ax + t * (bx - ax) AS fx, ay + t * (by_ - ay) AS fy, (fx - x) * (fx - x) + (fy - y) * (fy - y) AS d2, sqrt(d2) AS dist, cum + t * len AS pos FROM
    (SELECT p.*, s.*, greatest(0.0, least(1.0, ((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / (len * len))) AS t FROM {points} p, {seg} s))) WHERE rk = 1)"""


def place_sql(seg: str, at: str, column: str) -> str:
    """A scalar: coordinate x or y of the place at a distance along the only line of a relation."""
    a, b = ("ax", "bx") if column == "x" else ("ay", "by_")
    whole = f"(SELECT sum(len) FROM {seg})"
    s = f"greatest(0.0, least({whole}, CASE WHEN ({at}) < 0 THEN ({at}) + {whole} ELSE ({at}) END))"
    return f"(SELECT arg_max({a} + least(1.0, ({s} - cum) / len) * ({b} - {a}), seg) FROM {seg} WHERE cum <= {s})"
