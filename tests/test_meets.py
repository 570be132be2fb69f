"""Exact tests of pairs against the expressions of one pair, and crowds dealt over keys and tasks."""

import random

import pytest
from pyspark.sql import functions as F

from shorewise.functions import geometry as G
from shorewise.functions import meets as M
from shorewise.operators import regions, spatial
from shorewise.plans import views


def ring(rng):
    """Small whole coordinates, so that corners and edges often touch."""
    x, y, w, h = rng.randint(0, 9), rng.randint(0, 9), rng.randint(1, 6), rng.randint(1, 6)
    shape = rng.choice([[(0, 0), (w, 0), (w, h), (0, h)], [(0, 0), (w, 0), (0, h)], [(0, 0), (w, 0), (w, h), (w / 2, h / 3)]])
    points = [(float(x + a), float(y + b)) for a, b in shape]
    return [*points, points[0]]


def polygon(rng):
    if rng.random() < 0.3:
        x, y = rng.randint(0, 6), rng.randint(0, 6)
        box = lambda a, b: [(float(x + p), float(y + q)) for p, q in ((a, a), (b, a), (b, b), (a, b), (a, a))]
        return [box(0, 6), box(1, 5)]
    return [ring(rng)]


def line(rng):
    return [(float(rng.randint(0, 12)), float(rng.randint(0, 12))) for _ in range(rng.randint(1, 4))]


KINDS = {
    "polygon": (G.POLYGON, polygon, G.intersects),
    "line": (G.LINE, line, G.line_intersects),
    "parts": (f"array<{G.POLYGON}>", lambda rng: [polygon(rng) for _ in range(rng.randint(0, 3))], G.parts_intersect),
    "any": (G.ANY, lambda rng: (rng.choice([None, line(rng)]), rng.choice([None, [line(rng)]]), rng.choice([None, [polygon(rng)]])), G.any_intersects),
}


@pytest.mark.parametrize("kind", KINDS)
def test_meets(spark, kind):
    rng = random.Random(3)
    form, make, one = KINDS[kind]
    rows = [(k, polygon(rng), make(rng)) for k in range(1500)] + [(1500, polygon(rng), None)]
    df = spark.createDataFrame(rows, f"id int, a {G.POLYGON}, b {form}")
    # a plan of its own each: the optimizer may not mix both
    want = {r.id for r in df.where(one(F.col("a"), F.col("b"))).select("id").collect()}
    got = {r.id for r in df.where(M.meets(F.col("a"), F.col("b"), kind)).select("id").collect()}
    assert got == want and 100 < len(want) < 1500


def test_within(spark):
    rng = random.Random(5)
    rows = [(k, [ring(rng)], polygon(rng)) for k in range(3000)] + [(k, p, p) for k, p in enumerate((polygon(rng) for _ in range(20)), 3000)]
    df = spark.createDataFrame(rows, f"id int, a {G.POLYGON}, b {G.POLYGON}")
    want = {r.id for r in df.where(G.polygon_within(F.col("a"), F.col("b"))).select("id").collect()}
    got = {r.id for r in df.where(M.polygon_within(F.col("a"), F.col("b"))).select("id").collect()}
    assert got == want and set(range(3000, 3020)) <= got and len(got) > 30


def test_many_edges_are_compared_in_batches(spark, monkeypatch):
    monkeypatch.setattr(M, "_CELLS", 7)
    test_meets(spark, "polygon")


def test_a_crowd_is_dealt_over_keys(spark):
    """Objects in one place, more than a key should hold, meet many regions there: each pair once, and no key has them all."""
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    a = spark.createDataFrame([(k, (0.0, 0.0, 5.0 + k, 5.0)) for k in range(60)] + [(k, (1000.0 * k, 9.0, 1000.0 * k + 1, 10.0)) for k in range(60, 300)], f"a_id int, __a {box}")
    b = spark.createDataFrame([(k, (2.0, 2.0, 3.0, 3.0)) for k in range(2000)], f"b_id int, __b {box}")
    pairs = spatial.box_pairs(a, b, key_rows=100).select("a_id", "b_id")
    assert sorted(map(tuple, pairs.collect())) == [(i, j) for i in range(60) for j in range(2000)]
    far = spatial.near(spatial.sampled(a, "__a"), spatial.sampled(b, "__b").extent)
    assert far.n == 60 == len(far.sample) == far.df.count()
    keys = spark.createDataFrame([(1, 1, 20)], "__cell long, __left int, __right int")
    rows = spatial.dealt(b.withColumn("__cell", F.lit(1).cast("long")), keys, "__right", "__left", ["b_id"])
    assert rows.count() == 2000 and rows.groupBy("__right_share").count().agg({"count": "max"}).first()[0] < 200


def test_rows_of_small_files_are_dealt_over_tasks(spark, sf_dir):
    for df in (views.objs(spark, sf_dir), views.rects(spark, sf_dir)):
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_classes_and_areas(spark):
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
    r = spark.createDataFrame([(1, square)], f"location_id int, polygon {G.POLYGON}")
    o = spark.createDataFrame([(square, "x", 1), (square, None, 2)], f"shape {G.POLYGON}, name string, other int")
    row = regions.intersecting(r, o, ["other"]).first()
    assert (row["count"], row.total_area, row.majority_class_other) == (2, 32.0, 1)
