import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorewise.functions import crs
from shorewise.functions import geometry as G
from shorewise.functions.curves import buffered
from shorewise.functions.text import epsg_from_urn
from shorewise.operators import observations, regions


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def poly(*rings):
    return F.array(*[G.line([*r, r[0]]) for r in rings])


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


def test_area_and_centroid(spark):
    assert value(spark, G.area(poly(SQUARE))) == 16
    assert value(spark, G.area(poly(SQUARE, [(1, 1), (1, 2), (2, 2), (2, 1)]))) == 15
    c = value(spark, G.centroid(poly([(0, 0), (6, 0), (0, 6)])))
    assert (c.x, c.y) == pytest.approx((2, 2))
    assert value(spark, G.centroid(poly([(0, 0), (1, 1), (2, 2)]))).x is None


def test_line_measures(spark):
    line = G.line([(0, 0), (10, 0), (10, 10)])
    assert value(spark, G.distance(line, F.lit(5.0), F.lit(3.0))) == 3
    assert value(spark, G.project(line, F.lit(12.0), F.lit(4.0))) == 14
    at = lambda s, **k: tuple(value(spark, G.interpolate(line, F.lit(float(s)), **k)))
    assert at(0) == (0, 0) and at(10) == (10, 0) and at(15) == (10, 5) and at(99) == (10, 10)
    assert at(-5) == (10, 5) and at(-99) == (0, 0)  # negative counts from the end
    assert at(0.5, normalized=True) == (10, 0)


def test_straight_line_has_no_shape(spark):
    triangle = poly([(30, 18), (42, 21), (33, 30)])
    for r in (2.5, 40):
        assert value(spark, G.line_shape(triangle, G.line([(-70, -10), (110, 50)]), r)) == pytest.approx(0, abs=1e-9)


def test_between(spark):
    west, east = G.line([(-30, 5), (-10, 80)]), G.line([(40, 0), (55, 35), (40, 90)])
    for x, y, want in ((12.0, 40.0, True), (80.0, 40.0, False), (-60.0, 20.0, False), (40.0, 0.0, False)):
        foot = lambda line: G.nearest_point(line, F.lit(x), F.lit(y))  # noqa: B023, E731
        for a, b in ((west, east), (east, west)):
            assert value(spark, G.between(F.lit(x), F.lit(y), foot(a), foot(b))) is want


def test_point_in_polygon(spark):
    p = poly(SQUARE)
    for x, y, strict, inclusive in ((2, 2, True, True), (0, 2, False, True), (4, 4, False, True), (5, 2, False, False)):
        assert value(spark, G.within(p, F.lit(float(x)), F.lit(float(y)))) is strict
        assert value(spark, G.covers(p, F.lit(float(x)), F.lit(float(y)))) is inclusive


def test_intersects(spark):
    p = poly(SQUARE)
    cases = [([(4, 0), (6, 0), (6, 2)], True), ([(4, 4), (6, 4), (6, 6)], True), ([(1, 1), (2, 1), (2, 2)], True), ([(-1, -1), (9, -1), (9, 9), (-1, 9)], True), ([(5, 5), (6, 5), (6, 6)], False)]
    for other, want in cases:
        assert value(spark, G.intersects(p, poly(other))) is want
        assert value(spark, G.intersects(poly(other), p)) is want


def test_crossing_line_has_distance_zero(spark):
    far = [(i, 0) for i in (0, 10)]
    assert value(spark, G.polygon_line_distance(poly([(4, -5), (6, -5), (6, 5), (4, 5)]), G.line(far))) == 0
    assert value(spark, G.polygon_line_distance(poly([(4, 3), (6, 3), (6, 5)]), G.line(far))) == 3


def test_cosine(spark):
    rng = random.Random(4)
    for n in range(1, 12):
        a = [rng.uniform(-5, 5) for _ in range(n)]
        b = [rng.uniform(-5, 5) for _ in range(n)]
        col = lambda v: F.array(*map(F.lit, v))
        assert value(spark, G.cosine_similarity(col(a), col(a))) == pytest.approx(1)
        assert value(spark, G.cosine_similarity(col(a), col(b))) == pytest.approx(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    assert value(spark, G.cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_offset_and_side(spark):
    moved = value(spark, G.offset(G.line([(0, 0), (10, 0)]), F.lit(2.0)))
    assert [tuple(p) for p in moved] == [(0, 2), (10, 2)]
    for centre, want in (([(0, 9), (10, 9)], 2), ([(0, -9), (10, -9)], -2)):
        assert value(spark, G.move_to_side(G.line([(0, 0), (10, 0)]), F.lit(2.0), G.line(centre)))[0].y == want


def test_crs_against_published_point(spark):
    # the projection's origin, by definition, and a round trip over the country
    p = value(spark, crs.to_wgs84(F.lit(155000.0), F.lit(463000.0)))
    assert (p.x, p.y) == pytest.approx((5.3872, 52.1552), abs=1e-4)
    for x, y in ((20000, 370000), (130000, 425000), (270000, 600000)):
        w = value(spark, crs.to_wgs84(F.lit(float(x)), F.lit(float(y))))
        b = value(spark, crs.to_rd(F.lit(w.x), F.lit(w.y)))
        assert (b.x, b.y) == pytest.approx((x, y), abs=1e-3)
    with pytest.raises(ValueError):
        crs.transform(F.lit(None), 1, 2)


def test_epsg(spark):
    assert value(spark, epsg_from_urn(F.lit("urn:ogc:def:crs:EPSG::28992"))) == "28992"
    assert value(spark, epsg_from_urn(F.lit("nothing"))) is None
    with pytest.raises(Exception, match="several"):
        value(spark, epsg_from_urn(F.lit("EPSG::28992 EPSG::4326")))


def rings(*points):
    return [np.array([*p, p[0]], float) for p in points]


def corners(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d)]


def test_covered_area():
    outer = rings(corners(0, 0, 20, 20))
    assert regions.covered_area(outer, [rings(corners(2, 3, 6, 8)), rings(corners(5, 5, 9, 10))]) == pytest.approx(20 + 20 - 3)
    assert regions.covered_area(outer, [rings(corners(18, 17, 25, 30)), rings([(0, 0), (6, 0), (0, 8)])]) == pytest.approx(6 + 24)
    assert regions.covered_area(outer, [rings(corners(1, 1, 9, 9), corners(3, 3, 5, 5)[::-1])]) == pytest.approx(60)  # a hole
    assert regions.covered_area(rings(corners(0, 0, 10, 10), corners(4, 4, 6, 6)), [rings(corners(5, 0, 20, 10))]) == pytest.approx(48)
    assert regions.covered_area(outer, []) == 0 and regions.covered_area(outer, [rings(corners(30, 0, 40, 10))]) == 0


def _stars(rng, n, size):
    """Simple polygons: a corner in each of some sectors around a centre."""
    out = []
    for _ in range(n):
        x, y, k = rng.uniform(0, 10), rng.uniform(0, 10), int(rng.integers(3, 9))
        angle, far = (np.arange(k) + rng.uniform(0, 0.9, k)) * 2 * np.pi / k, size * rng.uniform(0.3, 1, k)
        p = list(zip(x + far * np.cos(angle), y + far * np.sin(angle), strict=True))
        out.append(rings(p[:: int(rng.choice([-1, 1]))]))
    return out


def _inside(polygon, x, y):
    odd = np.zeros(x.shape, bool)
    for r in polygon:
        for (ax, ay), (bx, by) in zip(r[:-1], r[1:], strict=True):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return odd


@pytest.mark.parametrize("seed", range(6))
def test_covered_area_of_stars_and_crosses(seed):
    """Against a fine lattice, and cut into strips; on whole numbers against unit squares, where edges coincide and many meet in a point."""
    rng = np.random.default_rng(seed)
    outer, shapes = rings([(1, 1), (9, 0), (8, 9), (5, 4), (0, 8)]), _stars(rng, 3 + 5 * seed, 2.0)
    whole = regions.covered_area(outer, shapes)
    x, y = np.meshgrid((np.arange(1500) + 0.5) / 150, (np.arange(1500) + 0.5) / 150)
    any_of = np.logical_or.reduce([_inside(s, x, y) for s in shapes]) & _inside(outer, x, y)
    assert whole == pytest.approx(any_of.sum() / 150**2, abs=0.05)
    assert whole == pytest.approx(sum(regions.covered_area(outer, shapes, a, b) for a, b in ((-9, 2.2), (2.2, 5), (5, 99))))
    boxes = [(a, b, a + w, b + h) for a, b, w, h in rng.integers(0, 12, (25, 4)) + [0, 0, 1, 1]]
    squares = np.zeros((40, 40), bool)
    for a, b, c, d in boxes:
        squares[a:c, b:d] = True
    assert regions.covered_area(rings(corners(2, 1, 11, 12)), [rings(corners(*b)) for b in boxes]) == pytest.approx(squares[2:11, 1:12].sum())
    diamonds = [rings([(a, b - 1), (a + 1, b), (a, b + 1), (a - 1, b)]) for a, b in rng.integers(1, 9, (30, 2))] * 2
    cover = np.logical_or.reduce([_inside(s, x, y) for s in diamonds])
    assert regions.covered_area(rings(corners(0, 0, 10, 10)), diamonds) == pytest.approx(cover.sum() / 150**2, abs=0.02)


def test_covered_area_of_ten_thousand_objects_takes_seconds():
    rng = np.random.default_rng(3)
    shapes = [rings(corners(a, b, a + w, b + h)) for a, b, w, h in rng.uniform(0, 1, (10_000, 4)) * [95, 95, 3, 3]]
    began = time.time()
    assert 0 < regions.covered_area(rings(corners(0, 0, 100, 100)), shapes) < 10_000
    assert time.time() - began < 5


def _regions(spark, boxes):
    return spark.createDataFrame([(i, [[tuple(map(float, p)) for p in [*corners(*b), b[:2]]]]) for i, b in enumerate(boxes)], f"location_id long, polygon {G.POLYGON}")


def _objects(spark, boxes, classes):
    return spark.createDataFrame([(c, [[tuple(map(float, p)) for p in [*corners(*b), b[:2]]]]) for b, c in zip(boxes, classes, strict=True)], f"kind string, shape {G.POLYGON}")


def test_region_aggregations(spark):
    r = _regions(spark, [(0, 0, 10, 10), (500, 500, 510, 510)])
    o = _objects(spark, [(1, 1, 5, 5), (3, 3, 7, 7), (10, 0, 12, 5), (300, 300, 301, 301)], ["b", "a", None, "z"])
    rows = {x.location_id: x for x in regions.intersecting(r, o, "kind").collect()}
    assert (rows[0]["count"], rows[0].total_area, rows[0].majority_class_kind) == (3, 42, "a")
    assert (rows[1]["count"], rows[1].total_area, rows[1].majority_class_kind) == (0, 0, None)
    for strips in (1, 2000):
        f = {x.location_id: x.area_fraction for x in regions.area_fraction(r, o, strip_objects=strips).collect()}
        assert f == pytest.approx({0: 0.28, 1: 0})
    with pytest.raises(ValueError):
        regions.intersecting(r, o, "absent")
    points = spark.createDataFrame([((0.0, 5.0),), ((5.0, 5.0),), ((505.0, 505.0),)], f"shape {G.POINT}")
    d = {x.location_id: x.numerical_density for x in regions.numerical_density(r, points).collect()}
    assert d == pytest.approx({0: 0.01, 1: 0.01})
    none = regions.numerical_density(r, points.where("false")).collect()
    assert [x.numerical_density for x in none] == [0, 0]


def test_region_features_and_attach(spark):
    from shorewise.config import FeatureGeneration

    r = _regions(spark, [(0, 0, 10, 10), (500, 500, 510, 510)])
    o = _objects(spark, [(1, 1, 5, 5)], ["b"])
    f = regions.region_features(r, "a:b", o, FeatureGeneration(majority_class={"columns": ["kind"]}, area_fraction=True, count=False))
    assert f.columns == ["location_id", "a:b_majority_class_kind", "a:b_area_fraction"]
    base = spark.createDataFrame([(0, 1), (0, 2), (7, 1)], "location_id long, ahn_version int")
    once = regions.attach(base, f)
    assert regions.attach(once, f).columns == once.columns and once.count() == 3
    lines = spark.createDataFrame([(1, [(0.0, 20.0), (10.0, 20.0)]), (0, [(0.0, -9.0), (10.0, -9.0)])], f"line_ord int, line {G.LINE}")
    assert {x.location_id: x.line_ord for x in regions.nearest_region_line(r, lines).collect()} == {0: 0, 1: 1}


def test_nearest_line_ties_and_emptiness(spark):
    lines = spark.createDataFrame([(3, [(0.0, 1.0), (9.0, 1.0)]), (1, [(0.0, -1.0), (9.0, -1.0)])], f"line_ord int, line {G.LINE}")
    points = spark.createDataFrame([(4.0, 0.0), (4.0, 0.5), (None, 1.0)], "x double, y double")
    got = [(p.nearest_line, p.nearest_distance) for p in observations.nearest_line(points, lines).collect()]
    assert got == [(1, 1.0), (3, 0.5), (None, None)]
    with pytest.raises(ValueError):
        observations.nearest_line(points, lines.where("false"))


def test_polygon_within_and_hull(spark):
    hole = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]]
    horns = [[(0, 0), (10, 0), (10, 10), (5, 1), (0, 10), (0, 0)]]
    box = lambda a, b, c, d: [[(a, b), (c, b), (c, d), (a, d), (a, b)]]
    cases = [(box(1, 1, 3, 3), hole, True), (box(0, 0, 3, 3), hole, True), (box(3, 3, 7, 7), hole, False), (box(9, 9, 11, 11), hole, False), (box(1, 0, 9, 3), horns, False), (box(0, 0, 10, 1), horns, True), (hole, hole, True)]
    rows = [([[(float(x), float(y)) for x, y in r] for r in a], [[(float(x), float(y)) for x, y in r] for r in b], w) for a, b, w in cases]
    df = spark.createDataFrame(rows, f"a {G.POLYGON}, b {G.POLYGON}, want boolean")
    df = df.withColumn("buffered", buffered(F.col("a"), F.lit(1.0)))
    got = df.select(G.polygon_within(F.col("a"), F.col("b")).alias("got"), "want", G.area(F.array(G.convex_hull(F.flatten("b")))).alias("hull"), G.polygon_within(F.col("a"), F.col("buffered")).alias("held"), G.area(F.col("buffered")).alias("wide")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert {r.hull for r in got} == {100.0}
    assert all(r.held for r in got) and got[0].wide == pytest.approx(4 + 8 + 3.14, abs=0.01)
