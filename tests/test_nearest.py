"""Nearest lines by the packed index and over nested grids give what comparing all pairs gives."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from shorewise.functions import geometry as G
from shorewise.operators import observations, regions
from shorewise.operators.nearest import BOX, near_segments, segments_of
from shorewise.operators.packed import PackedSegments, polygon_segment_distance

LINES = f"line_ord int, line {G.LINE}"


def _lines(n, rng, span=1000.0):
    out = []
    for o in range(n):
        x, y = rng.uniform(-span, span), rng.uniform(-span, span)
        step = rng.choice([1, 20, 400])
        out.append((n - o, [(x + rng.uniform(-step, step) * k, y + rng.uniform(-step, step) * k) for k in range(rng.randint(1, 5))]))
    return out


def test_points_as_by_all_pairs(spark):
    rng = random.Random(11)
    lines = spark.createDataFrame([*_lines(60, rng), (0, [(0.0, 5.0), (9.0, 5.0)]), (-1, [(0.0, -5.0), (9.0, -5.0)])], LINES)
    places = [(rng.uniform(-1500, 1500), rng.uniform(-1500, 1500)) for _ in range(150)]
    places += [(4.0, 0.0), (4.0, 0.0), (9e5, -9e5), (-0.0, 0.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, x double, y double")
    want = {r.id: r for r in observations.nearest_line(points.where("x < 'Infinity'"), lines).collect()}
    got = observations.nearest_line(points, lines, max_segments=1).collect()
    assert len(got) == len(places)
    for r in got:
        if r.id in want and want[r.id].nearest_distance is not None:
            assert tuple(r)[3:] == pytest.approx(tuple(want[r.id])[3:], abs=1e-6)
        else:
            assert tuple(r)[3:] == (None,) * 4
    one = lines.where("line_ord = 0")
    assert observations.nearest_line(points.where("id = 150"), one, max_segments=0).first().nearest_distance == 5
    assert observations.nearest_line(points.where("false"), lines, max_segments=1).count() == 0


def test_regions_as_by_all_pairs(spark):
    rng = random.Random(5)
    lines = spark.createDataFrame(_lines(40, rng), LINES)
    rows = []
    for i in range(60):
        x, y, a = rng.uniform(-1200, 1200), rng.uniform(-1200, 1200), rng.choice([2, 50, 500])
        rows.append((i, [[(x, y), (x + a, y), (x + a, y + a), (x, y)]]))
    rows += [(60, rows[0][1]), (61, None)]
    areas = spark.createDataFrame(rows, f"location_id int, polygon {G.POLYGON}")
    want = {r.location_id: r for r in regions.nearest_region_line(areas, lines).collect()}
    got = {r.location_id: r for r in regions.nearest_region_line(areas, lines, max_segments=1).collect()}
    assert set(got) == set(want) == set(range(62))
    assert {k: r.line_ord for k, r in got.items()} == {k: r.line_ord for k, r in want.items()}
    assert [got[k].line_distance for k in range(61)] == pytest.approx([want[k].line_distance for k in range(61)], abs=1e-9)
    assert got[61].line_ord is None and want[61].line_ord is None
    own = areas.join(lines.withColumnRenamed("line_ord", "o")).where("polygon IS NOT NULL").select("location_id", "o", G.polygon_line_distance(F.col("polygon"), F.col("line")).alias("d"))
    least = {r.location_id: r.s for r in own.where("d IS NOT NULL").groupBy("location_id").agg(F.min(F.struct("d", "o")).alias("s")).collect()}
    assert {k: s.d for k, s in least.items()} == pytest.approx({k: want[k].line_distance for k in least}, abs=1e-9)


def test_few_candidates(spark):
    """Among a lattice of 10,000 short segments, near and far boxes meet a few each."""
    lines = spark.createDataFrame([(i, [(i % 100 * 10.0, i // 100 * 10.0), (i % 100 * 10.0 + 5, i // 100 * 10.0)]) for i in range(10_000)], LINES)
    places = [(13.0 * i % 990, 7.0 * i % 990) for i in range(50)] + [(1e5, 1e5), (-1e4, 500.0)]
    boxes = spark.createDataFrame([(x, y, x, y) for x, y in places], ", ".join(f"{c} double" for c in BOX))
    assert near_segments(boxes, segments_of(lines)).count() < 40 * len(places)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 300, 5000])
def test_packed_index_against_all_pairs(n):
    """Short and long segments, points and repeated segments, whose first one holds."""
    rng = np.random.default_rng(n)
    a = rng.uniform(-100, 100, (n, 2)).round(1)
    b = a + rng.normal(size=(n, 2)).round(1) * rng.choice([0, 1, 50], (n, 1))
    a[n // 2 :], b[n // 2 :] = a[: n - n // 2], b[: n - n // 2]
    index = PackedSegments(np.arange(n) // 2, a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    p = np.concatenate([rng.uniform(-150, 150, (200, 2)), a[:50], [[1e7, -1e7]]])
    o, d2, where = index.nearest(p[:, 0], p[:, 1])
    d = b - a
    t = np.clip(((p[:, None] - a) * d).sum(2) / np.where((d**2).sum(1) > 0, (d**2).sum(1), 1.0), 0, 1)
    foot = a + t[..., None] * d
    every = ((foot - p[:, None]) ** 2).sum(2)
    assert np.array_equal(d2, every.min(axis=1)) and np.array_equal(o, every.argmin(axis=1) // 2)
    assert np.allclose(where, foot[np.arange(len(p)), every.argmin(axis=1)])


def test_packed_index_looks_at_few_segments():
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 1000, (100_000, 2))
    index = PackedSegments(np.arange(len(a)), *a.T, *(a + rng.normal(size=a.shape)).T)
    p = rng.uniform(0, 1000, (1000, 2))
    point, _ = index.within(p, p, index._bounds(p))
    assert len(point) < 10 * len(p)


def test_polygon_with_a_hole_and_segments():
    square = lambda a, b: np.array([(a, a), (b, a), (b, b), (a, b), (a, a)], float)
    rings = [square(0, 10), square(4, 6)]
    a = np.array([(5, 5), (1, 1), (12, 0), (-3, 5), (5, 5), (13, 14)], float)
    b = np.array([(5.5, 5), (2, 2), (12, 9), (20, 5), (9, 5), (13, 20)], float)
    assert polygon_segment_distance(rings, a, b).tolist() == pytest.approx([4.5, 0, 2, 0, 0, 5])
