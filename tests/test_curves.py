import numpy as np
import pytest
from pyspark.sql import functions as F

from shorewise.functions import curves as C
from shorewise.functions import geometry as G


def ring(*p):
    return np.array([*p, p[0]], float)


def box(a, b, c, d):
    return ring((a, b), (c, b), (c, d), (a, d))


def area(polygon):
    return abs(C._area(polygon[0])) - sum(abs(C._area(r)) for r in polygon[1:])


def distance(p, a, b):
    """Of points from the nearest of some segments."""
    d = b - a
    t = np.clip(((p[:, None] - a) * d).sum(2) / np.maximum((d**2).sum(1), 1e-300), 0, 1)
    return np.sqrt(((a + t[..., None] * d - p[:, None]) ** 2).sum(2)).min(axis=1)


def inside(rings, p):
    odd = np.zeros(len(p), bool)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r[:-1], r[1:], strict=True):
            if ay != by:
                odd ^= ((ay > p[:, 1]) != (by > p[:, 1])) & (p[:, 0] < ax + (p[:, 1] - ay) * (bx - ax) / (by - ay))
    return odd


def check(rings, kind, radius):
    """The buffer holds the points nearer than the radius, but for the slivers between arcs and chords; its bounds are the radius wider."""
    made = C.buffer_rings(C._walks(rings, kind), radius)
    assert len(made) == 1
    every = np.concatenate(rings)
    low, high = every.min(axis=0) - radius, every.max(axis=0) + radius
    assert np.allclose(made[0][0].min(axis=0), low, rtol=0, atol=1e-9 * radius) and np.allclose(made[0][0].max(axis=0), high, rtol=0, atol=1e-9 * radius)
    p = np.random.default_rng(1).uniform(low, high, (4000, 2))
    a, b = np.concatenate([r[:-1] if len(r) > 1 else r for r in rings]), np.concatenate([r[1:] if len(r) > 1 else r for r in rings])
    far = distance(p, a, b)
    far = np.where(inside(rings, p), 0, far) if kind == "polygon" else far
    clear = (far < radius * np.cos(C._STEP / 2)) | (far > radius)
    assert (inside(made[0], p) == (far <= radius))[clear].all()
    return made[0]


ARC = C.QUARTER / 2 * np.sin(np.pi / 2 / C.QUARTER)  # a quarter circle of radius 1, made of chords


def test_areas_by_formula():
    shape = ring((0, 0), (10, 0), (10, 4), (4, 4), (4, 9), (0, 9))
    assert area(check([shape], "polygon", 1.5)) == pytest.approx(60 + 38 * 1.5 + (5 * ARC - 1) * 1.5**2)
    assert area(check([shape[::-1]], "polygon", 1.5)) == pytest.approx(60 + 38 * 1.5 + 5 * np.pi / 4 * 1.5**2 - 1.5**2, rel=1e-3)
    frame = [box(0, 0, 20, 20), box(5, 5, 15, 12)]
    got = check(frame, "polygon", 2.0)
    assert len(got) == 2 and area(got) == pytest.approx(400 + 160 + 4 * ARC * 4 - 6 * 3)
    assert len(check(frame, "polygon", 4.0)) == 1  # the hole is gone
    assert area(check([np.array([(0, 0), (7, 0), (7, 5)], float)], "line", 1.0)) == pytest.approx(24 + 5 * ARC - 1)
    assert area(check([np.array([(3.0, 4.0)])], "point", 2.0)) == pytest.approx(4 * ARC * 4)


@pytest.mark.parametrize("seed", range(8))
def test_any_shape(seed):
    """Stars with deep bays, zigzags that cross themselves, a spiral, a walk back along itself, far from the origin."""
    rng = np.random.default_rng(seed)
    k = int(rng.integers(5, 30))
    angle, far = (np.arange(k) + rng.uniform(0, 0.9, k)) * 2 * np.pi / k, rng.uniform(1, 10, k)
    star = np.stack([130_000 + far * np.cos(angle), 425_000 + far * np.sin(angle)], axis=1)
    for radius in (0.05, 0.7, 6.0):
        check([ring(*star)], "polygon", radius)
        check([rng.uniform(0, 10, (int(rng.integers(2, 12)), 2))], "line", radius)
        check([rng.integers(0, 5, (8, 2)).astype(float)], "line", radius)
    turns = np.linspace(0, 6 * np.pi, 60)
    check([np.stack([turns * np.cos(turns), turns * np.sin(turns)], axis=1)], "line", 1.0 + seed / 2)
    check([np.array([(0, 0), (5, 0), (2, 0), (2, 3), (2, 0)], float)], "line", 1.0)


def test_many_corners():
    """A wavy ring of 20,000 corners: the buffer of a ring and its hole by Steiner's formula, and no point of an offset too near."""
    w = np.linspace(0, 2 * np.pi, 20_001)
    far = 1000 + 50 * np.sin(12 * w)
    wave = np.stack([far * np.cos(w), far * np.sin(w)], axis=1)
    wave[-1] = wave[0]
    around = np.hypot(*(wave[1:] - wave[:-1]).T).sum()
    (outer,) = C.buffer_rings([wave], 0.5)
    assert area(outer) == pytest.approx(C._area(wave) + around * 0.5 + np.pi * 0.25, rel=1e-7)
    frame = C.buffer_rings([box(-2000, -2000, 2000, 2000), wave[::-1]], 0.5)
    assert len(frame) == 1 and len(frame[0]) == 2
    assert area(frame[0]) == pytest.approx(4001**2 - (1 - np.pi / 4) - C._area(wave) + around * 0.5 - np.pi * 0.25, rel=1e-7)
    (inner,) = C.offset_pieces(wave[:-1], 0.5)
    some = inner[:: len(inner) // 50]
    assert np.abs(distance(some, wave[:-1], wave[1:]) - 0.5)[1:-1].max() < 1e-3


@pytest.mark.parametrize("seed", range(4))
def test_boxes_that_meet(seed):
    """Every pair once, among boxes of lengths of many sizes, repeated ones and points."""
    rng = np.random.default_rng(seed)
    low = rng.integers(0, 50, (120, 2)).astype(float)
    high = low + np.floor(rng.pareto(0.7, (120, 2)).clip(0, 80)) * (seed > 0)
    got = [p for i, j in C._meeting(low, high, 0.5) for p in zip(np.maximum(i, j).tolist(), np.minimum(i, j).tolist(), strict=True)]
    meet = ((low[:, None] <= high + 0.5) & (low <= high[:, None] + 0.5)).all(axis=2)
    assert sorted(got) == [(i, j) for i in range(120) for j in range(i) if meet[i, j]]


def test_offset_pieces():
    bend = np.array([(0, 0), (10, 0), (10, 10)], float)
    (left,), (right,), (rounded,) = C.offset_pieces(bend, 2), C.offset_pieces(bend, -2), C.offset_pieces(bend, -2, "round")
    assert left.tolist() == [[0, 2], [8, 2], [8, 10]] and right.tolist() == [[0, -2], [12, -2], [12, 10]]
    assert rounded[0].tolist() == [0, -2] and rounded[-1].tolist() == [12, 10] and len(rounded) == 4 + C.QUARTER - 1
    assert np.allclose(np.hypot(*(rounded[1:-1] - [10, 0]).T), 2)
    bay = np.array([(0, 10), (0, 0), (3, 0), (3, 10)], float)
    assert [p.tolist() for p in C.offset_pieces(bay, 1)] == [[[1, 10], [1, 1], [2, 1], [2, 10]]]
    assert C.offset_pieces(bay, 2) == []  # the bay is too narrow
    notch = np.array([(0, 0), (10, 0), (10, -5), (11, -5), (11, 0), (20, 0)], float)
    (over,) = C.offset_pieces(notch, 2)
    assert over[0].tolist() == pytest.approx([0, 2]) and over[-1].tolist() == pytest.approx([20, 2]) and over[:, 1].min() > 1.9
    assert C.offset_pieces(np.array([(1.0, 1.0), (1.0, 1.0)]), 2) == [] and C.offset_pieces(bend, 0)[0].tolist() == bend.tolist()


@pytest.mark.parametrize("seed", range(5))
def test_offset_keeps_its_distance(seed):
    rng = np.random.default_rng(seed)
    line = np.cumsum(rng.uniform(-2, 5, (12, 2)), axis=0)
    for by in (-1.5, 0.4, 3.0):
        for join in ("mitre", "round"):
            for piece in C.offset_pieces(line, by, join):
                near = distance(np.concatenate([piece, (piece[:-1] + piece[1:]) / 2]), line[:-1], line[1:])
                assert near.min() > abs(by) * np.cos(C._STEP / 2) - 1e-6 and (join == "mitre" or near.max() < abs(by) + 1e-6)


def test_columns(spark):
    rows = [(1, [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]], [(0.0, 0.0), (6.0, 0.0)], (1.0, 1.0), 2.0), (2, None, None, None, 2.0), (3, [], [], (1.0, float("nan")), 1.0), (4, [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]], [(0.0, 0.0), (1.0, 0.0)], (0.0, 0.0), None)]
    df = spark.createDataFrame(rows, f"id int, polygon {G.POLYGON}, line {G.LINE}, point {G.POINT}, r double")
    made = df.select("id", *[G.area(C.buffered(F.col(k), F.col("r"), k)).alias(k) for k in ("polygon", "line", "point")], C.offset_curve(F.col("line"), F.col("r")).alias("o")).orderBy("id").collect()
    assert (made[0].polygon, made[0].line, made[0].point) == pytest.approx((6 + 24 + 4 * np.pi, 24 + 4 * np.pi, 4 * np.pi), rel=2e-3)
    assert [[tuple(p) for p in line] for line in made[0].o] == [[(0.0, 2.0), (6.0, 2.0)]]
    assert all(r.polygon is None and r.line is None and r.point is None for r in made[1:]) and all(not r.o for r in made[1:])
    with pytest.raises(Exception, match="negative"):
        df.select(C.buffered(F.col("polygon"), F.lit(-1.0))).collect()


def test_shapes_are_worked_out_together(monkeypatch):
    rng = np.random.default_rng(7)
    calls, cut = [], C._cut
    monkeypatch.setattr(C, "_cut", lambda *args: calls.append(1) or cut(*args))
    lines = [rng.uniform(-1e4, 1e4, 2) + np.cumsum(rng.uniform(-10, 20, (int(rng.integers(2, 9)), 2)), axis=0) for _ in range(60)]
    walks, radius = [C._walks([line], "line") for line in lines], rng.uniform(0.5, 9, 60)
    made, moved = C.buffers([*walks, []], np.append(radius, 1.0)), C.offsets(lines, radius)
    assert len(calls) == 2 and made[-1] == [] and len(moved) == 60
    for walk, line, r, polygons, pieces in zip(walks, lines, radius, made, moved, strict=False):
        alone = C.buffer_rings(walk, r)
        assert [[len(ring) for ring in p] for p in alone] == [[len(ring) for ring in p] for p in polygons]
        assert all(np.allclose(a, b, rtol=0, atol=1e-9) for p, q in zip(alone, polygons, strict=True) for a, b in zip(p, q, strict=True))
        assert all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(C.offset_pieces(line, r), pieces, strict=True))
        (low, high), ring = (line.min(axis=0) - r, line.max(axis=0) + r), polygons[0][0]
        assert np.allclose([ring.min(axis=0), ring.max(axis=0)], [low, high], rtol=0, atol=1e-9)


def test_offset_loses_points_that_go_straight_on():
    lines = [np.array([(x, -10.0), (x + 5, 400), (x - 5, 700), (x, 1010)]) for x in np.arange(250.0, 650, 4)]
    by = np.array([(5 + k % 11) * (1 if k % 2 else -1) for k in range(len(lines))], float)
    assert {tuple(map(len, pieces)) for pieces in C.offsets(lines, by)} == {(4,)}
