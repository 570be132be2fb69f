"""Planar geometry as Column expressions.

A point is struct<x, y>, a line array<point>, a polygon array<ring> with its
exterior first, a geometry array<polygon> for several parts. Everything runs
inside the JVM; nulls give null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def line(points: list[tuple[float, float]]) -> Column:
    """A literal line."""
    return F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The polygon of a bounding box."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.array(F.array(*[point(x, y) for x, y in corners]))


def _square(c: Column) -> Column:
    return c * c


def _clamp(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))


def segments(of: Column) -> Column:
    """array<struct<ax, ay, bx, by>> of a line or ring."""
    pairs = F.arrays_zip(F.slice(of, 1, F.size(of) - 1).alias("a"), F.slice(of, 2, F.size(of) - 1).alias("b"))
    return F.transform(pairs, lambda p: F.struct(p["a"]["x"].alias("ax"), p["a"]["y"].alias("ay"), p["b"]["x"].alias("bx"), p["b"]["y"].alias("by")))


def edges(polygon: Column) -> Column:
    """All rings' segments."""
    return F.flatten(F.transform(polygon, segments))


def _length(s: Column) -> Column:
    return F.sqrt(_square(s["bx"] - s["ax"]) + _square(s["by"] - s["ay"]))


def length(of: Column) -> Column:
    return F.aggregate(segments(of), F.lit(0.0), lambda n, s: n + _length(s))


def _foot(s: Column, x: Column, y: Column) -> Column:
    """Where along the segment, 0 to 1, its nearest place to the point is."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    t = F.try_divide((x - s["ax"]) * dx + (y - s["ay"]) * dy, dx * dx + dy * dy)
    return _clamp(F.coalesce(t, F.lit(0.0)), F.lit(0.0), F.lit(1.0))


def _distance2(s: Column, x: Column, y: Column) -> Column:
    return let(_foot(s, x, y), lambda t: _square(s["ax"] + t * (s["bx"] - s["ax"]) - x) + _square(s["ay"] + t * (s["by"] - s["ay"]) - y))


def distance(of: Column, x: Column, y: Column) -> Column:
    """Distance of a point from a line."""
    return F.sqrt(F.array_min(F.transform(segments(of), lambda s: _distance2(s, x, y))))


def project(of: Column, x: Column, y: Column) -> Column:
    """Distance along the line of its place nearest to the point; the first of equally near ones."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0.0).alias("at"), F.lit(0.0).alias("run"))

    def step(a: Column, s: Column) -> Column:
        def of(d: Column) -> Column:
            n, nearer = _length(s), d < a["best"]
            return F.struct(F.least(d, a["best"]).alias("best"), F.when(nearer, a["run"] + _foot(s, x, y) * n).otherwise(a["at"]).alias("at"), (a["run"] + n).alias("run"))

        return let(_distance2(s, x, y), of)

    return F.aggregate(segments(of), start, step, lambda a: a["at"])


def interpolate(of: Column, at: Column, normalized: bool = False) -> Column:
    """The point at a distance along the line; a negative one counts from its end; too long a one clamps."""
    inner = lambda whole: let(at * whole if normalized else at, lambda s: let(_clamp(F.when(s < 0, s + whole).otherwise(s), F.lit(0.0), whole), lambda c: _placed(of, c)))
    return let(length(of), inner)


def _placed(of: Column, at: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("run"), F.element_at(of, 1).alias("p"))

    def step(a: Column, s: Column) -> Column:
        n = _length(s)
        t = F.least(F.lit(1.0), F.coalesce(F.try_divide(at - a["run"], n), F.lit(0.0)))
        here = point(s["ax"] + t * (s["bx"] - s["ax"]), s["ay"] + t * (s["by"] - s["ay"]))
        return F.struct((a["run"] + n).alias("run"), F.when((at >= a["run"]) & (n > 0), here).otherwise(a["p"]).alias("p"))

    return F.aggregate(segments(of), start, step, lambda a: a["p"])


def nearest_point(of: Column, x: Column, y: Column) -> Column:
    """The place on the line nearest to the point; the first of equally near ones."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.element_at(of, 1).alias("p"))

    def step(a: Column, s: Column) -> Column:
        here = lambda t, d: F.struct(d.alias("best"), point(s["ax"] + t * (s["bx"] - s["ax"]), s["ay"] + t * (s["by"] - s["ay"])).alias("p"))
        return let(_distance2(s, x, y), lambda d: F.when(d < a["best"], let(_foot(s, x, y), lambda t: here(t, d))).otherwise(a))

    return F.aggregate(segments(of), start, step, lambda a: a["p"])


def between(x: Column, y: Column, p: Column, q: Column) -> Column:
    """Whether the point lies between p and q, the places nearest to it on two lines: the angle p-point-q is obtuse."""
    return (p["x"] - x) * (q["x"] - x) + (p["y"] - y) * (q["y"] - y) < 0


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; null for a zero vector."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda n, x: n + x)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _moments(ring: Column) -> Column:
    """Signed area and first moments, about the ring's first point for precision."""
    o = F.element_at(ring, 1)
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("a", "mx", "my")])

    def step(m: Column, s: Column) -> Column:
        ax, ay, bx, by = s["ax"] - o["x"], s["ay"] - o["y"], s["bx"] - o["x"], s["by"] - o["y"]
        cross = ax * by - bx * ay
        return F.struct((m["a"] + cross / 2).alias("a"), (m["mx"] + (ax + bx) * cross / 6).alias("mx"), (m["my"] + (ay + by) * cross / 6).alias("my"))

    return F.aggregate(segments(ring), zero, step, lambda m: F.struct(F.abs(m["a"]).alias("a"), (F.signum(m["a"]) * m["mx"] + F.abs(m["a"]) * o["x"]).alias("mx"), (F.signum(m["a"]) * m["my"] + F.abs(m["a"]) * o["y"]).alias("my")))


def _directed(ring: Column, outer: Column) -> Column:
    """A ring's segments (ax, ay, bx, by) with the inside on their left: an exterior one counterclockwise, a hole clockwise."""
    ends = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.array(p["x"], p["y"], q["x"], q["y"]))
    twice = lambda every: F.aggregate(every, F.lit(0.0), lambda n, s: n + (s[0] * s[3] - s[2] * s[1]))
    turned = lambda every: F.transform(every, lambda s: F.array(s[2], s[3], s[0], s[1]))
    return let(ends, lambda every: F.when((twice(every) > 0) == outer, every).otherwise(turned(every)))


def directed_edges(polygon: Column) -> Column:
    """Coordinates of all edges in a row: ax, ay, bx, by of each, with the inside on its left."""
    return F.flatten(F.flatten(F.transform(polygon, lambda r, i: _directed(r, i == 0))))


def _with_holes(rings: Column, name: str) -> Column:
    """The first ring's moment, less those of the others, of rings' moments."""
    ring = F.transform(rings, lambda m: m[name])
    return F.element_at(ring, 1) - F.aggregate(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.lit(0.0), lambda n, v: n + v)


def area(polygon: Column) -> Column:
    """Area of a polygon, less its holes."""
    return let(F.transform(polygon, _moments), lambda rings: _with_holes(rings, "a"))


def parts_area(parts: Column) -> Column:
    """Area of a geometry of several polygons that don't overlap."""
    return F.aggregate(parts, F.lit(0.0), lambda n, p: n + area(p))


def centroid(polygon: Column) -> Column:
    """Area-weighted centroid; null for an empty area."""
    of = lambda rings: let(_with_holes(rings, "a"), lambda whole: point(F.try_divide(_with_holes(rings, "mx"), whole), F.try_divide(_with_holes(rings, "my"), whole)))
    return let(F.transform(polygon, _moments), of)


def bounds(polygon: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax>."""
    ends = lambda v: F.struct(F.array_min(v["x"]).alias("xmin"), F.array_min(v["y"]).alias("ymin"), F.array_max(v["x"]).alias("xmax"), F.array_max(v["y"]).alias("ymax"))
    return let(let(F.flatten(polygon), lambda every: F.struct(every["x"].alias("x"), every["y"].alias("y"))), ends)


def on_boundary(polygon: Column, x: Column, y: Column) -> Column:
    def on(s: Column) -> Column:
        level = (s["bx"] - s["ax"]) * (y - s["ay"]) == (s["by"] - s["ay"]) * (x - s["ax"])
        return level & x.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & y.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))

    return F.exists(edges(polygon), on)


def _crossed_oddly(polygon: Column, x: Column, y: Column) -> Column:
    crossed = F.filter(edges(polygon), lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < s["ax"] + (y - s["ay"]) * F.try_divide(s["bx"] - s["ax"], s["by"] - s["ay"])))
    return F.size(crossed) % 2 == 1


def within(polygon: Column, x: Column, y: Column) -> Column:
    """Whether the point is strictly inside."""
    return _crossed_oddly(polygon, x, y) & ~on_boundary(polygon, x, y)


def covers(polygon: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside or on the boundary."""
    return _crossed_oddly(polygon, x, y) | on_boundary(polygon, x, y)


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(s: Column, t: Column) -> Column:
    """Whether two segments have a point in common, ends included."""
    boxes = [F.least(s[f"a{k}"], s[f"b{k}"]) <= F.greatest(t[f"a{k}"], t[f"b{k}"]) for k in "xy"] + [F.least(t[f"a{k}"], t[f"b{k}"]) <= F.greatest(s[f"a{k}"], s[f"b{k}"]) for k in "xy"]
    side = lambda u, v: _turn(u["ax"], u["ay"], u["bx"], u["by"], v["ax"], v["ay"]) * _turn(u["ax"], u["ay"], u["bx"], u["by"], v["bx"], v["by"]) <= 0
    return reduce(lambda a, b: a & b, boxes) & side(s, t) & side(t, s)


def intersects(a: Column, b: Column) -> Column:
    """Whether two polygons have a point in common, boundaries included."""
    corner = lambda p: F.element_at(F.element_at(p, 1), 1)
    meet = F.exists(edges(a), lambda s: F.exists(edges(b), lambda t: segments_meet(s, t)))
    return meet | covers(a, corner(b)["x"], corner(b)["y"]) | covers(b, corner(a)["x"], corner(a)["y"])


def parts_intersect(a: Column, parts: Column) -> Column:
    """Whether a polygon has a point in common with any of several polygons."""
    return F.exists(parts, lambda p: intersects(a, p))


def polygon_within(inner: Column, outer: Column) -> Column:
    """Whether a polygon lies in another, boundaries included: no corner is outside, no edges cross, and no hole is inside."""
    crossing = lambda s, t: _turn_of(s, t, "a") * _turn_of(s, t, "b") * _turn_of(t, s, "a") * _turn_of(t, s, "b") != 0
    crossed = F.exists(edges(inner), lambda s: F.exists(edges(outer), lambda t: segments_meet(s, t) & crossing(s, t)))
    covered = F.forall(F.flatten(inner), lambda p: covers(outer, p["x"], p["y"]))
    middles = F.forall(edges(inner), lambda s: covers(outer, (s["ax"] + s["bx"]) / 2, (s["ay"] + s["by"]) / 2))
    holes = F.exists(F.slice(outer, 2, 1_000_000), lambda r: within(inner, r[0]["x"], r[0]["y"]))
    return covered & middles & ~crossed & ~holes


def _turn_of(s: Column, t: Column, end: str) -> Column:
    return _turn(s["ax"], s["ay"], s["bx"], s["by"], t[f"{end}x"], t[f"{end}y"])


def convex_hull(points: Column) -> Column:
    """The closed ring around points, counterclockwise from the leftmost: two monotone chains."""

    def chain(of: Column) -> Column:
        def add(kept: Column, p: Column) -> Column:
            turn = lambda a, b: _turn(a["x"], a["y"], b["x"], b["y"], p["x"], p["y"])
            # drop from the end what lies right of the way to p: the place of the last left turn is kept
            ends = F.sequence(F.lit(2), F.size(kept))
            stays = F.array_max(F.filter(ends, lambda i: turn(F.element_at(kept, i - 1), F.element_at(kept, i)) > 0))
            cut = F.when(F.size(kept) < 2, F.size(kept)).otherwise(F.coalesce(stays, F.lit(1)))
            return F.concat(F.slice(kept, 1, cut), F.array(p))

        return F.aggregate(of, F.array().cast(LINE), add)

    def both(ordered: Column) -> Column:
        lower, upper = chain(ordered), chain(F.reverse(ordered))
        return F.concat(lower, F.slice(upper, 2, F.size(upper) - 1))

    return let(F.array_sort(F.array_distinct(points)), both)


def line_intersects(polygon: Column, of: Column) -> Column:
    """Whether a line has a point in common with a polygon."""
    first = F.element_at(of, 1)
    return covers(polygon, first["x"], first["y"]) | F.exists(edges(polygon), lambda s: F.exists(segments(of), lambda t: segments_meet(s, t)))


#: A geometry of any type: what it has of points, lines and polygons.
ANY = f"struct<points:array<{POINT}>,lines:array<{LINE}>,parts:array<{POLYGON}>>"


def any_shape(points: Column | None = None, lines: Column | None = None, parts: Column | None = None) -> Column:
    """A geometry of any type from arrays of its points, lines and polygons."""
    given = {"points": (points, f"array<{POINT}>"), "lines": (lines, f"array<{LINE}>"), "parts": (parts, f"array<{POLYGON}>")}
    return F.struct(*[(F.lit(None) if c is None else c).cast(kind).alias(n) for n, (c, kind) in given.items()])


def any_corners(shape: Column) -> Column:
    """All points of a geometry of any type, as one ring."""
    none = F.array().cast(LINE)
    return F.concat(F.coalesce(shape["points"], none), F.coalesce(F.flatten(shape["lines"]), none), F.coalesce(F.flatten(F.flatten(shape["parts"])), none))


def any_intersects(polygon: Column, shape: Column) -> Column:
    """Whether a geometry of any type has a point in common with a polygon."""
    tests = [F.exists(shape["points"], lambda p: covers(polygon, p["x"], p["y"])), F.exists(shape["lines"], lambda line: line_intersects(polygon, line)), parts_intersect(polygon, shape["parts"])]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def any_area(shape: Column) -> Column:
    """Area of a geometry of any type; 0 for points and lines."""
    return F.coalesce(parts_area(shape["parts"]), F.lit(0.0))


def line_distance(of: Column, other: Column) -> Column:
    """Distance of two lines; 0 if they cross."""
    ends = lambda a, b: F.array_min(F.transform(b, lambda p: distance(a, p["x"], p["y"])))
    meet = F.exists(segments(of), lambda s: F.exists(segments(other), lambda t: segments_meet(s, t)))
    return F.when(meet, F.lit(0.0)).otherwise(F.least(ends(of, other), ends(other, of)))


def polygon_line_distance(polygon: Column, of: Column) -> Column:
    """Distance of a polygon from a line; 0 if they have a point in common."""
    exterior = F.element_at(polygon, 1)
    return F.when(line_intersects(polygon, of), F.lit(0.0)).otherwise(line_distance(exterior, of))


def line_shape(polygon: Column, of: Column, radius: float) -> Column:
    """How a line bends near a polygon: mean of the cosines between the direction to the centroid and the directions to the places radius behind and ahead. 0 for a straight line."""
    r = F.lit(float(radius))

    def shape(c: Column, places: Column) -> Column:
        here = places["here"]
        toward = lambda p: F.array(p["x"] - here["x"], p["y"] - here["y"])
        return (cosine_similarity(toward(c), toward(places["back"])) + cosine_similarity(toward(c), toward(places["ahead"]))) * 0.5

    def of_centroid(c: Column) -> Column:
        places = lambda at: F.struct(interpolate(of, at).alias("here"), interpolate(of, at - r).alias("back"), interpolate(of, at + r).alias("ahead"))
        return let(let(project(of, c["x"], c["y"]), places), lambda p: shape(c, p))

    return let(centroid(polygon), of_centroid)


def project_polygon(polygon: Column, of: Column) -> Column:
    """The straight line between the first and last place on a line that the polygon's exterior projects to."""
    at = F.transform(F.element_at(polygon, 1), lambda p: project(of, p["x"], p["y"]))
    return let(at, lambda a: F.array(interpolate(of, F.array_min(a)), interpolate(of, F.array_max(a))))


def offset(of: Column, by: Column) -> Column:
    """A line of two points moved to its left by a distance (to its right by a negative one); null if its points are one. For lines of more see curves.offset_curve."""

    def moved(m: Column) -> Column:
        a, b = F.element_at(m, 1), F.element_at(m, 2)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        scale = F.try_divide(by, F.sqrt(dx * dx + dy * dy))
        return let(scale, lambda s: F.transform(m, lambda p: point(p["x"] - dy * s, p["y"] + dx * s)))

    return let(of, moved)


def side_of(of: Column, other: Column) -> Column:
    """On which side of a line of two points another line is nearer: 1 for the left one, else -1."""
    nearer = lambda m: line_distance(other, offset(m, F.lit(1.0))) < line_distance(other, m)
    return let(of, lambda m: F.when(nearer(m), 1.0).otherwise(-1.0))


def move_to_side(of: Column, by: Column, centerline: Column) -> Column:
    """A line of two points moved by a distance towards the centerline (away from it by a negative one)."""
    return let(of, lambda m: offset(m, by * side_of(m, centerline)))
