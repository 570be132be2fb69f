"""A packed R-tree over line segments, as arrays that travel with the tasks.

Segments are sorted into tiles (by x into slices, by y within them) and packed FAN
to a node, level upon level. A batch of points goes down twice: first each to the
nearest child only, which gives a near segment and so a bound, then to all
nodes within the bound, level by level for the whole batch at once. Of equally near segments
the first holds, by line and place in the line.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

FAN, CHUNK = 16, 8192
_SLACK = 1 + 1e-9


def _box_gap2(low: np.ndarray, high: np.ndarray, to_low: np.ndarray, to_high: np.ndarray) -> np.ndarray:
    """Squared distances of boxes."""
    gap = np.maximum(0, np.maximum(low - to_high, to_low - high))
    return gap[..., 0] ** 2 + gap[..., 1] ** 2


class PackedSegments:
    """Segments (o, ax, ay, bx, by), in the order that settles ties."""

    def __init__(self, o: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray):
        n = len(o)
        x, y = ax + bx, ay + by
        slices = max(1, int(np.ceil(np.sqrt(n / FAN))))
        place = np.empty(n, np.int64)
        place[np.argsort(x, kind="stable")] = np.arange(n)
        self.first = np.lexsort((y, place // (slices * FAN)))  # the segment at each place in the tree
        self.o, self.a, self.b = o[self.first], np.stack([ax, ay], 1)[self.first], np.stack([bx, by], 1)[self.first]
        self.d = self.b - self.a
        length2 = (self.d**2).sum(axis=1)
        self.length2 = np.where(length2 > 0, length2, 1.0)
        self.levels = [(np.minimum(self.a, self.b), np.maximum(self.a, self.b))]
        while len(self.levels[-1][0]) > FAN:
            low, high = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    @classmethod
    def of(cls, segments: DataFrame) -> PackedSegments:
        """Of rows (o, i, ax, ay, bx, by), whose number the caller has bounded."""
        t = segments.toArrow()
        column = {n: t.column(n).to_numpy() for n in ("o", "i", "ax", "ay", "bx", "by")}
        order = np.lexsort((column["i"], column["o"]))
        return cls(*[column[n][order].astype(np.int64 if n == "o" else np.float64) for n in ("o", "ax", "ay", "bx", "by")])

    def feet(self, segment: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and place on the segment that is nearest to the point."""
        a, d = self.a[segment], self.d[segment]
        t = np.clip(((p - a) * d).sum(axis=-1) / self.length2[segment], 0, 1)
        foot = a + t[..., None] * d
        return ((foot - p) ** 2).sum(axis=-1), foot

    def _bounds(self, p: np.ndarray) -> np.ndarray:
        """Squared distance of each point from a segment nearby."""
        node = np.zeros(len(p), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[k]
            below = np.minimum(node[:, None] * FAN + np.arange(FAN), len(low) - 1)
            if k == 0:
                return self.feet(below, p[:, None, :])[0].min(axis=1)
            node = below[np.arange(len(p)), _box_gap2(low[below], high[below], p[:, None, :], p[:, None, :]).argmin(axis=1)]
        return np.zeros(0)

    def within(self, low: np.ndarray, high: np.ndarray, bound2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (box, place of a segment) whose boxes are no further apart than the box's bound."""
        box, node = np.arange(len(low)), np.zeros(len(low), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = self.levels[k]
            below = (node[:, None] * FAN + np.arange(FAN)).ravel()
            box = np.repeat(box, FAN)
            held = below < len(a)
            box, below = box[held], below[held]
            near = _box_gap2(a[below], b[below], low[box], high[box]) <= bound2[box] * _SLACK
            box, node = box[near], below[near]
        return box, node

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of finite points: o, squared distance and place of the nearest segment."""
        o, best, where = np.empty(len(x), np.int64), np.empty(len(x)), np.empty((len(x), 2))
        for s in range(0, len(x), CHUNK):
            p = np.stack([x[s : s + CHUNK], y[s : s + CHUNK]], axis=1)
            point, segment = self.within(p, p, self._bounds(p))
            d2, foot = self.feet(segment, p[point])
            order = np.lexsort((self.first[segment], d2, point))
            _, at = np.unique(point[order], return_index=True)
            one = order[at]
            o[s : s + CHUNK], best[s : s + CHUNK], where[s : s + CHUNK] = self.o[segment[one]], d2[one], foot[one]
        return o, best, where

    def nearest_of_polygons(self, polygons: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Of polygons as rings of points: o of the nearest line and its distance."""
        outer = [rings[0] for rings in polygons]
        starts = np.cumsum([0, *[len(r) for r in outer]])
        corners = np.concatenate(outer)
        _, d2, _ = self.nearest(corners[:, 0], corners[:, 1])
        bound2 = np.minimum.reduceat(d2, starts[:-1])
        low, high = np.minimum.reduceat(corners, starts[:-1]), np.maximum.reduceat(corners, starts[:-1])
        polygon, segment = self.within(low, high, bound2)
        order = np.argsort(polygon, kind="stable")
        ends = np.searchsorted(polygon[order], np.arange(len(polygons) + 1))
        o, distance = np.empty(len(polygons), np.int64), np.empty(len(polygons))
        for k, rings in enumerate(polygons):
            near = segment[order[ends[k] : ends[k + 1]]]
            d = np.concatenate([polygon_segment_distance(rings, self.a[s], self.b[s]) for s in np.array_split(near, 1 + len(near) * len(rings[0]) // 1_000_000)])
            one = np.lexsort((self.o[near], d))[0]
            o[k], distance[k] = self.o[near[one]], d[one]
        return o, distance


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))


def _points_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all points from all segments."""
    d = b - a
    length2 = (d**2).sum(axis=1)
    t = np.clip(((p[:, None] - a) * d).sum(axis=2) / np.where(length2 > 0, length2, 1.0), 0, 1)
    foot = a + t[..., None] * d - p[:, None]
    return np.sqrt((foot**2).sum(axis=2))


def polygon_segment_distance(rings: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of a polygon from each segment; 0 if they have a point in common."""
    u, v = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    a2, b2 = a[:, None], b[:, None]
    boxes = ((np.minimum(a2, b2) <= np.maximum(u, v)) & (np.minimum(u, v) <= np.maximum(a2, b2))).all(axis=2)
    meet = (boxes & (_turn(a2, b2, u) * _turn(a2, b2, v) <= 0) & (_turn(u, v, a2) * _turn(u, v, b2) <= 0)).any(axis=1)
    x, y = a2[..., 0], a2[..., 1]
    rise = np.where(v[:, 1] == u[:, 1], 1.0, v[:, 1] - u[:, 1])
    crossed = ((u[:, 1] > y) != (v[:, 1] > y)) & (x < u[:, 0] + (y - u[:, 1]) * (v[:, 0] - u[:, 0]) / rise)
    inside = crossed.sum(axis=1) % 2 == 1
    e, f = rings[0][:-1], rings[0][1:]
    d = np.minimum(np.minimum(_points_segments(a, e, f).min(axis=1), _points_segments(b, e, f).min(axis=1)), _points_segments(rings[0], a, b).min(axis=0))
    return np.where(meet | inside, 0.0, d)
