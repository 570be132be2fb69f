"""Exact tests of pairs of shapes, by numpy over whole Arrow batches.

What geometry's functions of the same names say of one pair, at a fraction of the time: an edge is
compared with those of the other shape only if it meets the other's box, and pairs that
a corner decides need no edges. The functions of columns give null or false for null shapes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_CELLS = 500_000  # compared at a time


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _begins(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n numbers from 0 for each entry: the entry, and the number."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _xy(points: pa.Array) -> np.ndarray:
    return np.stack([pc.struct_field(points, k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1).astype(float).reshape(-1, 2)


@dataclass
class Pieces:
    """Points, lines and polygons: of which row each is, its corners, its segments (ax, ay, bx, by), and whether it has an inside."""

    row: np.ndarray
    xy: np.ndarray
    corners: np.ndarray  # where each piece's begin, and the end
    seg: np.ndarray
    edges: np.ndarray  # likewise
    area: bool
    rings: np.ndarray | None = None  # of polygons: where each ring's corners begin, and the end
    of_ring: np.ndarray | None = None  # and where each polygon's rings begin

    @staticmethod
    def of_lines(lines: pa.Array, row: np.ndarray) -> Pieces:
        n, xy = _sizes(lines), _xy(lines.flatten())
        begins, on = _begins(n), np.ones(len(xy), bool)
        on[begins[1:][n > 0] - 1] = False
        at = np.flatnonzero(on)
        return Pieces(row, xy, begins, np.hstack([xy[at], xy[at + 1]]), _begins(np.maximum(n - 1, 0)), False)

    @staticmethod
    def of_polygons(polygons: pa.Array, row: np.ndarray) -> Pieces:
        rings = Pieces.of_lines(polygons.flatten(), row)
        k = _begins(_sizes(polygons))
        return Pieces(row, rings.xy, rings.corners[k], rings.seg, rings.edges[k], True, rings.corners, k)

    def first(self) -> np.ndarray:
        """The first corner of each piece; NaN without any."""
        out = np.full((len(self.row), 2), np.nan)
        some = self.corners[1:] > self.corners[:-1]
        out[some] = self.xy[self.corners[:-1][some]]
        return out

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest corners of each piece; NaN without any."""
        low, high = np.full((len(self.row), 2), np.nan), np.full((len(self.row), 2), np.nan)
        some = np.flatnonzero(self.corners[1:] > self.corners[:-1])
        if len(some):
            low[some], high[some] = np.fmin.reduceat(self.xy, self.corners[some]), np.fmax.reduceat(self.xy, self.corners[some])
        return low, high


def _batches(n: np.ndarray):
    """Ranges of entries with about _CELLS in all."""
    ends, s = np.cumsum(n), 0
    while s < len(n):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + _CELLS, side="right")))
        yield slice(s, e)
        s = e


def inside(of: Pieces, piece: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of points and the polygon that each is compared with: whether a ray from it crosses the boundary an odd number of times, and whether it is on the boundary."""
    odd, on = np.zeros(len(p), bool), np.zeros(len(p), bool)
    begin = of.edges[piece]
    for part in _batches(of.edges[piece + 1] - begin):
        q, k = _spread(of.edges[piece[part] + 1] - begin[part])
        ax, ay, bx, by = of.seg[begin[part][q] + k].T
        x, y = p[part][q].T
        rise = by - ay
        crossed = ((ay > y) != (by > y)) & (x < ax + (y - ay) * ((bx - ax) / np.where(rise == 0, 1.0, rise)))
        at = (bx - ax) * (y - ay) == rise * (x - ax)
        at &= (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx)) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by))
        n = len(p[part])
        odd[part] = np.bincount(q[crossed], minlength=n) % 2 == 1
        on[part] = np.bincount(q[at], minlength=n) > 0
    return odd, on


def _covers(of: Pieces, piece: np.ndarray, p: np.ndarray) -> np.ndarray:
    odd, on = inside(of, piece, p)
    return odd | on


def _turn(ax, ay, bx, by, cx, cy) -> np.ndarray:
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _cross(a: Pieces, i: np.ndarray, b: Pieces, j: np.ndarray, proper: bool = False) -> np.ndarray:
    """Whether an edge of piece i of a and one of piece j of b have a point in common; `proper`: one that is an end of neither, nor on the other's line."""
    out = np.zeros(len(i), bool)
    low, high = (v[j] for v in b.boxes())
    begin, n = a.edges[i], a.edges[i + 1] - a.edges[i]
    for part in _batches(n):
        q, k = _spread(n[part])
        s, q = a.seg[begin[part][q] + k], q + part.start
        near = ((np.minimum(s[:, :2], s[:, 2:]) <= high[q]) & (low[q] <= np.maximum(s[:, :2], s[:, 2:]))).all(axis=1)
        s, q = s[near], q[near]
        m = b.edges[j[q] + 1] - b.edges[j[q]]
        for some in _batches(m):
            r, k = _spread(m[some])
            ax, ay, bx, by = s[some][r].T
            cx, cy, dx, dy = b.seg[b.edges[j[q[some]]][r] + k].T
            met = (np.minimum(ax, bx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(ay, by))
            one = _turn(ax, ay, bx, by, cx, cy) * _turn(ax, ay, bx, by, dx, dy)
            other = _turn(cx, cy, dx, dy, ax, ay) * _turn(cx, cy, dx, dy, bx, by)
            met &= (one < 0) & (other < 0) if proper else (one <= 0) & (other <= 0)
            out[q[some][r[met]]] = True
    return out


def _meet(polygons: Pieces, pieces: Pieces, rows: int) -> np.ndarray:
    """Of each row, whether its polygon has a point in common with any of its pieces."""
    met, piece, row = np.zeros(rows, bool), np.arange(len(pieces.row)), pieces.row
    held = _covers(polygons, row, pieces.first())
    met[row[held]] = True
    if pieces.area:
        left = piece[~met[row]]
        held = _covers(pieces, left, polygons.first()[row[left]])
        met[row[left[held]]] = True
    left = piece[~met[row]]
    met[row[left[_cross(pieces, left, polygons, row[left])]]] = True
    return met


def _owned(lists: pa.Array) -> np.ndarray:
    n = _sizes(lists)
    return np.repeat(np.arange(len(n)), n)


def meets(polygon: Column, shape: Column, kind: str) -> Column:
    """Whether a polygon has a point in common, boundaries included, with a shape of a kind: line, polygon, parts or any."""

    @F.arrow_udf("boolean")
    def f(a: pa.Array, b: pa.Array) -> pa.Array:
        n = len(a)
        rows = np.arange(n)
        polygons = Pieces.of_polygons(a, rows)
        if kind == "line":
            found = [Pieces.of_lines(b, rows)]
        elif kind == "polygon":
            found = [Pieces.of_polygons(b, rows)]
        elif kind == "parts":
            found = [Pieces.of_polygons(b.flatten(), _owned(b))]
        else:
            points, lines, parts = (pc.struct_field(b, k) for k in range(3))
            xy = _xy(points.flatten())
            single = Pieces(_owned(points), xy, np.arange(len(xy) + 1), np.zeros((0, 4)), np.zeros(len(xy) + 1, np.int64), False)
            found = [single, Pieces.of_lines(lines.flatten(), _owned(lines)), Pieces.of_polygons(parts.flatten(), _owned(parts))]
        with np.errstate(invalid="ignore"):
            return pa.array(np.logical_or.reduce([_meet(polygons, p, n) for p in found]))

    return f(polygon, shape)


def _within(inner: Pieces, outer: Pieces) -> np.ndarray:
    rows = np.arange(len(inner.row))
    found = inner.corners[1:] > inner.corners[:-1]
    for p, begins in ((inner.xy, inner.corners), ((inner.seg[:, :2] + inner.seg[:, 2:]) / 2, inner.edges)):
        of = np.repeat(rows, np.diff(begins))
        use = found[of]
        bad = ~_covers(outer, of[use], p[use])
        found[of[use][bad]] = False
    left = np.flatnonzero(found)
    found[left[_cross(inner, left, outer, left, proper=True)]] = False
    of, k = _spread(np.diff(outer.of_ring))
    ring = outer.of_ring[of] + k
    hole = (k > 0) & found[of] & (outer.rings[ring + 1] > outer.rings[ring])
    odd, on = inside(inner, of[hole], outer.xy[outer.rings[ring[hole]]])
    found[of[hole][odd & ~on]] = False
    return found


def polygon_within(inner: Column, outer: Column) -> Column:
    """Whether a polygon lies in another, boundaries included."""

    @F.arrow_udf("boolean")
    def f(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = np.arange(len(a))
        with np.errstate(invalid="ignore"):
            return pa.array(_within(Pieces.of_polygons(a, rows), Pieces.of_polygons(b, rows)))

    return f(inner, outer)
