"""Buffers and offset curves.

A shape's boundary is walked with the shape on the left. Each edge moves to the right by
the radius; where the walk turns left an arc joins the moved edges, where it turns
right they are joined where they cross, or through the corner itself if they are too short. The curve so made winds around exactly
what is nearer than the radius, perhaps more than once, so after cutting it at its
crossings the pieces stay that have something on their left and nothing on their right. A
line is walked there and back, a point is a circle.

Arcs have their corners at whole multiples of a quarter turn's QUARTER-th part, so
that bounds are exactly the radius wider; between corners the arc's chord runs inside.
The two functions of columns work in Python: give their result a name before a lambda uses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from shorewise.functions.geometry import LINE, POLYGON

QUARTER = 16
_STEP = np.pi / 2 / QUARTER
_CHUNK, _CELLS = 128, 4_000_000  # of a batch: points, and pairs
_SHAPES, _CORNERS = 1000, 20_000  # of shapes worked on together
_TOLERANCE = 1e-11  # of a shape brought to a size between a half and one


def _without_repeats(p: np.ndarray) -> np.ndarray:
    return p[np.append(True, (p[1:] != p[:-1]).any(axis=1))]


def _arcs(centre: np.ndarray, radius: np.ndarray, begin: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners strictly between two directions, turning left from the first (to the right if turn is negative), and how many each arc has."""
    a, b = np.minimum(begin, begin + turn), np.maximum(begin, begin + turn)
    low, high = np.floor(a / _STEP + 1e-9) + 1, np.ceil(b / _STEP - 1e-9)
    n = np.maximum(high - low, 0).astype(int)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    k = np.where(np.repeat(turn > 0, n), np.repeat(low, n) + at, np.repeat(high, n) - 1 - at)
    unit = np.stack([np.cos(k * _STEP), np.sin(k * _STEP)], axis=1)
    unit[np.abs(unit) < 1e-12] = 0.0  # quarter turns are exact
    return np.repeat(centre, n, axis=0) + np.repeat(radius, n)[:, None] * unit, n


def _arranged(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Points put in order: each part has points and how many of them each corner has; a corner's come part by part. Also how many each corner has."""
    counts = np.stack([n for _, n in parts])
    begin = np.concatenate([[0], np.cumsum(counts.T.reshape(-1))])[:-1].reshape(-1, len(parts)).T
    out = np.empty((counts.sum(), 2))
    for (points, n), first in zip(parts, begin, strict=True):
        out[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(points))] = points
    return out, counts.sum(axis=0)


def _sides(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions of edges, and unit vectors to their right."""
    d = (q - p) / np.hypot(*(q - p).T)[:, None]
    return d, np.stack([d[:, 1], -d[:, 0]], axis=1)


def _turns(d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """Angles from directions to the next ones, left positive; half a turn counts as left."""
    angle = np.arctan2(d0[:, 0] * d1[:, 1] - d0[:, 1] * d1[:, 0], (d0 * d1).sum(axis=1))
    return np.where(angle < -np.pi + 1e-12, np.pi, angle)


def _around(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of closed walks of so many points in one array, the places of each point's forerunner and follower."""
    ends = np.cumsum(n)
    before, after = np.arange(-1, n.sum() - 1), np.arange(1, n.sum() + 1)
    before[ends - n], after[ends - 1] = ends - 1, ends - n
    return before, after


def _moved_rings(rings: list[np.ndarray], radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The curves of closed walks, each with its radius: their points, none repeated at the end, and how many each curve has."""
    rings = [_without_repeats(r) for r in rings]
    rings = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
    n = np.array([len(r) for r in rings])
    p, radius, dot = np.concatenate(rings), np.repeat(radius, n), np.repeat(n == 1, n)
    before, after = _around(n)
    q = np.where(dot[:, None], p + [1.0, 0.0], p[after])
    edge, (d, right) = np.hypot(*(q - p).T), _sides(p, q)
    turn = np.where(dot, 2 * np.pi, _turns(d[before], d))
    # the moved edges cross, and leave half an edge to the next corner
    cross = (turn < 0) & (radius * np.tan(np.minimum(-turn, np.pi - 1e-9) / 2) <= np.minimum(edge[before], edge) / 2)
    begin = np.where(dot, 0.0, np.arctan2(right[before, 1], right[before, 0]))
    far, left, one = radius[:, None], turn >= 0, np.ones(len(p), int)
    meet = p + far * (right[before] + right) / np.where(cross, 1 + (right[before] * right).sum(axis=1), 1.0)[:, None]
    first = ~cross & ~dot
    joint = _arcs(p[left], radius[left], begin[left], turn[left])
    arc = np.zeros(len(p), int)
    arc[left] = joint[1]
    inner = ~left & ~cross
    last = np.where(dot[:, None], p + far * [1.0, 0.0], np.where(cross[:, None], meet, p + far * right))
    out, count = _arranged(((p + far * right[before])[first], first * one), (joint[0], arc), (p[inner], inner * one), (last, one))
    return out, np.add.reduceat(count, np.cumsum(n) - n)


def _ranges(begin: np.ndarray, end: np.ndarray, tolerance: float) -> list[tuple[np.ndarray, ...]]:
    """By levels of length: intervals of a level, those of it and of lower levels in order, and which of these each may meet (the first and how many).

    None of the latter begins further back than the level's length.
    """
    unit = max(float(np.median(end - begin)), 2e-6, tolerance)
    level = np.ceil(np.log2(np.maximum((end - begin) / unit, 1.0))).astype(int)
    order, out = np.argsort(begin, kind="stable"), []
    for c in np.unique(level):
        own, lower = order[level[order] == c], order[level[order] <= c]
        first = np.searchsorted(begin[lower], begin[own] - unit * 2.0**c - tolerance)
        out.append((own, lower, first, np.searchsorted(begin[lower], end[own] + tolerance, side="right") - first))
    return out


def _meeting(low: np.ndarray, high: np.ndarray, tolerance: float, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes of one group that meet, each once, in batches; looked for along the axis that leaves fewer to compare.

    Groups, if there are any, lie within -1 and 1; for the search alone they are put side by side, which costs a few last digits.
    """
    group = np.zeros(len(low), int) if group is None else group
    apart = group * 4.0
    axes = [_ranges(low[:, k] + apart, high[:, k] + apart, 4 * tolerance) for k in (0, 1)]
    for own, lower, first, count in min(axes, key=lambda levels: sum(int(n.sum()) for *_, n in levels)):
        whole = np.isin(lower, own)  # of the same level: found from both sides
        ends, s = np.cumsum(count), 0
        while s < len(own):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + _CELLS, side="right")))
            n = count[s:e]
            at = np.arange(n.sum()) + np.repeat(first[s:e] - np.cumsum(n) + n, n)
            i, j = np.repeat(own[s:e], n), lower[at]
            once = ~whole[at] | (j < i)
            i, j = i[once], j[once]
            same = group[i] == group[j]
            i, j = i[same], j[same]
            for k in (0, 1):
                met = (low[i, k] <= high[j, k] + tolerance) & (low[j, k] <= high[i, k] + tolerance)
                i, j = i[met], j[met]
            yield i, j
            s = e


def _cut(a: np.ndarray, b: np.ndarray, group: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments cut where they meet others of their group: starts and ends of the pieces in order, and which segment each is of."""
    n = len(a)
    of, at, where = [np.repeat(np.arange(n), 2)], [np.tile([0.0, 1.0], n)], [np.stack([a, b], axis=1).reshape(-1, 2)]
    d = b - a
    for i, j in _meeting(np.minimum(a, b), np.maximum(a, b), tolerance, group) if n else ():
        cross, gap = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0], a[j] - a[i]
        length = np.hypot(*d[i].T) * np.hypot(*d[j].T)
        skew = np.abs(cross) > 1e-12 * length
        safe = np.where(skew, cross, 1.0)
        t, u = (gap[:, 0] * d[j, 1] - gap[:, 1] * d[j, 0]) / safe, (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / safe
        e, f = tolerance / np.hypot(*d[i].T), tolerance / np.hypot(*d[j].T)
        meet = skew & (t >= -e) & (t <= 1 + e) & (u >= -f) & (u <= 1 + f)
        p = a[i] + t[:, None] * d[i]
        of += [i[meet], j[meet]]
        at += [t[meet], u[meet]]
        where += [p[meet], p[meet]]
        along = ~skew & (np.abs(gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) <= tolerance * np.hypot(*d[i].T))
        for x, y in ((i[along], j[along]), (j[along], i[along])):  # ends of one segment within another that lies along it
            for end in (a, b):
                t = ((end[y] - a[x]) * d[x]).sum(axis=1) / (d[x] ** 2).sum(axis=1)
                inner = (t > 0) & (t < 1)
                of.append(x[inner])
                at.append(t[inner])
                where.append(end[y][inner])
    of, at, where = np.concatenate(of), np.clip(np.concatenate(at), 0, 1), np.concatenate(where)
    order = np.lexsort((at, of))
    of, where = of[order], where[order]
    pairs = np.flatnonzero(of[1:] == of[:-1])
    pairs = pairs[np.hypot(*(where[pairs + 1] - where[pairs]).T) > tolerance]
    return where[pairs], where[pairs + 1], of[pairs]


def _windings(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often the closed curve of the segments winds around each point."""
    out = np.zeros(len(p), np.int64)
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    rise = np.where(low == high, 1.0, b[:, 1] - a[:, 1])
    order, s = np.argsort(p[:, 1], kind="stable"), 0
    while s < len(p):
        mine = order[s : s + _CHUNK]
        level = np.flatnonzero((low <= p[mine[-1], 1]) & (high > p[mine[0], 1]))
        mine = mine[: max(1, _CELLS // max(len(level), 1))]
        x, y, u, v = p[mine, :1], p[mine, 1:], a[level], b[level]
        up, down = (u[:, 1] <= y) & (v[:, 1] > y), (v[:, 1] <= y) & (u[:, 1] > y)
        right = u[:, 0] + (y - u[:, 1]) * (v[:, 0] - u[:, 0]) / rise[level] > x
        out[mine] = (up & right).sum(axis=1) - (down & right).sum(axis=1)
        s += len(mine)
    return out


def _away(m: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether no segment is nearer to a point than its least distance; neighbouring points look together at the segments around them."""
    low, high, d = np.minimum(a, b), np.maximum(a, b), b - a
    length2 = (d**2).sum(axis=1)
    out, s = np.ones(len(m), bool), 0
    while s < len(m):
        some, reach = m[s : s + _CHUNK], least[s : s + _CHUNK].max()
        near = np.flatnonzero(((low <= some.max(axis=0) + reach) & (high >= some.min(axis=0) - reach)).all(axis=1))
        some = some[: max(1, _CELLS // max(len(near), 1))]
        if len(near):
            t = np.clip(((some[:, None] - a[near]) * d[near]).sum(axis=2) / length2[near], 0, 1)
            gap = np.sqrt(((a[near] + t[..., None] * d[near] - some[:, None]) ** 2).sum(axis=2).min(axis=1))
            out[s : s + len(some)] = gap >= least[s : s + len(some)]
        s += len(some)
    return out


def _places(p: np.ndarray, group: np.ndarray, tolerance: float) -> np.ndarray:
    """Numbers for points; those of one group within twice the tolerance of one another have one."""
    order = np.lexsort((p[:, 1], p[:, 0], group))
    new = np.ones(len(p), bool)
    new[1:] = (p[order[1:]] != p[order[:-1]]).any(axis=1) | (group[order[1:]] != group[order[:-1]])
    which = np.empty(len(p), int)
    which[order] = np.cumsum(new) - 1
    at, of = p[order[new]], group[order[new]]
    pairs = [np.stack(x) for x in _meeting(at, at, 2 * tolerance, of)] if len(at) else []
    i, j = np.concatenate([np.zeros((2, 0), int), *pairs], axis=1)
    number = np.arange(len(at))
    while (number[i] != number[j]).any():
        least = np.minimum(number[i], number[j])
        np.minimum.at(number, i, least)
        np.minimum.at(number, j, least)
        number = number[number]
    return number[which]


def _chained(a: np.ndarray, b: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Pieces between numbered places put together to lines: where several go on, the one furthest to the left. Closed lines repeat their first point."""
    ends = [(int(i), int(j)) for i, j in places.T]
    pieces = list({e: k for k, e in reversed(list(enumerate(ends))) if e[0] != e[1]}.items())
    after: dict[int, list[int]] = {}
    incoming = {e[1] for e, _ in pieces}
    for e, k in sorted(pieces, key=lambda x: x[1]):
        after.setdefault(e[0], []).append(k)
    out = []
    for e, k in sorted(pieces, key=lambda x: (x[0][0] in incoming, x[1])):  # those that nothing leads to begin
        if k not in after.get(e[0], ()):
            continue
        line, first = [a[k]], e[0]
        while True:
            after[ends[k][0]].remove(k)
            line.append(b[k])
            at, d = ends[k][1], b[k] - a[k]
            if at == first or not after.get(at):
                break
            k = after[at][0]
            if len(after[at]) > 1:
                k = max(after[at], key=lambda m: np.arctan2(d[0] * (b[m] - a[m])[1] - d[1] * (b[m] - a[m])[0], d @ (b[m] - a[m])))  # noqa: B023
        out.append(np.array([*line[:-1], line[0]] if at == first else line))
    return out


def _lines(a: np.ndarray, b: np.ndarray, group: np.ndarray, places: np.ndarray, n: int) -> list[list[np.ndarray]]:
    """By group the lines that _chained makes of its pieces; where no two pieces begin or end at one place, by runs of pieces that follow one another."""
    out: list[list[np.ndarray]] = [[] for _ in range(n)]
    real = places[0] != places[1]
    a, b, group, places = a[real], b[real], group[real], places[:, real]
    if not len(a):
        return out
    begins, ends = (np.bincount(x, minlength=places.max() + 1) for x in places)
    forked = np.zeros(n, bool)
    forked[group[(begins[places[0]] > 1) | (ends[places[1]] > 1)]] = True
    bounds = np.searchsorted(group, np.arange(n + 1))
    for g in np.flatnonzero(forked):
        own = slice(bounds[g], bounds[g + 1])
        out[g] = _chained(a[own], b[own], places[:, own])
    follower = np.full(places.max() + 1, -1)
    follower[places[0]] = np.arange(len(a))
    after = follower[places[1]]
    led = ends[places[0]] > 0
    first = np.flatnonzero(np.append(True, after[:-1] != np.arange(1, len(a))) & ~forked[group])
    last = np.append(np.flatnonzero(after != np.arange(1, len(a) + 1)), len(a) - 1)
    last = last[np.searchsorted(last, first)]
    run = {int(f): int(e) for f, e in zip(first, last, strict=True)}
    for f in sorted(run, key=lambda k: (group[k], led[k], k)):
        if f not in run:
            continue
        line, k = [a[f : f + 1]], f
        while k in run:
            e = run.pop(k)
            line.append(b[k : e + 1])
            k = int(after[e])
        if places[1][e] == places[0][f]:
            line[-1] = np.vstack([line[-1][:-1], line[0]])
        out[group[f]].append(np.concatenate(line))
    return out


def _area(ring: np.ndarray) -> float:
    p = ring - ring[0]
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def _straightened(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring without the corners at which it goes straight on."""
    p = ring[:-1]
    before, after = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    bent = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > tolerance * np.hypot(*after.T)
    p = p[bent | ((before * after).sum(axis=1) < 0)]
    return np.vstack([p, p[:1]])


def _together(sizes: list[int]) -> Iterator[slice]:
    """Runs of shapes of so many corners to be worked on together."""
    begin, held = 0, 0
    for k, n in enumerate(sizes):
        if k > begin and (held + n > _CORNERS or k - begin == _SHAPES):
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _brought(a: np.ndarray, b: np.ndarray, n: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of shapes moved to each shape's middle and scaled to a size between a half and one; the middles, scales and sizes.

    Middles are whole eighths and scales powers of two, so that nothing is lost on the way there and back.
    """
    first = np.cumsum(n) - n
    low, high = np.minimum.reduceat(np.minimum(a, b), first), np.maximum.reduceat(np.maximum(a, b), first)
    part = np.ldexp(0.125, np.frexp(np.maximum((high - low).max(axis=1), far))[1])[:, None]
    shift = np.round((low + high) / 2 / part) * part
    size = np.maximum(np.maximum(np.abs(low - shift), np.abs(high - shift)).max(axis=1), far)
    scale = np.ldexp(1.0, -np.frexp(size)[1])
    to, each = np.repeat(shift, n, axis=0), np.repeat(scale, n)[:, None]
    return (a - to) * each, (b - to) * each, shift, scale, size * scale


def _edges(a: np.ndarray, b: np.ndarray, group: np.ndarray, p: np.ndarray, q: np.ndarray, of: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Which pieces have something on their left and nothing on their right.

    Pieces that follow one another, and meet no others on the way, have the same on either side: the longest of them is looked at.
    """
    ends, size = (np.bincount(x, minlength=len(p) * 2) for x in places), np.hypot(*(q - p).T)
    plain = np.logical_and(*(e == 1 for e in ends))
    joined = np.append(False, (places[1][:-1] == places[0][1:]) & plain[places[0][1:]])
    run = np.cumsum(~joined) - 1
    order = np.lexsort((-size, run))
    chosen = order[np.searchsorted(run[order], np.arange(run[-1] + 1))]
    middle, aside = (p[chosen] + q[chosen]) / 2, 1e-8 * _sides(p[chosen], q[chosen])[1]
    own, edge = group[of[chosen]], np.zeros(len(chosen), bool)
    places_, segments = np.searchsorted(own, np.arange(n + 1)), np.searchsorted(group, np.arange(n + 1))
    for g in range(n):
        x, y = slice(places_[g], places_[g + 1]), slice(segments[g], segments[g + 1])
        w = _windings(np.concatenate([middle[x] - aside[x], middle[x] + aside[x]]), a[y], b[y]).reshape(2, -1)
        edge[x] = (w[0] > 0) & (w[1] <= 0)
    return edge[run]


def buffers(shapes: list[list[np.ndarray]], radius: np.ndarray) -> list[list[list[np.ndarray]]]:
    """buffer_rings of many shapes, each with its radius: worked out together, so that a small shape costs no more than its corners."""
    shapes = [[r for r in rings if len(r)] for rings in shapes]
    out: list[list[list[np.ndarray]]] = [[] for _ in shapes]
    there = [k for k, rings in enumerate(shapes) if rings]
    for some in _together([sum(map(len, shapes[k])) for k in there]):
        own = there[some]
        for k, found in zip(own, _buffers([shapes[k] for k in own], np.asarray(radius, float)[own]), strict=True):
            out[k] = found
    return out


def _buffers(shapes: list[list[np.ndarray]], radius: np.ndarray) -> list[list[list[np.ndarray]]]:
    walks = np.array([len(rings) for rings in shapes])
    curve, n = _moved_rings([r for rings in shapes for r in rings], np.repeat(radius, walks))
    per_shape = np.add.reduceat(n, np.cumsum(walks) - walks)
    a, b, shift, scale, size = _brought(curve, curve[_around(n)[1]], per_shape, radius)
    group = np.repeat(np.arange(len(shapes)), per_shape)
    real = np.hypot(*(b - a).T) > _TOLERANCE
    a, b, group = a[real], b[real], group[real]
    if not len(a):
        return [[] for _ in shapes]
    p, q, of = _cut(a, b, group, _TOLERANCE)
    places = _places(np.concatenate([p, q]), np.tile(group[of], 2), _TOLERANCE).reshape(2, -1)
    edge = _edges(a, b, group, p, q, of, places, len(shapes))
    found = _lines(p[edge], q[edge], group[of[edge]], places[:, edge], len(shapes))
    return [[[r / scale[k] + shift[k] for r in polygon] for polygon in _polygons(rings, size[k])] for k, rings in enumerate(found)]


def _polygons(rings: list[np.ndarray], size: float) -> list[list[np.ndarray]]:
    """Outer rings, the largest first, each with the holes in it."""
    found = [_straightened(r, 1e-10 * size) for r in rings if len(r) > 3 and abs(_area(r)) > 1e-10 * size * size]
    outer = sorted((r for r in found if _area(r) > 0), key=_area, reverse=True)
    polygons = [[r] for r in outer]
    boxes = np.array([[r.min(axis=0), r.max(axis=0)] for r in outer]).reshape(-1, 2, 2) if len(outer) < len(found) else None
    for hole in (r for r in found if _area(r) < 0) if boxes is not None else ():
        p = hole[:1] - 1e-9 * size * _sides(hole[:1], hole[1:2])[1]
        around = [k for k in np.flatnonzero(((boxes[:, 0] <= p) & (p <= boxes[:, 1])).all(axis=1)) if _windings(p, outer[k][:-1], outer[k][1:])[0] > 0]
        if around:
            polygons[around[-1]].append(hole)
    return polygons


def buffer_rings(rings: list[np.ndarray], radius: float) -> list[list[np.ndarray]]:
    """Polygons, each as rings with the exterior first, of what is no further than the radius from the inside of closed walks (the shape on their left)."""
    return buffers([rings], np.array([radius]))[0]


def _walks(rings: list[np.ndarray], kind: str) -> list[np.ndarray]:
    if kind == "polygon":
        return [r if (_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)]
    line = rings[0]
    return [np.vstack([line, line[-2::-1]])] if len(line) > 1 else [line]


def offset_pieces(line: np.ndarray, by: float, join: str = "mitre", limit: float = 5.0) -> list[np.ndarray]:
    """A line moved to its left by a distance (to its right by a negative one), without what comes nearer to the line than that.

    Outer corners are mitred up to `limit` times the distance and rounded beyond it, or all rounded.
    """
    return offsets([line], np.array([by]), join, limit)[0]


def offsets(lines: list[np.ndarray], by: np.ndarray, join: str = "mitre", limit: float = 5.0) -> list[list[np.ndarray]]:
    """offset_pieces of many lines, each with its distance, worked out together."""
    lines, by = [_without_repeats(line) for line in lines], np.asarray(by, float)
    out = [[p] if len(p) > 1 and d == 0 else [] for p, d in zip(lines, by, strict=True)]
    there = [k for k, (p, d) in enumerate(zip(lines, by, strict=True)) if len(p) > 1 and d != 0]
    for some in _together([len(lines[k]) for k in there]):
        own = there[some]
        for k, found in zip(own, _offsets([lines[k] for k in own], by[own], join, limit), strict=True):
            out[k] = found
    return out


def _moved_lines(p: np.ndarray, n: np.ndarray, by: np.ndarray, join: str, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of so many points moved edge by edge: the points, how many each has, and whether the segment from each is a round corner's chord."""
    ends = np.cumsum(n)
    first, last = np.zeros(len(p), bool), np.zeros(len(p), bool)
    first[ends - n], last[ends - 1] = True, True
    by = np.repeat(by, n)
    q = np.where(last[:, None], p + [1.0, 0.0], np.roll(p, -1, axis=0))
    edge, (d, right) = np.hypot(*(q - p).T), _sides(p, q)
    side, far = -np.sign(by)[:, None] * right, np.abs(by)  # towards the line that is made
    back = lambda x: np.roll(x, 1, axis=0)
    turn = np.where(first | last, 0.0, _turns(back(d), d) * np.where(by > 0, 1, -1))
    before, after = p + far[:, None] * back(side), p + far[:, None] * side
    ahead = np.where(first[:, None], after, before)  # an end, or a corner that goes straight on
    mitre, bent = 1 / np.maximum(np.cos(turn / 2), 1e-12), np.abs(turn) >= 1e-12
    # the inner side of the bend, where edges may be too short to meet
    inner = bent & (turn > 0) & (far * np.tan(turn / 2) > np.minimum(back(edge), edge) / 2)
    sharp = bent & ~inner & ((turn > 0) | ((join == "mitre") & (mitre <= limit)))
    round_ = bent & ~inner & ~sharp
    meet = p + far[:, None] * (back(side) + side) / np.where(sharp, 1 + (back(side) * side).sum(axis=1), 1.0)[:, None]
    begin = np.arctan2(back(side)[:, 1], back(side)[:, 0])
    chords, arc = _arcs(p[round_], far[round_], begin[round_], (turn * np.where(by > 0, 1, -1))[round_])
    count, two, one = np.zeros(len(p), int), inner | round_, np.ones(len(p), int)
    count[round_] = arc
    curve, each = _arranged((np.where(sharp[:, None], meet, ahead), one), (p[inner], inner * one), (chords, count), (after[two], two * one))
    place = np.arange(len(curve)) - np.repeat(np.cumsum(each) - each, each)
    return curve, np.add.reduceat(each, ends - n), np.repeat(round_, each) & (place < np.repeat(each, each) - 1)


def _offsets(lines: list[np.ndarray], by: np.ndarray, join: str, limit: float) -> list[list[np.ndarray]]:
    points, far = np.array([len(p) for p in lines]), np.abs(by)
    p = np.concatenate(lines)
    curve, n, chord = _moved_lines(p, points, by, join, limit)
    # cut also where it comes too near to the line from its other side, or to its ends
    wall, w = _moved_rings([np.vstack([line, line[-2::-1]]) for line in lines], far)
    within = np.ones(len(curve), bool)
    within[np.cumsum(n) - 1] = False
    k = np.arange(len(lines))
    group = np.concatenate([np.repeat(k, n)[within], np.repeat(k, w)])
    moved = np.arange(len(group)) < within.sum()
    order = np.argsort(group, kind="stable")  # a line's curve, then its wall
    a = np.concatenate([curve[within], wall])[order]
    b = np.concatenate([curve[1:][within[:-1]], wall[_around(w)[1]]])[order]
    group, moved, chord = group[order], moved[order], np.concatenate([chord[within], np.zeros(len(wall), bool)])[order]
    a, b, shift, scale, size = _brought(a, b, np.bincount(group), far)
    real = np.hypot(*(b - a).T) > _TOLERANCE
    a, b, group, moved, chord = a[real], b[real], group[real], moved[real], chord[real]
    u, v, of = _cut(a, b, group, _TOLERANCE)
    own = moved[of]
    u, v, of = u[own], v[own], of[own]
    far = (far * scale)[group[of]]
    least = np.where(chord[of], far * np.cos(_STEP / 2), far) - 1e-8 * size[group[of]]
    kept, bounds, ends = np.zeros(len(u), bool), np.searchsorted(group[of], np.arange(len(lines) + 1)), np.cumsum(points)
    for g in range(len(lines)):
        q, x = (p[ends[g] - points[g] : ends[g]] - shift[g]) * scale[g], slice(bounds[g], bounds[g + 1])
        kept[x] = _away((u[x] + v[x]) / 2, q[:-1], q[1:], least[x])
    u, v, of = u[kept], v[kept], group[of[kept]]
    places = _places(np.concatenate([u, v]), np.tile(of, 2), _TOLERANCE).reshape(2, -1)
    return [[_unbent(r, 1e-10 * size[g]) / scale[g] + shift[g] for r in found] for g, found in enumerate(_lines(u, v, of, places, len(lines)))]


def _unbent(line: np.ndarray, tolerance: float) -> np.ndarray:
    """A line without the inner points that are no further than the tolerance from where it goes straight on."""
    before, after = line[1:-1] - line[:-2], line[2:] - line[1:-1]
    away = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
    return line[np.concatenate([[True], away > tolerance * np.hypot(*(before + after).T), [True]])]


def rings_of(polygons: pa.Array) -> list[list[np.ndarray]]:
    """Of an Arrow column of polygons, none of them null, the rings of each as arrays of points."""
    rings = polygons.flatten()
    points = rings.flatten()
    xy = np.stack([points.field(0).to_numpy(zero_copy_only=False), points.field(1).to_numpy(zero_copy_only=False)], axis=1)
    ends = np.cumsum(pc.list_value_length(rings).to_numpy(zero_copy_only=False))
    each = np.split(xy, ends[:-1])
    ends = np.cumsum(pc.list_value_length(polygons).to_numpy(zero_copy_only=False))
    return [each[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _arrow_of(shapes: list[list[np.ndarray] | None]) -> pa.ListArray:
    """Lists of lists of points, or null."""
    lines = [line for s in shapes for line in s or ()]
    xy = np.concatenate([np.zeros((0, 2)), *lines])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
    starts = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    inner = pa.ListArray.from_arrays(starts([len(line) for line in lines]), points)
    return pa.ListArray.from_arrays(starts([len(s or ()) for s in shapes]), inner, mask=pa.array([s is None for s in shapes]))


def _applied(make: Callable[[list[list[np.ndarray]], np.ndarray], list[list[np.ndarray] | None]], kind: str) -> Callable[[Column, Column], Column]:
    """A function of many shapes' rings and a number each as one of columns; nulls, and shapes without points, give null."""

    @F.arrow_udf(kind)
    def f(shapes: pa.Array, by: pa.Array) -> pa.Array:
        number = by.to_numpy(zero_copy_only=False).astype(float)
        there = np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(shapes), 0), False).to_numpy(zero_copy_only=False) & np.isfinite(number))
        out: list = [None] * len(shapes)
        if len(there):
            rings = rings_of(shapes.take(pa.array(there)))
            whole = [k for k, own in enumerate(rings) if all(len(r) and np.isfinite(r).all() for r in own)]
            for k, made in zip(there[whole], make([rings[k] for k in whole], number[there[whole]]), strict=True):
                out[k] = made
        return _arrow_of(out)

    return f


def buffered(shape: Column, radius: Column, kind: str = "polygon") -> Column:
    """The polygon of all that is no further than the radius from a polygon, a line or a point; a negative radius isn't allowed."""

    def make(shapes: list[list[np.ndarray]], r: np.ndarray) -> list[list[np.ndarray] | None]:
        if (r < 0).any():
            raise ValueError("a buffer's radius can't be negative")
        walks, same = [_walks(rings, kind) for rings in shapes], (r == 0) & (kind == "polygon")
        found = buffers([[] if s else w for w, s in zip(walks, same, strict=True)], r)
        return [w if s else (f[0] if f else None) for w, s, f in zip(walks, same, found, strict=True)]

    rings = {"polygon": shape, "line": F.array(shape), "point": F.array(F.array(shape))}[kind]
    return F.when(shape.isNotNull(), _applied(make, POLYGON)(rings, radius.cast("double")))


def offset_curve(of: Column, by: Column, join: str = "mitre") -> Column:
    """A line moved to its left by a distance (to its right by a negative one), as an array of lines: more than one where the middle has no place."""
    return F.when(of.isNotNull(), _applied(lambda shapes, d: offsets([rings[0] for rings in shapes], d, join), f"array<{LINE}>")(F.array(of), by.cast("double")))
