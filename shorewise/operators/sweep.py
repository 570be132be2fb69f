"""The area that objects cover of a region, by a sweep over x.

Edges that the sweep line crosses are kept in order of y. An edge begins and ends at its ends;
two neighbours that will cross have an event in a queue, and change places
there. Between events the covered length is a sum of edges' y with factors -1, 0
and 1, so each edge adds its own trapezoid whenever its factor changes, and only
those near the event are looked at. A pair crosses only from the steeper lower
edge to the steeper upper one, so it changes places once, also where many edges
meet in a point or rounding puts two in the wrong order for a moment.

Where objects crowd, the sweep would meet most edges at every event. There the place is halved
until an object covers it wholly, and its own area counts, or few objects have an edge in it.

Edges are directed: to the right with the inside above. Rings may touch but not cross themselves.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np


def directed(rings: list[np.ndarray]) -> np.ndarray:
    """Edges (ax, ay, bx, by) of a polygon's rings, the exterior counterclockwise and holes clockwise."""
    out = [np.zeros((0, 4))]
    for k, r in enumerate(rings):
        twice = (r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()
        r = r if (twice > 0) == (k == 0) else r[::-1]
        out.append(np.hstack([r[:-1], r[1:]]))
    return np.concatenate(out)


class _Line:
    """The sweep line. Of each edge: where it starts, its slope, what it adds to the depths of objects and region above it."""

    def __init__(self, x: list, y: list, slope: list, end: list, objects: list, own: list, tolerance: float):
        self.x, self.y, self.slope, self.end, self.objects, self.own, self.tolerance = x, y, slope, end, objects, own, tolerance
        n = len(x)
        self.order: list[int] = []
        self.depth, self.inside = [0] * n, [0] * n  # of what is just above the edge
        self.factor, self.since, self.active = [0] * n, [0.0] * n, [False] * n
        self.queue: list[tuple[float, int, int]] = []
        self.area = 0.0

    def at(self, e: int, x: float) -> float:
        return self.y[e] + (x - self.x[e]) * self.slope[e]

    def find(self, e: int, x: float) -> int:
        order, y, low, high = self.order, self.at(e, x), 0, len(self.order)
        while low < high:
            middle = (low + high) // 2
            if self.at(order[middle], x) < y:
                low = middle + 1
            else:
                high = middle
        for k in range(len(order)):  # beside edges at the same place
            if low + k < len(order) and order[low + k] == e:
                return low + k
            if 0 <= low - 1 - k < len(order) and order[low - 1 - k] == e:
                return low - 1 - k
        raise AssertionError("an active edge isn't on the line")

    def place(self, e: int, x: float) -> int:
        """Where a new edge goes: above edges that are lower, or as high and less steep."""
        order, y, slope, low, high = self.order, self.at(e, x), self.slope[e], 0, len(self.order)
        while low < high:
            middle = (low + high) // 2
            other = self.at(order[middle], x)
            if other < y - self.tolerance or (other <= y + self.tolerance and self.slope[order[middle]] <= slope):
                low = middle + 1
            else:
                high = middle
        return low

    def set(self, k: int, x: float) -> None:
        """Depths above and factor of the edge at place k, from those of the edge below."""
        e = self.order[k]
        depth, inside = (self.depth[self.order[k - 1]], self.inside[self.order[k - 1]]) if k else (0, 0)
        self.depth[e], self.inside[e] = depth + self.objects[e], inside + self.own[e]
        factor = (depth > 0 and inside > 0) - (self.depth[e] > 0 and self.inside[e] > 0)
        if factor != self.factor[e]:
            self.flush(e, x)
            self.factor[e] = factor

    def flush(self, e: int, x: float) -> None:
        if self.factor[e] and x > self.since[e]:
            self.area += self.factor[e] * (x - self.since[e]) * (self.at(e, self.since[e]) + self.at(e, x)) / 2
        self.since[e] = x

    def watch(self, k: int, x: float) -> None:
        """An event for the edges at places k and k + 1, if they will cross."""
        if 0 <= k < len(self.order) - 1:
            e, f = self.order[k], self.order[k + 1]
            steeper = self.slope[e] - self.slope[f]
            if steeper > 0:
                at = x + max(0.0, self.at(f, x) - self.at(e, x)) / steeper
                if at < self.end[e] and at < self.end[f]:
                    heappush(self.queue, (at, e, f))

    def cross(self, until: float) -> None:
        while self.queue and self.queue[0][0] <= until:
            x, e, f = heappop(self.queue)
            if not (self.active[e] and self.active[f]):
                continue
            k = self.find(e, x)
            if k + 1 < len(self.order) and self.order[k + 1] == f:
                self.order[k], self.order[k + 1] = f, e
                self.set(k, x)
                self.set(k + 1, x)
                self.watch(k - 1, x)
                self.watch(k + 1, x)

    def change(self, x: float, ends: list[int], starts: list[int]) -> None:
        """Edges that end and start at x; depths between the lowest and the highest of them are worked out anew."""
        low, tail = len(self.order), len(self.order)
        for e in ends:
            k = self.find(e, x)
            self.flush(e, x)
            self.active[e], self.factor[e] = False, 0
            del self.order[k]
            low, tail = min(low, k), min(tail, len(self.order) - k)
        for e in starts:
            k = self.place(e, x)
            self.order.insert(k, e)
            self.active[e], self.since[e] = True, x
            low, tail = min(low, k), min(tail, len(self.order) - k - 1)
        high = len(self.order) - tail
        for k in range(low, high):
            self.set(k, x)
        for k in range(low - 1, high):
            self.watch(k, x)


def covered(own: np.ndarray, others: np.ndarray, low: float = -np.inf, high: float = np.inf) -> float:
    """Area, between x of low and high, of the region with the edges `own` that objects with the edges `others` cover."""
    edges = np.concatenate([own, others])
    kind = np.arange(len(edges)) < len(own)
    if not len(own) or not len(others):
        return 0.0
    low, high = max(low, own[:, ::2].min()), min(high, own[:, ::2].max())
    sign = np.sign(edges[:, 2] - edges[:, 0]).astype(int)
    edges = np.where(sign[:, None] < 0, edges[:, [2, 3, 0, 1]], edges)
    start, end = np.maximum(edges[:, 0], low), np.minimum(edges[:, 2], high)
    use = (start < end) & (sign != 0)
    if not use.any():
        return 0.0
    edges, sign, kind, start, end = edges[use], sign[use], kind[use], start[use], end[use]
    middle = (edges[:, 1].min() + edges[:, 1].max()) / 2  # small numbers lose less
    slope = (edges[:, 3] - edges[:, 1]) / (edges[:, 2] - edges[:, 0])
    size = max(np.abs(edges[:, 1::2] - middle).max(), high - low)
    line = _Line(edges[:, 0].tolist(), (edges[:, 1] - middle).tolist(), slope.tolist(), end.tolist(), np.where(kind, 0, sign).tolist(), np.where(kind, sign, 0).tolist(), 1e-12 * float(size))
    by_start, by_end = np.argsort(start, kind="stable"), np.argsort(end, kind="stable")
    xs = np.unique(np.concatenate([start, end]))
    starts, ends = np.searchsorted(start[by_start], xs, side="right"), np.searchsorted(end[by_end], xs, side="right")
    by_start, by_end, a, b = by_start.tolist(), by_end.tolist(), 0, 0
    for x, n, m in zip(xs.tolist(), starts.tolist(), ends.tolist(), strict=True):
        line.cross(x)
        line.change(x, by_end[b:m], by_start[a:n])
        a, b = n, m
    return line.area


#: Edges up to which a place is swept at once, and how often a place is halved at most.
FEW_EDGES, HALVINGS = 400, 16


def _between(edges: np.ndarray, y0: float, y1: float) -> np.ndarray:
    """Edges cut at two heights, with what is beyond them laid on them: the same area in between, and none beyond."""
    ax, ay, bx, by = edges.T
    rise = np.where(by == ay, 1.0, by - ay)
    at = np.sort(np.stack([np.clip((y0 - ay) / rise, 0, 1), np.clip((y1 - ay) / rise, 0, 1)]), axis=0)
    at = np.where(by == ay, 1.0, at)
    xs = [ax, *(np.where(t >= 1, bx, ax + t * (bx - ax)) for t in at), bx]
    ys = [np.clip(v, y0, y1) for v in (ay, *(np.where(t >= 1, by, ay + t * (by - ay)) for t in at), by)]
    pieces = [np.stack([xs[k], ys[k], xs[k + 1], ys[k + 1]], axis=1) for k in range(3)]
    return np.concatenate([p[p[:, 0] != p[:, 2]] for p in pieces])


def _area_within(edges: np.ndarray, x0: float, x1: float, y0: float, y1: float) -> float:
    """Area of a region within a box."""
    ax, ay, bx, by = _between(edges, y0, y1).T
    run = np.where(ax == bx, 1.0, bx - ax)
    u, v = np.clip(ax, x0, x1), np.clip(bx, x0, x1)
    low, high = ay - y0 + (u - ax) * (by - ay) / run, ay - y0 + (v - ax) * (by - ay) / run
    return float(-((v - u) * (low + high) / 2).sum())


def covered_by(own: np.ndarray, objects: list[np.ndarray], low: float = -np.inf, high: float = np.inf) -> float:
    """Area, between x of low and high, of the region with the edges `own` that objects, each with its edges, cover."""
    edges = np.concatenate([np.zeros((0, 4)), *objects])
    if len(edges) <= FEW_EDGES or not len(own):
        return covered(own, edges, low, high)
    of = np.repeat(np.arange(len(objects)), [len(o) for o in objects])
    own_x, own_y = own[:, ::2], own[:, 1::2]
    places = [(max(low, own_x.min()), min(high, own_x.max()), own_y.min(), own_y.max(), edges, of, 0)]
    area = 0.0
    while places:
        x0, x1, y0, y1, edges, of, depth = places.pop()
        if not (x0 < x1 and y0 < y1):
            continue
        left, right = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
        bottom, top = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
        n = int(of.max()) + 1 if len(of) else 0
        run, rise = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
        side = [run * (v - edges[:, 1]) - rise * (u - edges[:, 0]) for u in (x0, x1) for v in (y0, y1)]
        within = (left < x1) & (right > x0) & (bottom < y1) & (top > y0) & (np.minimum.reduce(side) <= 0) & (np.maximum.reduce(side) >= 0)
        crossing = np.zeros(n, bool)
        crossing[of[within]] = True
        # no edge in the place: all of it is inside or outside, as its middle is
        x, y = (x0 + x1) / 2, (y0 + y1) / 2
        under = (left <= x) & (right > x)
        e = edges[under]
        below = e[:, 1] + (x - e[:, 0]) * (e[:, 3] - e[:, 1]) / np.where(e[:, 2] == e[:, 0], 1.0, e[:, 2] - e[:, 0]) < y
        inside = np.bincount(of[under][below], minlength=n) % 2 == 1
        if (inside & ~crossing).any():
            area += _area_within(own, x0, x1, y0, y1)
            continue
        keep, some = crossing[of], edges[within]
        edges, of = edges[keep], of[keep]
        if len(some) <= FEW_EDGES or depth >= HALVINGS:
            if len(edges):
                area += covered(_between(own, y0, y1), _between(edges, y0, y1), x0, x1)
            continue
        # at the middle one of the ends within, so that edges in one line come to lie between places
        ends = [np.sort(v[(v > a) & (v < b)]) for v, a, b in ((some[:, ::2].ravel(), x0, x1), (some[:, 1::2].ravel(), y0, y1))]
        x, y = (v[len(v) // 2] if len(v) else m for v, m in zip(ends, (x, y), strict=True))
        if (x1 - x0 >= y1 - y0) if bool(len(ends[0])) == bool(len(ends[1])) else len(ends[0]):
            places += [(x0, x, y0, y1, edges, of, depth + 1), (x, x1, y0, y1, edges, of, depth + 1)]
        else:
            places += [(x0, x1, y0, y, edges, of, depth + 1), (x0, x1, y, y1, edges, of, depth + 1)]
    return area
