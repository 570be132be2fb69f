"""Cells for spatial joins: a k-d tree of a sample of the boxes.

The tree's leaves hold about equally many boxes, wherever these crowd, and a leaf is
cut again into a grid of as many cells as its share of all boxes needs. Both are
worked out from one bounded sample, so the tree is small and travels with the tasks. A box lies in
the grid cells that it meets if these are at most FEW; else in the leaves, else in
the nodes of the middle level, and else in the root. That is its home, at most
FEW rows. Two boxes of different levels meet because the one of the lower level also has a
row in each node above its home in which the other side has a box at home. These
nodes are few and known (the tree has at most LEAVES leaves), so no side makes rows that can't meet.

A pair is made in one place only: the first of the cells that both have, with one of them at home.

Boxes beyond all of the other side are left out first. A cell in which one side has more than
KEY_ROWS rows, as the sample tells, is dealt over several keys, each with a share of
these rows and all of the other side's, so that no task gets a whole crowd.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Boxes that the tree is built of (per side), its leaves, boxes that a cell should hold, and cells of a box's home.
SAMPLE, LEAVES, CROWD, FEW = 10_000, 1024, 64, 4
#: Rows of one side that a key of the join should hold.
KEY_ROWS = 20_000
BOX = ["xmin", "ymin", "xmax", "ymax"]
_GRID_BITS, _MIDDLE = 20, 5


@dataclass
class SpatialTree:
    """Nodes as in a heap: 1 is the root, those below n are 2n and 2n + 1. All leaves are `depth` below the root.

    axis and at tell where a node is cut; low and high are the leaves' corners, and cells how many columns and rows each leaf's grid has.
    """

    depth: int
    axis: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cells: np.ndarray

    def cell_of(self, leaf: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column and row in the leaf's grid."""
        n, k = self.cells[leaf], leaf - 2**self.depth
        spot = lambda v, a: np.clip(np.floor((v - self.low[k, a]) / (self.high[k, a] - self.low[k, a]) * n), 0, n - 1).astype(np.int64)
        return spot(x, 0), spot(y, 1)


def _numbered(leaf: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """A positive number for each grid cell; nodes have negative ones."""
    return (leaf << 2 * _GRID_BITS) | (cy << _GRID_BITS) | cx


def build(boxes: np.ndarray, total: int, *, leaves: int = LEAVES, crowd: int = CROWD) -> SpatialTree:
    """The tree of sampled boxes (rows of xmin, ymin, xmax, ymax) that stand for `total`."""
    x = np.stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2], axis=1)
    wanted = max(1, min(leaves, len(x) // 8, -(-total // crowd)))
    depth = int(np.log2(wanted))
    axis, at = np.zeros(2**depth, np.int8), np.zeros(2**depth)
    low, high, cells = [], [], np.ones(2 ** (depth + 1), np.int64)
    parts = [(x, boxes[:, :2].min(axis=0), boxes[:, 2:].max(axis=0))]
    for level in range(depth):
        below = []
        for k, (p, a, b) in enumerate(parts):
            node = 2**level + k
            spread = np.ptp(p, axis=0) if len(p) else b - a
            d = int(spread[1] > spread[0])
            cut = np.median(p[:, d]) if len(p) else (a[d] + b[d]) / 2
            if len(p) and cut == p[:, d].min():  # more than half lie in one place: cut behind it
                above = p[:, d][p[:, d] > cut]
                cut = above.min() if len(above) else cut
            axis[node], at[node] = d, cut
            right, inner, outer = p[:, d] >= cut, a.copy(), b.copy()
            inner[d] = outer[d] = min(max(cut, a[d]), b[d])
            below += [(p[~right], a, outer), (p[right], inner, b)]
        parts = below
    for k, (p, a, b) in enumerate(parts):
        low.append(a)
        high.append(np.where(b > a, b, a + 1.0))
        cells[2**depth + k] = min(2**_GRID_BITS - 1, max(1, int(np.ceil(np.sqrt(len(p) / max(len(x), 1) * total / crowd)))))
    return SpatialTree(depth, axis, at, np.array(low), np.array(high), cells)


def _met(tree: SpatialTree, boxes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (box, node) of the nodes at a depth that boxes meet, for those that meet at most FEW; and which boxes those are."""
    box, node, few = np.arange(len(boxes)), np.ones(len(boxes), np.int64), np.ones(len(boxes), bool)
    for _ in range(depth):
        d, cut = tree.axis[node], tree.at[node]
        left, right = boxes[box, d] < cut, boxes[box, d + 2] >= cut
        box, node = np.concatenate([box[left], box[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        few &= np.bincount(box, minlength=len(boxes)) <= FEW
        box, node = box[few[box]], node[few[box]]
    return box, node, few


def homes(tree: SpatialTree, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (box, cell) of the boxes' homes, and of each pair the node that is at home or the leaf around the grid cell."""
    out = []
    leaf_box, leaf, few = _met(tree, boxes, tree.depth)
    own = boxes[leaf_box]
    x0, y0 = tree.cell_of(leaf, own[:, 0], own[:, 1])
    x1, y1 = tree.cell_of(leaf, own[:, 2], own[:, 3])
    n = (x1 - x0 + 1) * (y1 - y0 + 1)
    fine = few & (np.bincount(leaf_box, weights=n, minlength=len(boxes)) <= FEW)
    use = fine[leaf_box]
    pair = np.repeat(np.flatnonzero(use), n[use])
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n[use]) - n[use], n[use])
    wide = (x1 - x0 + 1)[pair]
    out.append((leaf_box[pair], _numbered(leaf[pair], x0[pair] + k % wide, y0[pair] + k // wide), leaf[pair]))
    use = few[leaf_box] & ~fine[leaf_box]
    out.append((leaf_box[use], -leaf[use], leaf[use]))
    left = np.flatnonzero(~few)
    middle = min(_MIDDLE, tree.depth)
    box, node, some = _met(tree, boxes[left], middle)
    out.append((left[box], -node, node))
    root = left[~some]
    out.append((root, np.full(len(root), -1, np.int64), np.ones(len(root), np.int64)))
    box, cell, node = (np.concatenate(c) for c in zip(*out, strict=True))
    return box, cell, node


def above(tree: SpatialTree, cell: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """Cells of the upper levels over each home, 0 where there is none."""
    depth = np.floor(np.log2(node)).astype(np.int64)
    middle = min(_MIDDLE, tree.depth)
    out = [np.where(cell > 0, -node, 0)] if tree.depth > middle else []
    out.append(np.where((cell > 0) | (depth > middle), -(node >> np.maximum(depth - middle, 0)), 0))
    if middle:
        out.append(np.where((cell > 0) | (depth > 0), -1, 0))
    return out


def cells_of(tree: SpatialTree, meets: np.ndarray, box: Column) -> Column:
    """The cells of a box: homes, and those of the nodes in `meets` that are above them as ups. Boxes with NaN have none."""

    def lists(row: np.ndarray, cell: np.ndarray, n: int) -> pa.ListArray:
        order = np.argsort(row, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell[order]))

    @F.arrow_udf("struct<homes: array<bigint>, ups: array<bigint>>")
    def f(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        boxes = np.stack([v.to_numpy(zero_copy_only=False).astype(np.float64) for v in (a, b, c, d)], axis=1)
        row, cell, node = homes(tree, boxes)
        pairs = [np.zeros((0, 2), np.int64)]
        for up in above(tree, cell, node):
            use = np.isin(up, meets)
            pairs.append(np.unique(np.stack([row[use], up[use]], axis=1), axis=0))
        ups = np.concatenate(pairs)
        return pa.StructArray.from_arrays([lists(row, cell, len(boxes)), lists(ups[:, 0], ups[:, 1], len(boxes))], names=["homes", "ups"])

    return f(*[box[c] for c in BOX])


@dataclass
class Side:
    """Boxes of one side of a join: a sample, how many there are, and the box around all."""

    df: DataFrame
    box: str
    sample: np.ndarray
    n: int
    extent: tuple = ()


def sampled(df: DataFrame, box: str, sample: int = SAMPLE) -> Side:
    """Some boxes and the number of all, in one pass; those that aren't finite aren't sampled."""
    seen = Observation()
    ends = [(F.min if c.endswith("min") else F.max)(c).alias(c) for c in BOX]
    rows = df.select(f"{box}.*").observe(seen, F.count(F.lit(1)).alias("n"), *ends).orderBy(F.rand(7)).limit(sample).toPandas()
    boxes = rows[BOX].to_numpy(float).reshape(-1, 4)
    return Side(df, box, boxes[np.isfinite(boxes).all(axis=1)], seen.get.get("n", 0), tuple(seen.get.get(c) for c in BOX))


def near(side: Side, extent: tuple) -> Side:
    """The side without boxes that don't meet the extent; sampled anew if that leaves less than half of the sample."""
    xmin, ymin, xmax, ymax = extent
    b = F.col(side.box)
    rows = side.df.where((b["xmin"] <= F.lit(xmax)) & (b["ymin"] <= F.lit(ymax)) & (b["xmax"] >= F.lit(xmin)) & (b["ymax"] >= F.lit(ymin)))
    s = side.sample
    out = (s[:, 0] > xmax) | (s[:, 1] > ymax) | (s[:, 2] < xmin) | (s[:, 3] < ymin)
    if not out.any():
        return Side(rows, side.box, s, side.n, side.extent)
    if side.n <= SAMPLE:  # the sample is all
        return Side(rows, side.box, s[~out], side.n - int(out.sum()), side.extent)
    if 2 * out.sum() > len(s):
        return sampled(rows, side.box)
    return Side(rows, side.box, s[~out], round(side.n * float((~out).mean())), side.extent)


def tree_of(sides: list[Side], **options) -> SpatialTree | None:
    """The tree of the boxes of several sides; None if any has none."""
    if not all(len(s.sample) for s in sides):
        return None
    # the side of more boxes gives more of them: each sampled box stands for as many
    most = max(s.n / len(s.sample) for s in sides)
    boxes = np.concatenate([s.sample[: max(1, round(s.n / most))] for s in sides])
    return build(boxes, sum(s.n for s in sides), **options)


def homes_in(tree: SpatialTree, side: Side) -> tuple[np.ndarray, bool]:
    """Nodes in which boxes are at home, and whether any is in a grid cell: at most as many numbers as the tree has nodes."""
    if len(side.sample) == side.n:  # the sample is all
        found = np.unique(np.minimum(homes(tree, side.sample)[1], 1))
    else:
        homes_only = cells_of(tree, np.zeros(0, np.int64), F.col(side.box))
        rows = side.df.select(homes_only.alias("c")).select(F.explode("c.homes").alias("cell")).select(F.least("cell", F.lit(1)).alias("cell")).distinct()
        found = np.array([r.cell for r in rows.collect()], np.int64)
    return found[found < 0], bool((found > 0).any())


def cell_rows(df: DataFrame, tree: SpatialTree, box: str, other: tuple[np.ndarray, bool]) -> DataFrame:
    """df with __homes, __ups and a row for each __cell in which the other side, whose homes are given, can have a row too."""
    nodes, fine = other
    rows = df.withColumn("__c", cells_of(tree, nodes, F.col(box))).select("*", F.col("__c.homes").alias("__homes"), F.col("__c.ups").alias("__ups"))
    rows = rows.select("*", F.explode(F.concat("__homes", "__ups")).alias("__cell")).drop("__c")
    return rows if fine else rows.where("__cell < 0")


def crowds(tree: SpatialTree, side: Side, other: tuple[np.ndarray, bool], key_rows: int) -> dict[int, int]:
    """Over how many keys to deal the side's rows in cells where it has more than key_rows, as its sample tells."""
    if not len(side.sample):
        return {}
    row, cell, node = homes(tree, side.sample)
    pairs = [np.stack([row, cell], axis=1)]
    for up in above(tree, cell, node):
        use = np.isin(up, other[0])
        pairs.append(np.unique(np.stack([row[use], up[use]], axis=1), axis=0))
    cells, n = np.unique(np.concatenate(pairs)[:, 1], return_counts=True)
    keys = np.ceil(n * (side.n / len(side.sample)) / key_rows).astype(int)
    return {int(c): int(k) for c, k in zip(cells[keys > 1], keys[keys > 1], strict=True)}


def dealt(rows: DataFrame, keys: DataFrame, own: str, other: str, by: list[str]) -> DataFrame:
    """rows with their share of their cell's keys, by a hash of the columns `by`, and a row for each share of the other side."""
    shares = rows.join(F.broadcast(keys), "__cell", "left")
    share = F.pmod(F.xxhash64(*by), F.coalesce(F.col(own), F.lit(1)))
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
    return shares.select(*rows.columns, share.cast("int").alias(f"{own}_share"), every.alias(f"{other}_share"))


def box_pairs(a: DataFrame, b: DataFrame, a_box: str = "__a", b_box: str = "__b", key_rows: int = KEY_ROWS, **options) -> DataFrame:
    """Pairs of rows whose boxes have a point in common, each once."""
    sides = [sampled(a, a_box), sampled(b, b_box)]
    if all(s.n for s in sides):
        sides = [near(sides[0], sides[1].extent), near(sides[1], sides[0].extent)]
    a, b = (s.df for s in sides)
    tree = tree_of(sides, **options)
    if tree is None and not all(s.n for s in sides):
        return a.join(b, F.lit(False))
    tree = tree or build(np.zeros((1, 4)), 1)
    at_home = [homes_in(tree, s) for s in sides]
    left, right = cell_rows(a, tree, a_box, at_home[1]), cell_rows(b, tree, b_box, at_home[0])
    right = right.withColumnsRenamed({"__homes": "__homes_b", "__ups": "__ups_b"})
    c = {n: (F.col(f"{a_box}.{n}"), F.col(f"{b_box}.{n}")) for n in BOX}
    meet = (c["xmin"][0] <= c["xmax"][1]) & (c["xmin"][1] <= c["xmax"][0]) & (c["ymin"][0] <= c["ymax"][1]) & (c["ymin"][1] <= c["ymax"][0])
    # of the cells in which both have a row, and one is at home, the first
    single = (F.size("__homes") == 1) & (F.size("__homes_b") == 1) & (F.array_contains("__homes", F.col("__cell")) | F.array_contains("__homes_b", F.col("__cell")))
    shared = F.array_union(F.array_intersect("__homes", F.concat("__homes_b", "__ups_b")), F.array_intersect("__ups", "__homes_b"))
    first = F.when(single, True).otherwise(F.col("__cell") == F.array_min(shared))
    dealt_over = [crowds(tree, s, other, key_rows) for s, other in zip(sides, at_home[::-1], strict=True)]
    if not any(dealt_over):
        return left.join(right, "__cell").where(meet & first).drop("__cell", "__homes", "__ups", "__homes_b", "__ups_b")
    rows = [(c, dealt_over[0].get(c, 1), dealt_over[1].get(c, 1)) for c in dealt_over[0].keys() | dealt_over[1].keys()]
    keys = a.sparkSession.createDataFrame(rows, "__cell long, __left int, __right int")
    plain = lambda df: [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    left = dealt(left, keys, "__left", "__right", plain(a))
    right = dealt(right, keys, "__right", "__left", plain(b))
    return left.join(right, ["__cell", "__left_share", "__right_share"]).where(meet & first).drop("__cell", "__left_share", "__right_share", "__homes", "__ups", "__homes_b", "__ups_b")
