"""Which of very many line segments may be the nearest, by branch and bound over nested grids.

Segments are cut into pieces no longer than a leaf cell, and each piece lies in the
cell of its middle. Cells of a level are FAN x FAN of the level below. From the at
most four top cells down, each box meets the occupied cells within those that are
still open for it (an equi-join by the cell above), and a cell stays open if its least
distance doesn't exceed the smallest of the greatest distances. Few cells per box
stay open on each level, however many segments there are, so neither all pairs are
made nor is anything but sums over all segments and the top cells on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorewise.functions import geometry as G

FAN_BITS = 2
BOX = ["xmin", "ymin", "xmax", "ymax"]


def segments_of(lines: DataFrame, order: str = "line_ord", line: str = "line") -> DataFrame:
    """One row per segment: o (the line's order), i (its place in the line), ax, ay, bx, by. A line of one point is a segment without length."""
    whole = F.when(F.size(line) == 1, F.concat(line, line)).otherwise(F.col(line))
    return lines.select(F.col(order).alias("o"), F.posexplode(G.segments(whole)).alias("i", "s")).select("o", "i", "s.*")


def _grid(segments: DataFrame) -> tuple[float, int]:
    """Leaf size and number of levels above the leaves: about one segment a cell, pieces at most three times the segments."""
    xs, ys = [F.least("ax", "bx"), F.greatest("ax", "bx")], [F.least("ay", "by"), F.greatest("ay", "by")]
    ends = [f(c).alias(n) for n, f, c in (("x0", F.min, xs[0]), ("x1", F.max, xs[1]), ("y0", F.min, ys[0]), ("y1", F.max, ys[1]))]
    s = segments.agg(F.count(F.lit(1)).alias("n"), F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("mean"), *ends).first()
    wide, high = s.x1 - s.x0, s.y1 - s.y0
    extent = max(wide, high)
    size = max(math.sqrt(wide * high / s.n), s.mean / 2, extent / 2**20) or 1.0
    return size, max(0, math.ceil(math.log2(max(extent, size) / size) / FAN_BITS))


def _pieces(segments: DataFrame, size: float) -> DataFrame:
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.greatest(F.lit(1), F.ceil(F.hypot(dx, dy) / size)).cast("int")
    rows = segments.select("*", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("k"))
    at = (F.col("k") - 0.5) / F.col("n")
    cell = lambda a, d: F.floor((F.col(a) + at * d) / size).cast("long")
    return rows.select("o", "i", "ax", "ay", "bx", "by", cell("ax", dx).alias("cx"), cell("ay", dy).alias("cy")).distinct()


def _open(rows: DataFrame, side: float, reach: float) -> DataFrame:
    """Pairs of a box and a cell (cx, cy; its sides that long) that stay: pieces end at most `reach` outside their cell."""
    low, high = {}, {}
    for c, a in (("cx", "x"), ("cy", "y")):
        start, end = F.col(c) * F.lit(side), (F.col(c) + 1) * F.lit(side)
        low[a] = F.greatest(F.lit(0.0), start - F.col(f"{a}max"), F.col(f"{a}min") - end)
        high[a] = F.greatest(F.abs(end - F.col(f"{a}min")), F.abs(F.col(f"{a}max") - start))
    rows = rows.withColumn("least", F.hypot(low["x"], low["y"]) - reach).withColumn("most", F.hypot(high["x"], high["y"]) + reach * 1e-3)
    bound = F.min("most").over(Window.partitionBy(*BOX))
    return rows.withColumn("bound", bound).where("least <= bound * (1 + 1e-9)").drop("least", "most", "bound")


def near_segments(boxes: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct boxes (BOX) with the segments that may be nearest to anything that fills them; there must be segments. Boxes that aren't finite have none."""
    size, levels = _grid(segments)
    pieces, reach = _pieces(segments, size), size * (0.5 + 1e-6)

    def cells(level: int) -> DataFrame:
        """Occupied cells of a level as cx, cy, with the cell above as px, py."""
        at = lambda c, up: F.shiftright(c, FAN_BITS * (level + up))
        return leaves.select(*[at(c, 0).alias(c) for c in ("cx", "cy")], at("cx", 1).alias("px"), at("cy", 1).alias("py")).distinct()

    leaves = pieces.select("cx", "cy").distinct()
    finite = F.lit(True)
    for c in BOX:
        finite = finite & (F.abs(F.col(c)) < F.lit(float("inf")))
    top = F.array(*[F.struct(F.lit(r.cx).cast("long").alias("cx"), F.lit(r.cy).cast("long").alias("cy")) for r in cells(levels).collect()])
    rows = boxes.select(*[F.col(c).cast("double") for c in BOX]).where(finite).distinct().select(*BOX, F.inline(top))
    rows = _open(rows, size * 2.0 ** (FAN_BITS * levels), reach)
    for level in range(levels - 1, -1, -1):
        rows = rows.withColumnsRenamed({"cx": "px", "cy": "py"}).join(cells(level), ["px", "py"]).select(*BOX, "cx", "cy")
        rows = _open(rows, size * 2.0 ** (FAN_BITS * level), reach)
    return rows.join(pieces, ["cx", "cy"]).drop("cx", "cy")


def _foot() -> tuple[Column, Column, Column]:
    """Squared distance of the point (xmin, ymin) from its segment, and the place on it."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = F.try_divide((F.col("xmin") - F.col("ax")) * dx + (F.col("ymin") - F.col("ay")) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    fx, fy = F.col("ax") + t * dx, F.col("ay") + t * dy
    return (fx - F.col("xmin")) ** 2 + (fy - F.col("ymin")) ** 2, fx, fy


def nearest_of_points(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Of distinct points (px, py): o of the nearest segment (the first of equally near ones), distance, nx and ny."""
    boxes = points.select(F.col("px").alias("xmin"), F.col("py").alias("ymin"), F.col("px").alias("xmax"), F.col("py").alias("ymax"))
    d2, fx, fy = _foot()
    near = near_segments(boxes, segments).select("xmin", "ymin", F.struct(d2.alias("d2"), F.col("o"), F.col("i"), fx.alias("x"), fy.alias("y")).alias("s"))
    best = near.groupBy("xmin", "ymin").agg(F.min("s").alias("s"))
    return best.select(F.col("xmin").alias("px"), F.col("ymin").alias("py"), F.col("s.o").cast("long").alias("o"), F.sqrt("s.d2").alias("distance"), F.col("s.x").alias("nx"), F.col("s.y").alias("ny"))


def nearest_of_regions(regions: DataFrame, lines: DataFrame, segments: DataFrame, order: str = "line_ord", line: str = "line") -> DataFrame:
    """Of distinct polygons: line_ord and line of the nearest line (the first of equally near ones) and line_distance."""
    shapes = regions.select("polygon", G.bounds(F.col("polygon")).alias("box")).where("box.xmin IS NOT NULL").distinct()
    shapes = shapes.select("polygon", *[F.col(f"box.{c}").cast("double").alias(c) for c in BOX])
    near = near_segments(shapes.select(*BOX), segments).select(*BOX, "o").distinct()
    whole = lines.select(F.col(order).alias("o"), F.col(line).alias("l"))
    pairs = shapes.join(near, BOX).join(whole, "o").withColumn("d", G.polygon_line_distance(F.col("polygon"), F.col("l")))
    best = pairs.where("d IS NOT NULL").groupBy("polygon").agg(F.min(F.struct("d", "o", "l")).alias("s"))
    return best.select("polygon", F.col("s.o").alias("line_ord"), F.col("s.l").alias("line"), F.col("s.d").alias("line_distance"))
