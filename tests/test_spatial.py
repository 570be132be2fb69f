"""The sample-built tree: every pair of boxes that meet once, and few rows for skewed layers."""

import random

import numpy as np
import pytest

from shorewise.operators import spatial

BOXES = "id long, box struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def side(spark, boxes, name):
    return spark.createDataFrame([(i, tuple(map(float, b))) for i, b in enumerate(boxes)], BOXES).withColumnsRenamed({"id": f"{name}_id", "box": f"__{name}"})


def meeting(a, b):
    a, b = np.array(a, float), np.array(b, float)
    m = (a[:, None, :2] <= b[None, :, 2:]).all(axis=2) & (b[None, :, :2] <= a[:, None, 2:]).all(axis=2)
    return sorted(zip(*map(list, np.nonzero(m)), strict=True))


def around(x, y, w, h=None):
    return (x, y, x + w, y + (w if h is None else h))


def skewed(n, rng):
    """Nine tenths of the boxes in a hundredth of the area, a few of every size."""
    out = []
    for k in range(n):
        x, y = (rng.uniform(0, 10), rng.uniform(0, 10)) if k % 10 else (rng.uniform(0, 100), rng.uniform(0, 100))
        out.append(around(x, y, rng.choice([0.001, 0.01, 0.05])))
    return out


def crowds(rng):
    big = [around(-1, -1, 102), around(3, 3, 60), around(0, 0, 5, 100)]
    many = [around(rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([0.0, 1.0, 7.0])) for _ in range(300)]
    same = [around(5, 5, 0.0)] * 80
    grid = [around(x, y, 1.0) for x in range(20) for y in range(20)]
    return {"skew": skewed(900, rng), "sizes": big + many, "same place": same + many[:20], "touching": grid, "one": [around(4, 4, 2)], "line": [around(x / 7, 3, 0.0) for x in range(500)]}


@pytest.mark.parametrize("leaves", [1, 8, 256])
def test_pairs_as_by_hand(spark, leaves):
    named = crowds(random.Random(4))
    for one, other in (("skew", "sizes"), ("sizes", "skew"), ("same place", "sizes"), ("touching", "touching"), ("one", "line"), ("line", "sizes")):
        a, b = side(spark, named[one], "a"), side(spark, named[other], "b")
        got = sorted((r.a_id, r.b_id) for r in spatial.box_pairs(a, b, leaves=leaves, crowd=4).select("a_id", "b_id").collect())
        assert got == meeting(named[one], named[other]), (one, other)


def test_boxes_that_are_not_finite(spark):
    odd = [around(1, 1, 2), (float("nan"), 0, 1, 1), (-float("inf"), 0, float("inf"), 5), (2, 2, 2, float("inf"))] + [around(k, k, 1) for k in range(40)]
    a, b = side(spark, odd, "a"), side(spark, [around(k / 4, k / 4, 1) for k in range(90)], "b")
    got = sorted((r.a_id, r.b_id) for r in spatial.box_pairs(a, b, crowd=4).collect())
    assert got == meeting(odd, [around(k / 4, k / 4, 1) for k in range(90)])


def test_empty_sides(spark):
    a, b = side(spark, [around(0, 0, 1)], "a"), side(spark, [around(0, 0, 1)], "b")
    assert spatial.box_pairs(a, b.where("false")).count() == 0 and spatial.box_pairs(a.where("false"), b).count() == 0


def test_few_rows_on_a_skewed_layer(spark):
    """At most four rows a box, also with regions as large as the layer, and few boxes a cell where they crowd."""
    rng = random.Random(9)
    regions = [around(0, 0, 100), around(0, 0, 40), *[around(rng.uniform(0, 95), rng.uniform(0, 95), rng.choice([0.5, 2, 5])) for _ in range(400)]]
    objects = skewed(20_000, rng)
    a, b = side(spark, regions, "a"), side(spark, objects, "b")
    sides = [spatial.sampled(a, "__a"), spatial.sampled(b, "__b", 5000)]
    tree = spatial.tree_of(sides)
    at_home = [spatial.homes_in(tree, s) for s in sides]
    assert spatial.cell_rows(a, tree, "__a", at_home[1]).count() <= 4 * len(regions)
    rows = spatial.cell_rows(b, tree, "__b", at_home[0])
    assert rows.count() <= 4 * len(objects)
    homes = rows.where("array_contains(__homes, __cell)").groupBy("__cell").count()
    assert homes.agg({"count": "max"}).first()[0] <= 20 * spatial.CROWD
