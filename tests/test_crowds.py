"""Coverage where objects crowd."""

import random
import time

import numpy as np
import pytest

from shorewise.operators import sweep


def box(x, y, w, h):
    return sweep.directed([np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float)])


def star(rng, x, y, r):
    k = rng.randint(3, 9)
    at = [(x + r * (1 if j % 2 else 0.4) * np.cos(j * np.pi / k), y + r * (1 if j % 2 else 0.4) * np.sin(j * np.pi / k)) for j in range(2 * k)]
    return sweep.directed([np.array([*at, at[0]])])


@pytest.mark.parametrize("seed", range(6))
def test_halved_places_as_one_sweep(monkeypatch, seed):
    rng = random.Random(seed)
    own = [star(rng, 10, 10, 9), box(0, 0, 20, 20), sweep.directed([np.array(r, float) for r in ([(0, 0), (20, 3), (18, 20), (1, 17), (0, 0)], [(6, 6), (6, 9), (12, 9), (12, 6), (6, 6)])])][seed % 3]
    objects = [star(rng, rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0.5, 4)) for _ in range(25)] + [box(rng.randint(0, 18), rng.randint(0, 18), rng.randint(1, 6), rng.randint(1, 4)) for _ in range(12)]
    low, high = (-np.inf, np.inf) if seed < 3 else (4.0, 13.5)
    want = sweep.covered(own, np.concatenate(objects), low, high)
    monkeypatch.setattr(sweep, "FEW_EDGES", 30)
    assert sweep.covered_by(own, objects, low, high) == pytest.approx(want, rel=1e-9)


def test_a_crowd_of_twenty_thousand_wide_boxes():
    """Objects over half the region each: one sweep would meet most of them at every event."""
    rng = random.Random(1)
    objects = [box(rng.uniform(-20, 50), rng.uniform(-10, 110), rng.uniform(10, 50), rng.uniform(5, 25)) for _ in range(20_000)]
    begin = time.perf_counter()
    assert sweep.covered_by(box(0, 0, 50, 110), objects) == pytest.approx(5500)
    assert time.perf_counter() - begin < 10
