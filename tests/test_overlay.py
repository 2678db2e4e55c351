"""Overlay of polygons against grids of points and sums of boxes."""

import math
import random

import pytest

from fieldcube.functions import overlay
from fieldcube.operators import spatial


def inside(rings, x, y):
    hit = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
    return hit


def star(pick, x, y, r, n):
    """A ring that isn't convex around a place."""
    return [(x + r * pick.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * pick.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def polygon(pick):
    """Up to two stars, the first perhaps with a hole."""
    x, y = pick.uniform(-1, 1), pick.uniform(-1, 1)
    out = [star(pick, x, y, 2.0, pick.randint(3, 12))]
    if pick.random() < 0.5:
        out.append([(x + dx * 0.2, y + dy * 0.2) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    if pick.random() < 0.5:
        out.append(star(pick, x + 6, y, 1.5, pick.randint(3, 7)))
    return out


def test_areas_against_a_grid():
    pick = random.Random(1)
    for _ in range(40):
        a, b = polygon(pick), polygon(pick)
        step = 0.05
        marks = [(-4 + step * (i + 0.5), -4 + step * (j + 0.5)) for i in range(260) for j in range(160)]
        hits = [p for p in marks if inside(a, *p) and inside(b, *p)]
        found, parts = overlay.common(a, b)
        assert found == pytest.approx(len(hits) * step * step, abs=0.15)
        assert found == pytest.approx(overlay.common(b, a)[0], abs=1e-9)
        assert sum(overlay.area([p]) for p in parts) == pytest.approx(found, abs=1e-9)  # parts don't overlap
        for p in hits[::97]:
            near = any(abs((x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)) < 1e-9 for r in parts for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False))
            assert near or sum(inside([r], *p) for r in parts) == 1


def test_boxes_exactly():
    pick = random.Random(2)
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    for _ in range(300):
        a, b = ([pick.randint(0, 6), pick.randint(0, 6)] for _ in "ab")
        a += [a[0] + pick.randint(1, 5), a[1] + pick.randint(1, 5)]
        b += [b[0] + pick.randint(1, 5), b[1] + pick.randint(1, 5)]
        expected = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        found, parts = overlay.common([box(*a)], [box(*b)])
        assert found == expected and len(parts) == (expected > 0)
        if expected:
            assert sorted(set(parts[0])) == sorted(box(max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))


def test_odd_polygons():
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]]
    assert overlay.common([], square) == (0.0, []) and overlay.common([[]], square) == (0.0, [])
    assert overlay.common([[(0.0, 2.0), (2.0, 2.0), (1.0, 3.0)]], square)[0] == 0.0  # an edge in common
    assert overlay.common([[(0.0, 0.0), (1.0, 1.0)]], square)[0] == 0.0
    bow = [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]]  # crosses itself
    assert overlay.common(bow, square)[0] == pytest.approx(2.0)
    assert overlay.area([square[0], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]]) == pytest.approx(3.0)
    assert overlay.common(square, [[*square[0], square[0][0]]])[0] == pytest.approx(4.0)


def test_pairs_once(spark):
    kind = "array<array<struct<px: double, py: double>>>"
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    a = spark.createDataFrame([(1, [box(0.0, 0.0, 20.0, 20.0), box(5.0, 5.0, 15.0, 15.0)]), (2, []), (3, [box(-5.0, -5.0, -1.0, -1.0)]), (4, None)], f"id long, rings {kind}")
    b = spark.createDataFrame([(7, [box(-2.0, -2.0, 6.0, 6.0), box(18.0, 18.0, 30.0, 30.0)]), (8, [box(6.0, 6.0, 14.0, 14.0)])], f"area_id long, rings {kind}")
    got = {(r.id, r.area_id): (r.area, len(r.parts)) for r in spatial.overlay(a, b, 1.5).collect()}
    assert {k: round(v, 9) for k, (v, _) in got.items()} == {(1, 7): 39.0, (3, 7): 1.0}
    assert spatial.overlay(a, b, 1.5).count() == 2 == spatial.overlay(a, b, 100.0).count()
