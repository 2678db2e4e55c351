"""What two polygons have in common, of any shape: not convex, with holes, in several parts.

A polygon is a list of rings under the even-odd rule. A line sweeps upwards over all
ends and crossings of edges; between two stops no edges cross, so the strip falls into
trapezoids between neighbouring edges, of which those inside both polygons count.
Trapezoids between the same two edges are joined upwards to one part.
"""

from __future__ import annotations

from collections.abc import Sequence

Point = tuple[float, float]
Ring = Sequence[Point]
#: x at y1, y1, x at y2, y2 with y1 < y2, and which polygon it bounds.
Edge = tuple[float, float, float, float, int]


def _edges(rings: Sequence[Ring], side: int) -> list[Edge]:
    out = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 != y2:
                out.append((x1, y1, x2, y2, side) if y1 < y2 else (x2, y2, x1, y1, side))
    return out


def _x(e: Edge, y: float) -> float:
    return e[0] if y == e[1] else e[2] if y == e[3] else e[0] + (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1])


def _crossings(edges: list[Edge], low: float, high: float) -> list[float]:
    """Heights at which edges cross; edges are taken in order of their lower ends, each against those that still go on."""
    out, going = [], []
    for e in sorted(edges, key=lambda e: e[1]):
        going = [f for f in going if f[3] > e[1]]
        for f in going:
            a, b = max(e[1], low), min(e[3], f[3], high)
            if a < b:
                d, g = _x(e, a) - _x(f, a), _x(e, b) - _x(f, b)
                if d * g < 0:
                    out.append(a + (b - a) * d / (d - g))
        going.append(e)
    return out


def common(a: Sequence[Ring], b: Sequence[Ring]) -> tuple[float, list[list[Point]]]:
    """(area, parts as closed rings) of what two polygons have in common; what has no area, as an edge in common, is no part."""
    if not any(a) or not any(b):
        return 0.0, []
    low = max(min(y for r in p for _, y in r) for p in (a, b))
    high = min(max(y for r in p for _, y in r) for p in (a, b))
    right = min(max(x for r in p for x, _ in r) for p in (a, b))
    if not low < high:
        return 0.0, []
    # edges right of both polygons' common box bound nothing in it; those left of it do
    edges = [e for e in _edges(a, 0) + _edges(b, 1) if e[3] > low and e[1] < high and min(e[0], e[2]) <= right]
    stops = sorted({low, high, *(y for e in edges for y in (e[1], e[3]) if low < y < high), *_crossings(edges, low, high)})
    area, parts, open_ = 0.0, [], {}
    waiting = sorted(edges, key=lambda e: -e[1])
    active: list[Edge] = []
    for y0, y1 in zip(stops, stops[1:], strict=False):
        middle = (y0 + y1) / 2
        while waiting and waiting[-1][1] <= y0:
            active.append(waiting.pop())
        active = [e for e in active if e[3] >= y1]
        inside, left, going = [False, False], None, {}
        for e in sorted((e for e in active if e[1] <= y0), key=lambda e: _x(e, middle)):
            was = all(inside)
            inside[e[4]] = not inside[e[4]]
            if all(inside):
                left = e
            elif was:
                w0, w1 = _x(e, y0) - _x(left, y0), _x(e, y1) - _x(left, y1)
                if w0 + w1 > 0:
                    area += (w0 + w1) / 2 * (y1 - y0)
                    going[left, e] = open_.pop((left, e), y0)
        parts += [_part(k, y, y0) for k, y in open_.items()]
        open_ = going
    parts += [_part(k, y, stops[-1]) for k, y in open_.items()]
    return area, parts


def _part(between: tuple[Edge, Edge], y0: float, y1: float) -> list[Point]:
    (left, right), ring = between, []
    for e, y in ((left, y0), (right, y0), (right, y1), (left, y1)):
        p = (_x(e, y), y)
        if not ring or ring[-1] != p:
            ring.append(p)
    return ring + ring[:1] if ring[0] != ring[-1] else ring


def area(rings: Sequence[Ring]) -> float:
    """The area of a polygon under the even-odd rule."""
    return common(rings, rings)[0]
