"""Geometry on rings, as column expressions.

A ring is an array of structs (px, py), its first point repeated at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]
EARTH_RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
#: Longest literal ring that becomes one flat expression instead of a loop over an array.
FLAT = 64


def ring_literal(points: Sequence[Point]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("px"), F.lit(float(y)).alias("py")) for x, y in points])


def _crosses(x: Column, y: Column, x1, y1, x2, y2) -> Column:
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def in_ring(x: Column, y: Column, ring: Column | Sequence[Point]) -> Column:
    """Even-odd rule: whether a point lies in a ring, a column or literal points."""
    if not isinstance(ring, Column):
        if len(ring) <= FLAT:
            lit = lambda v: F.lit(float(v))
            hits = [F.coalesce(_crosses(x, y, lit(a[0]), lit(a[1]), lit(b[0]), lit(b[1])), F.lit(False)).cast("int") for a, b in zip(ring, ring[1:], strict=False)]
            return sum(hits, F.lit(0)) % 2 == 1
        ring = ring_literal(ring)
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.coalesce(_crosses(x, y, a["px"], a["py"], b["px"], b["py"]), F.lit(False)))
    return F.aggregate(edges, F.lit(False), lambda acc, hit: acc != hit)


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings, so that holes count out; rings: array of rings."""
    return F.aggregate(F.transform(rings, lambda r: in_ring(x, y, r)), F.lit(False), lambda acc, hit: acc != hit)


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y)."""
    xs, ys = F.transform(ring, lambda p: p["px"]), F.transform(ring, lambda p: p["py"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def centroid(ring: Column) -> Column:
    """Struct (x, y) of the area's centroid, by the shoelace formula about the first point."""
    x0, y0 = ring[0]["px"], ring[0]["py"]
    parts = F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
        lambda a, b: F.struct(
            ((a["px"] - x0) * (b["py"] - y0) - (b["px"] - x0) * (a["py"] - y0)).alias("c"), (a["px"] + b["px"] - 2 * x0).alias("sx"), (a["py"] + b["py"] - 2 * y0).alias("sy")
        ),
    )
    total = lambda f: F.aggregate(F.transform(parts, f), F.lit(0.0), lambda s, v: s + v)
    area3 = F.nullif(3 * total(lambda p: p["c"]), F.lit(0.0))
    return F.struct((x0 + total(lambda p: p["c"] * p["sx"]) / area3).alias("x"), (y0 + total(lambda p: p["c"] * p["sy"]) / area3).alias("y"))


def guess_crs(x: Column, y: Column) -> Column:
    """4326 for degrees, 25832 for plausible UTM metres, an error otherwise."""
    degrees = x.between(-180, 180) & y.between(-180, 180)
    metres = (x > 200000) & (x < 800000) & (y > 2000000) & (y < 8000000)
    return F.when(degrees, 4326).when(metres, 25832).otherwise(F.raise_error(F.lit("unknown coordinate system")).cast("int"))


def metres_to_degrees(metres: Column, latitude: Column) -> tuple[Column, Column]:
    """(latitude difference, longitude difference)."""
    d = metres / EARTH_RADIUS * (180.0 / math.pi)
    return d, d / F.cos(F.radians(latitude))


_N = FLATTENING / (2 - FLATTENING)
_SCALE = 0.9996 * EARTH_RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def utm(lon, lat, zone: int = 32, north: bool = True, m=F):
    """(easting, northing) by the Krueger series to third order, of columns, or of numbers with ``m`` = math."""
    alpha = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = m.radians(lat), m.radians(lon - (6 * zone - 183))
    atanh = lambda v: 0.5 * m.log((1 + v) / (1 - v))
    t = m.sinh(atanh(m.sin(phi)) - e * atanh(e * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), atanh(m.sin(lam) / m.sqrt(1 + t * t))
    east, north_ = eta, xi
    for k, c in enumerate(alpha, 1):
        east = east + c * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
        north_ = north_ + c * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
    return 500000.0 + _SCALE * east, _SCALE * north_ + (0.0 if north else 10000000.0)


def lon_lat(easting, northing, zone: int = 32, north: bool = True, m=F):
    """(longitude, latitude) of a place in UTM, the inverse of :func:`utm`."""
    beta = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
    delta = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]
    xi, eta = (northing - (0.0 if north else 10000000.0)) / _SCALE, (easting - 500000.0) / _SCALE
    x, y = xi, eta
    for k, c in enumerate(beta, 1):
        x = x - c * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
        y = y - c * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
    chi = m.asin(m.sin(x) / m.cosh(y))
    phi = chi
    for k, c in enumerate(delta, 1):
        phi = phi + c * m.sin(2 * k * chi)
    return m.degrees(m.atan2(m.sinh(y), m.cos(x))) + (6 * zone - 183), m.degrees(phi)


def utm_zone(crs: int) -> tuple[int, bool]:
    """(zone, whether north) of an EPSG number for UTM: 326zz, 327zz, or 258zz (European datum, north)."""
    kind, zone = divmod(crs, 100)
    if kind not in (326, 327, 258) or not 1 <= zone <= 60:
        raise ValueError(f"no UTM zone: EPSG {crs}")
    return zone, kind != 327


def buffered_degrees(ring: Column, metres: Column) -> Column:
    """A ring in degrees moved outwards by metres: mitred in a plane with the scale of the ring's middle latitude."""
    _, y0, _, y1 = bounds(ring)
    up, across = metres_to_degrees(F.lit(1.0), (y0 + y1) / 2)
    plane = F.transform(ring, lambda p: F.struct((p["px"] / across).alias("px"), (p["py"] / up).alias("py")))
    return F.transform(F.transform(F.array(plane), lambda r: buffered(r, metres))[0], lambda p: F.struct((p["px"] * across).alias("px"), (p["py"] * up).alias("py")))


def buffered(ring: Column, distance: Column) -> Column:
    """A closed ring moved outwards by ``distance`` with mitred corners.

    Each corner moves along the bisector of its two edges' outward normals.
    """
    n = F.size(ring) - 1
    area2 = F.aggregate(F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: a["px"] * b["py"] - b["px"] * a["py"]), F.lit(0.0), lambda s, v: s + v)
    turn = F.when(area2 >= 0, 1.0).otherwise(-1.0)

    def normal(a: Column, b: Column) -> tuple[Column, Column]:
        length = F.nullif(F.hypot(b["px"] - a["px"], b["py"] - a["py"]), F.lit(0.0))
        return turn * (b["py"] - a["py"]) / length, -turn * (b["px"] - a["px"]) / length

    def corner(i: Column) -> Column:
        at, before, after = F.get(ring, i), F.get(ring, F.pmod(i - 1, n)), F.get(ring, F.pmod(i + 1, n))
        (ax, ay), (bx, by) = normal(before, at), normal(at, after)
        k = distance / F.nullif(1 + ax * bx + ay * by, F.lit(0.0))
        return F.struct((at["px"] + k * (ax + bx)).alias("px"), (at["py"] + k * (ay + by)).alias("py"))

    corners = F.transform(F.sequence(F.lit(0), n - 1), corner)
    return F.concat(corners, F.array(corners[0]))


def boxes_overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def rings_intersect(a: Column, b: Column) -> Column:
    """Whether two simple polygons have a point in common: an edge crosses an edge, or one lies in the other."""

    def edges(r: Column) -> Column:
        return F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["px"] - p["px"]) * (r["py"] - p["py"]) - (q["py"] - p["py"]) * (r["px"] - p["px"]))

    def between(p: Column, q: Column, r: Column) -> Column:
        inside = r["px"].between(F.least(p["px"], q["px"]), F.greatest(p["px"], q["px"])) & r["py"].between(F.least(p["py"], q["py"]), F.greatest(p["py"], q["py"]))
        return (side(p, q, r) == 0) & inside

    def cross(u: Column, v: Column) -> Column:
        proper = (side(u["p"], u["q"], v["p"]) * side(u["p"], u["q"], v["q"]) < 0) & (side(v["p"], v["q"], u["p"]) * side(v["p"], v["q"], u["q"]) < 0)
        return proper | between(u["p"], u["q"], v["p"]) | between(u["p"], u["q"], v["q"]) | between(v["p"], v["q"], u["p"]) | between(v["p"], v["q"], u["q"])

    touching = F.exists(edges(a), lambda u: F.exists(edges(b), lambda v: cross(u, v)))
    return touching | in_ring(a[0]["px"], a[0]["py"], b) | in_ring(b[0]["px"], b[0]["py"], a)


def _clip_edge(a: Point, b: Point) -> Callable[[Column], Column]:
    """Clips an open ring to the left of the line from a to b."""
    side = lambda p: (b[0] - a[0]) * (p["py"] - float(a[1])) - (b[1] - a[1]) * (p["px"] - float(a[0]))

    def step(points: Column, i: Column) -> Column:
        p, q = F.get(points, F.pmod(i - 1, F.size(points))), F.get(points, i)
        u, v = side(p), side(q)
        k = u / F.nullif(u - v, F.lit(0.0))
        met = F.struct((p["px"] + k * (q["px"] - p["px"])).alias("px"), (p["py"] + k * (q["py"] - p["py"])).alias("py"))
        return F.when((v >= 0) & (u < 0), F.array(met, q)).when(v >= 0, F.array(q)).when(u >= 0, F.array(met)).otherwise(F.slice(points, 1, 0))

    def clip(points: Column) -> Column:
        all_ = F.flatten(F.transform(F.sequence(F.lit(0), F.size(points) - 1), lambda i: step(points, i)))
        return F.when(F.size(points) > 0, all_).otherwise(points)

    return clip


def clipped(subject: Column, window: Sequence[Point]) -> Column:
    """A ring clipped to a convex window (counter-clockwise, closed), edge by edge; an empty array if nothing is left."""
    out = F.slice(subject, 1, F.size(subject) - 1)
    for a, b in zip(window, window[1:], strict=False):
        out = F.transform(F.array(out), _clip_edge(a, b))[0]
    return F.transform(F.array(out), lambda p: F.when(F.size(p) > 2, F.concat(p, F.array(F.get(p, F.lit(0))))).otherwise(F.slice(p, 1, 0)))[0]
