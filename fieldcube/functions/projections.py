"""Map projections by EPSG number, both ways, over columns or (with ``m`` = math) numbers.

All systems here are on the GRS 80 or WGS 84 ellipsoid, which are taken as one: their
figures differ by a tenth of a millimetre, their datums in Europe by less than a metre.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from fieldcube.functions import geometry as g

E2 = g.FLATTENING * (2 - g.FLATTENING)
E = math.sqrt(E2)
A = g.EARTH_RADIUS
#: Series of the latitude over the conformal and over the authalic one.
_CONFORMAL = (E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360, 7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520, 7 * E2**3 / 120 + 81 * E2**4 / 1120, 4279 * E2**4 / 161280)
_AUTHALIC = (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360)


@dataclass(frozen=True)
class Projection:
    """``forward``: (lon, lat, m) to (x, y); ``inverse``: (x, y, m) to (lon, lat)."""

    forward: Callable
    inverse: Callable


def _series(angle, terms, m):
    return sum((c * m.sin(2 * k * angle) for k, c in enumerate(terms, 1)), angle)


def web_mercator() -> Projection:
    """The sphere of web maps; latitudes of 90 degrees are infinitely far."""

    def forward(lon, lat, m=F):
        return A * m.radians(lon), A * m.asinh(m.tan(m.radians(lat)))

    def inverse(x, y, m=F):
        return m.degrees(x / A), m.degrees(m.atan(m.sinh(y / A)))

    return Projection(forward, inverse)


def transverse(zone: int, north: bool) -> Projection:
    """A zone of UTM."""
    return Projection(lambda lon, lat, m=F: g.utm(lon, lat, zone, north, m), lambda x, y, m=F: g.lon_lat(x, y, zone, north, m))


def _q(sine, m):
    return (1 - E2) * (sine / (1 - E2 * sine * sine) + m.log((1 + E * sine) / (1 - E * sine)) / (2 * E))


def equal_area(lat0: float, lon0: float, east: float, north: float) -> Projection:
    """Lambert's azimuthal equal-area projection around (lon0, lat0)."""
    s0 = math.sin(math.radians(lat0))
    qp, q0 = _q(1.0, math), _q(s0, math)
    rq, beta0 = A * math.sqrt(qp / 2), math.asin(q0 / qp)
    d = A * math.cos(math.radians(lat0)) / math.sqrt(1 - E2 * s0 * s0) / (rq * math.cos(beta0))
    cb, sb = math.cos(beta0), math.sin(beta0)

    def forward(lon, lat, m=F):
        dl, beta = m.radians(lon - lon0), m.asin(_q(m.sin(m.radians(lat)), m) / qp)
        b = rq * m.sqrt(2 / (1 + sb * m.sin(beta) + cb * m.cos(beta) * m.cos(dl)))
        return east + b * d * m.cos(beta) * m.sin(dl), north + b / d * (cb * m.sin(beta) - sb * m.cos(beta) * m.cos(dl))

    def inverse(x, y, m=F):
        u, v = (x - east) / d, d * (y - north)
        rho = m.sqrt(u * u + v * v) + 1e-12  # the centre itself
        c = 2 * m.asin(rho / (2 * rq))
        beta = m.asin(m.cos(c) * sb + v * m.sin(c) * cb / rho)
        lam = m.atan2(u * m.sin(c), rho * cb * m.cos(c) - v * sb * m.sin(c))
        return lon0 + m.degrees(lam), m.degrees(_series(beta, _AUTHALIC, m))

    return Projection(forward, inverse)


def conic(lat1: float, lat2: float, lat0: float, lon0: float, east: float, north: float) -> Projection:
    """Lambert's conformal conic projection with two parallels."""

    def t(phi, m):
        s = m.sin(phi)
        return m.tan(math.pi / 4 - phi / 2) / m.exp(E / 2 * m.log((1 - E * s) / (1 + E * s)))

    def breadth(phi):
        return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)

    a, b, o = (math.radians(x) for x in (lat1, lat2, lat0))
    n = (math.log(breadth(a)) - math.log(breadth(b))) / (math.log(t(a, math)) - math.log(t(b, math))) if lat1 != lat2 else math.sin(a)
    f = breadth(a) / (n * t(a, math) ** n)
    r0 = A * f * t(o, math) ** n
    sign = math.copysign(1.0, n)

    def forward(lon, lat, m=F):
        r, theta = A * f * m.exp(n * m.log(t(m.radians(lat), m))), n * m.radians(lon - lon0)
        return east + r * m.sin(theta), north + r0 - r * m.cos(theta)

    def inverse(x, y, m=F):
        u, v = sign * (x - east), sign * (r0 - (y - north))
        chi = math.pi / 2 - 2 * m.atan(m.exp(m.log(m.sqrt(u * u + v * v) / (A * abs(f))) / n))
        return lon0 + m.degrees(m.atan2(u, v) / n), m.degrees(_series(chi, _CONFORMAL, m))

    return Projection(forward, inverse)


# Parameters of European systems, by EPSG number.
NAMED = {
    3857: web_mercator(),
    3035: equal_area(52.0, 10.0, 4321000.0, 3210000.0),
    3034: conic(35.0, 65.0, 52.0, 10.0, 4000000.0, 2800000.0),
    2154: conic(49.0, 44.0, 46.5, 3.0, 700000.0, 6600000.0),
}


def projection(crs: int) -> Projection:
    """The projection of an EPSG number: those of ``NAMED``, and UTM zones. Raises ValueError for others."""
    return NAMED[crs] if crs in NAMED else transverse(*g.utm_zone(crs))


def transformed(x, y, source: int, target: int, m=F):
    """(x, y) of one system in another one, through degrees (4326)."""
    if source == target:
        return x, y
    lon, lat = (x, y) if source == 4326 else projection(source).inverse(x, y, m)
    return (lon, lat) if target == 4326 else projection(target).forward(lon, lat, m)


def ring_in(ring: list[g.Point], target: int, source: int | None = None) -> list[g.Point]:
    """A ring in another system. Without ``source``, degrees are 4326 and plausible metres zone 32 (25832); else ValueError."""
    if source is None:
        if all(-180 <= x <= 180 and -180 <= y <= 180 for x, y in ring):
            source = 4326
        elif all(200_000 < x < 800_000 and 2_000_000 < y < 8_000_000 for x, y in ring):
            source = 25832
        else:
            raise ValueError("a ring in an unknown coordinate system")
    return [transformed(x, y, source, target, math) for x, y in ring]
