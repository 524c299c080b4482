"""Planar and geodetic geometry as Column arithmetic.

A line is ``array<array<struct<x,y>>>`` (parts), a polygon is
``array<struct<shell,holes>>``; a ring repeats its first vertex at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

POINT_DDL = "struct<x:double,y:double>"
LINE_DDL = f"array<array<{POINT_DDL}>>"
POLYGON_DDL = f"array<struct<shell:array<{POINT_DDL}>,holes:array<array<{POINT_DDL}>>>>"

# WGS84 ellipsoid and UTM zone 19 south (EPSG:32719).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EAST = 500000.0
FALSE_NORTH = 10000000.0
CENTRAL_MERIDIAN = -69.0
# Fixed value: sphere radius of the great-circle distance, km.
SPHERE_KM = 6371.0
# Country box for points (lat, lon) and for whole layers.
COUNTRY_LAT = (-56.0, -17.0)
COUNTRY_LON = (-76.0, -66.0)

_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_CONFORMAL = 2 * math.sqrt(_N) / (1 + _N)
# Krueger series to the fourth power of the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def _series(xi: Column, eta: Column, terms: tuple, sign: float) -> tuple[Column, Column]:
    """``xi`` and ``eta`` with a Krueger series added to both."""
    out_xi, out_eta = xi, eta
    for j, k in enumerate(terms, 1):
        out_xi = out_xi + F.lit(sign * k) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        out_eta = out_eta + F.lit(sign * k) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    return out_xi, out_eta


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def to_metric(lon: Column, lat: Column) -> Column:
    """Longitude/latitude in degrees to UTM 19S metres."""
    k = SCALE * _RECTIFYING

    def conformal(s: Column) -> Column:
        return F.sinh(F.atanh(s) - F.lit(_CONFORMAL) * F.atanh(F.lit(_CONFORMAL) * s))

    def sphere(p: Column) -> Column:
        t, dlon = p["a"], p["b"]
        return _pair(F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t)))

    def plane(p: Column) -> Column:
        xi, eta = _series(p["a"], p["b"], _ALPHA, 1.0)
        return point(eta * k + FALSE_EAST, xi * k + FALSE_NORTH)

    t = _let(F.sin(F.radians(lat)), conformal)
    dlon = F.radians(lon - F.lit(CENTRAL_MERIDIAN))
    return _let(_let(_pair(t, dlon), sphere), plane)


def to_lonlat(east: Column, north: Column) -> Column:
    """UTM 19S metres back to degrees."""
    k = SCALE * _RECTIFYING

    def sphere(p: Column) -> Column:
        return _pair(*_series(p["a"], p["b"], _BETA, -1.0))

    def degrees(p: Column) -> Column:
        def latitude(chi: Column) -> Column:
            lat = chi
            for j, d in enumerate(_DELTA, 1):
                lat = lat + F.lit(d) * F.sin(chi * (2 * j))
            return F.degrees(lat)

        lon = F.degrees(F.atan2(F.sinh(p["b"]), F.cos(p["a"]))) + CENTRAL_MERIDIAN
        return point(lon, _let(F.asin(F.sin(p["a"]) / F.cosh(p["b"])), latitude))

    return _let(_let(_pair((north - FALSE_NORTH) / k, (east - FALSE_EAST) / k), sphere), degrees)


def map_line(line: Column, fn) -> Column:
    return F.transform(line, lambda part: F.transform(part, lambda p: fn(p["x"], p["y"])))


def round_swapped(part: Column, digits: int = 5) -> Column:
    """Display coordinates: (lat, lon), rounded."""
    return F.transform(
        part, lambda p: F.array(F.bround(p["y"], digits), F.bround(p["x"], digits))
    )


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * SPHERE_KM) * F.asin(F.sqrt(a))


def trip_distance_km(same_zone: Column, radius_km: Column, between: Column) -> Column:
    """Centroid distance; within one zone 0.7 radii, 0.5 km if it has none."""
    return F.when(same_zone, F.coalesce(radius_km * 0.7, F.lit(0.5))).otherwise(between)


def equivalent_radius(area: Column) -> Column:
    return F.when(area > 0, F.sqrt(area / math.pi))


def in_country(lat: Column, lon: Column) -> Column:
    return lat.between(*COUNTRY_LAT) & lon.between(*COUNTRY_LON)


def _sum(arr: Column, fn=lambda v: v) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + fn(v))


def _steps(ring: Column, fn) -> Column:
    """``fn(vertex, next vertex)`` along a vertex list."""
    n = F.size(ring)
    head = F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tail = F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(head, tail, fn)


def part_length(part: Column) -> Column:
    return _sum(_steps(part, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def line_length(line: Column) -> Column:
    """Length over all parts; an empty line measures 0."""
    return _sum(line, part_length)


def signed_area(ring: Column) -> Column:
    """Positive for counter-clockwise rings; measured from the first vertex
    so that large metric coordinates do not eat the precision."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    return (
        _sum(
            _steps(
                ring,
                lambda a, b: (a["x"] - ox) * (b["y"] - oy) - (b["x"] - ox) * (a["y"] - oy),
            )
        )
        / 2
    )


def polygon_area(poly: Column) -> Column:
    return _sum(
        poly,
        lambda g: F.abs(signed_area(g["shell"])) - _sum(g["holes"], lambda h: F.abs(signed_area(h))),
    )


def _ring_moment(ring: Column, axis: str) -> Column:
    ox, oy = ring[0]["x"], ring[0]["y"]
    o = ring[0][axis]
    raw = _sum(
        _steps(
            ring,
            lambda a, b: (a[axis] + b[axis] - o * 2)
            * ((a["x"] - ox) * (b["y"] - oy) - (b["x"] - ox) * (a["y"] - oy)),
        )
    )
    area = signed_area(ring)
    return F.signum(area) * raw / 6 + F.abs(area) * o


def polygon_centroid(poly: Column) -> Column:
    """Area-weighted centroid, holes taken out."""

    def moment(axis):
        return _sum(
            poly,
            lambda g: _ring_moment(g["shell"], axis)
            - _sum(g["holes"], lambda h: _ring_moment(h, axis)),
        )

    area = F.nullif(polygon_area(poly), F.lit(0.0))
    return point(moment("x") / area, moment("y") / area)


def line_centroid(line: Column) -> Column:
    """Length-weighted centroid of a line."""
    total = F.nullif(line_length(line), F.lit(0.0))

    def moment(axis):
        return _sum(
            line,
            lambda part: _sum(
                _steps(
                    part,
                    lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])
                    * (a[axis] + b[axis])
                    / 2,
                )
            ),
        )

    return point(moment("x") / total, moment("y") / total)


def representative_vertex(line: Column) -> Column:
    """Vertex nearest the line's centroid, interior vertices first."""
    inner = F.flatten(
        F.transform(line, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0))))
    )
    pool = F.when(F.size(inner) > 0, inner).otherwise(F.flatten(line))

    def nearest(c: Column) -> Column:
        return F.array_min(
            F.transform(
                pool,
                lambda p: F.struct(
                    F.hypot(p["x"] - c["x"], p["y"] - c["y"]).alias("d"),
                    p["x"].alias("x"),
                    p["y"].alias("y"),
                ),
            )
        )

    best = _let(line_centroid(line), nearest)
    return point(best["x"], best["y"])


def line_pieces(line: Column) -> Column:
    """All straight pieces of a line as ``array<struct<x1,y1,x2,y2>>``."""
    return F.flatten(F.transform(line, ring_pieces))


def ring_pieces(ring: Column) -> Column:
    return _steps(
        ring,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def polygon_pieces(poly: Column) -> Column:
    rings = F.flatten(F.transform(poly, lambda g: F.concat(F.array(g["shell"]), g["holes"])))
    return F.flatten(F.transform(rings, ring_pieces))


def point_piece_d2(px, py, x1, y1, x2, y2) -> Column:
    """Squared distance from a point to a straight piece."""
    dx, dy, ax, ay = x2 - x1, y2 - y1, px - x1, py - y1
    along, len2 = ax * dx + ay * dy, dx * dx + dy * dy
    off = ax * dy - ay * dx
    return (
        F.when(along <= 0, ax * ax + ay * ay)
        .when(along >= len2, (px - x2) * (px - x2) + (py - y2) * (py - y2))
        .otherwise(off * off / len2)
    )


def _side(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def pieces_cross(a, b) -> Column:
    """Do two pieces cross at inner points of both? ``a``, ``b``: x1, y1, x2, y2."""
    s1, s2 = _side(*a, b[0], b[1]), _side(*a, b[2], b[3])
    s3, s4 = _side(*b, a[0], a[1]), _side(*b, a[2], a[3])
    return (F.signum(s1) * F.signum(s2) < 0) & (F.signum(s3) * F.signum(s4) < 0)


def piece_piece_d2(a, b) -> Column:
    """Squared distance between two straight pieces, 0 where they meet."""
    ends = F.least(
        point_piece_d2(a[0], a[1], *b),
        point_piece_d2(a[2], a[3], *b),
        point_piece_d2(b[0], b[1], *a),
        point_piece_d2(b[2], b[3], *a),
    )
    return F.when(pieces_cross(a, b), 0.0).otherwise(ends)


def ray_crosses(px, py, x1, y1, x2, y2) -> Column:
    """Does the ray from the point towards +x cross this ring piece?"""
    straddles = (y1 > py) != (y2 > py)
    return F.when(
        straddles, px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
    ).otherwise(False)


def point_in_pieces(px: Column, py: Column, pieces: Column) -> Column:
    """Even-odd rule over an array of ring pieces."""
    hits = F.size(
        F.filter(pieces, lambda e: ray_crosses(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))
    )
    return hits % 2 == 1
