"""Geodesy and plane geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values that decide the results.
EARTH_RADIUS_MEAN_M = 6371008.8      # default of capture and defect matching
EARTH_RADIUS_TRACK_M = 6371000.0     # default of flight tracks and drawn areas
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
MERCATOR_MAX_LAT = 85.05112878
METRES_PER_DEGREE_LON = 111320.0
METRES_PER_DEGREE_LAT = 110540.0


def col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def haversine_m(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_MEAN_M) -> Column:
    a1, o1, a2, o2 = (col(c) for c in (lat1, lon1, lat2, lon2))
    # differences of degrees are exact for near places, those of radians are not
    s = F.pow(F.sin(F.radians(a2 - a1) / 2), 2) + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * F.pow(F.sin(F.radians(o2 - o1) / 2), 2)
    # a null position must stay null: least() would skip it
    return F.lit(2 * radius) * F.asin(F.when(s > 1.0, F.lit(1.0)).otherwise(F.sqrt(s)))


def utm_zone(lat, lon) -> Column:
    lat, lon = col(lat), col(lon)
    regular = F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)) + 1
    svalbard = (lat >= 72.0) & (lat < 84.0) & (lon >= 0.0) & (lon < 42.0)
    return (F.when((lat >= 56.0) & (lat < 64.0) & (lon >= 3.0) & (lon < 12.0), 32)
            .when(svalbard & (lon < 9.0), 31).when(svalbard & (lon < 21.0), 33)
            .when(svalbard & (lon < 33.0), 35).when(svalbard, 37)
            .otherwise(regular).cast("int"))


def utm_epsg(lat, lon) -> Column:
    return (F.when(col(lat) >= 0.0, 32600).otherwise(32700) + utm_zone(lat, lon)).cast("int")


def _series() -> dict:
    # Krueger series in the third flattening, to the fourth power (sub-millimetre in a zone).
    n = WGS84_F / (2 - WGS84_F)
    return {
        "n": n,
        "A": WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "alpha": [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
                  13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
                  61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280],
        "beta": [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
                 n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
                 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280],
        "delta": [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
                  7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
                  56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630],
    }


def lonlat_to_utm(lon, lat, epsg) -> Column:
    """struct(easting, northing) of a WGS84 position in the UTM zone ``epsg``."""
    k = _series()
    lon, lat, epsg = col(lon), F.radians(col(lat)), col(epsg)
    central = F.radians((epsg % 100) * 6.0 - 183.0)
    ecc = 2 * math.sqrt(k["n"]) / (1 + k["n"])
    s = F.sin(lat)
    t = F.sinh(F.atanh(s) - ecc * F.atanh(ecc * s))
    dl = F.radians(lon) - central
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(k["alpha"], 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    shift = F.when(epsg >= 32700, 10_000_000.0).otherwise(0.0)
    return F.struct((500_000.0 + 0.9996 * k["A"] * east).alias("easting"),
                    (shift + 0.9996 * k["A"] * north).alias("northing"))


def utm_to_lonlat(easting, northing, epsg) -> Column:
    """struct(lon, lat), inverse of :func:`lonlat_to_utm`."""
    k = _series()
    epsg = col(epsg)
    shift = F.when(epsg >= 32700, 10_000_000.0).otherwise(0.0)
    xi = (col(northing) - shift) / (0.9996 * k["A"])
    eta = (col(easting) - 500_000.0) / (0.9996 * k["A"])
    x, e = xi, eta
    for j, b in enumerate(k["beta"], 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(k["delta"], 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(e), F.cos(x))) + (epsg % 100) * 6.0 - 183.0
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def mercator_tile(lon, lat, zoom) -> Column:
    lat = col(lat)
    lat = F.when(lat > MERCATOR_MAX_LAT, F.lit(MERCATOR_MAX_LAT)).when(lat < -MERCATOR_MAX_LAT, F.lit(-MERCATOR_MAX_LAT)).otherwise(lat)
    n = F.pow(F.lit(2.0), col(zoom))
    x = ((col(lon) + 180.0) / 360.0 * n).cast("long")
    y = ((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n).cast("long")
    top = (n - 1).cast("long")
    return F.struct(F.greatest(F.lit(0), F.least(top, x)).alias("x"), F.greatest(F.lit(0), F.least(top, y)).alias("y"))


def count_tiles(west, south, east, north, min_zoom: int, max_zoom: int) -> Column:
    total = F.lit(0).cast("long")
    for z in range(min_zoom, max_zoom + 1):
        a, b = mercator_tile(west, north, z), mercator_tile(east, south, z)
        total = total + (F.abs(b["x"] - a["x"]) + 1) * (F.abs(b["y"] - a["y"]) + 1)
    return total


def ring_pairs(ring: Column) -> Column:
    """array of (p, q) for every side of a ring given as array<struct<x,y[,z]>>."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _total(pairs: Column, term) -> Column:
    return F.aggregate(F.transform(pairs, term), F.lit(0.0), lambda a, v: a + v)


def shoelace(ring) -> Column:
    """Planar area; fewer than three vertices give 0."""
    ring = col(ring)
    twice = _total(ring_pairs(ring), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(twice) / 2.0)


def perimeter(ring) -> Column:
    return _total(ring_pairs(col(ring)), lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))


def polyline_length(line) -> Column:
    line = col(line)
    tail = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    head = F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(head, tail, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])),
                       F.lit(0.0), lambda a, v: a + v)


def mean_of(ring: Column, part: str) -> Column:
    return F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[part]) / F.size(ring)


def equirect_area_m2(ring, radius: float = WGS84_A) -> Column:
    """Area of a lon/lat ring (x = lon, y = lat) on a local equirectangular plane."""
    ring = col(ring)
    lat0, lon0 = mean_of(ring, "y"), mean_of(ring, "x")
    sy = math.pi * radius / 180.0
    sx = F.cos(F.radians(lat0)) * sy
    return shoelace(F.transform(ring, lambda p: F.struct(((p["x"] - lon0) * sx).alias("x"),
                                                         ((p["y"] - lat0) * sy).alias("y"))))


def newell_area(ring) -> Column:
    """struct(surface, planimetric, slope_deg) of a 3-D ring."""
    pairs = ring_pairs(col(ring))
    nx = _total(pairs, lambda e: e["p"]["y"] * e["q"]["z"] - e["p"]["z"] * e["q"]["y"])
    ny = _total(pairs, lambda e: e["p"]["z"] * e["q"]["x"] - e["p"]["x"] * e["q"]["z"])
    nz = _total(pairs, lambda e: e["p"]["x"] * e["q"]["y"] - e["p"]["y"] * e["q"]["x"])
    surface = F.sqrt(nx * nx + ny * ny + nz * nz) / 2.0
    plan = F.abs(nz) / 2.0
    slope = F.when((surface > 0) & (plan > 0), F.degrees(F.acos(F.least(F.lit(1.0), plan / surface)))).otherwise(0.0)
    return F.struct(surface.alias("surface"), plan.alias("planimetric"), slope.alias("slope_deg"))


def length_height(x1, y1, z1, x2, y2, z2) -> Column:
    dx, dy, dz = col(x2) - col(x1), col(y2) - col(y1), col(z2) - col(z1)
    return F.struct(F.sqrt(dx * dx + dy * dy + dz * dz).alias("length"), F.hypot(dx, dy).alias("horizontal"),
                    F.abs(dz).alias("height"))


def pixel_distance_mm(x1, y1, x2, y2, mm_per_px) -> Column:
    return F.hypot(col(x2) - col(x1), col(y2) - col(y1)) * col(mm_per_px)


def pixel_area_mm2(ring, mm_per_px) -> Column:
    return shoelace(ring) * F.pow(col(mm_per_px), 2)


def rational(numerator, denominator) -> Column:
    return F.when(col(denominator) != 0, col(numerator) / col(denominator))


def dms_to_degrees(deg, minutes, seconds, ref) -> Column:
    value = col(deg) + col(minutes) / 60.0 + col(seconds) / 3600.0
    return F.when(F.upper(F.coalesce(col(ref), F.lit(""))).isin("S", "W"), -value).otherwise(value)


def affine_xy(row, c, a, b, c0, d, e, f0) -> Column:
    """Ground position of a cell centre."""
    cc, rr = col(c) + 0.5, col(row) + 0.5
    return F.struct((col(a) * cc + col(b) * rr + col(c0)).alias("x"), (col(d) * cc + col(e) * rr + col(f0)).alias("y"))


def apply_similarity(scale, rotation, translation, x, y, z) -> Column:
    """s*R*p + t; ``rotation`` is a 9-element array (rows first), ``translation`` three elements."""
    r, t, p = col(rotation), col(translation), [col(x), col(y), col(z)]
    axis = [col(scale) * sum((r[3 * i + j] * p[j] for j in range(1, 3)), r[3 * i] * p[0]) + t[i] for i in range(3)]
    return F.struct(axis[0].alias("x"), axis[1].alias("y"), axis[2].alias("z"))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Compass direction on the local plane."""
    dx = (col(lon2) - col(lon1)) * F.cos(F.radians((col(lat1) + col(lat2)) / 2))
    return wrap_deg(F.degrees(F.atan2(dx, col(lat2) - col(lat1))))


def wrap_deg(angle) -> Column:
    return F.pmod(col(angle), F.lit(360.0))


def aspect_deg(dz_dx, dz_dy) -> Column:
    """Bearing a surface falls towards; null when level."""
    dx, dy = col(dz_dx), col(dz_dy)
    level = (F.abs(dx) < 1e-12) & (F.abs(dy) < 1e-12)
    return F.when(~level, wrap_deg(F.degrees(F.atan2(-dx, -dy))))


def in_ring(x, y, ring) -> Column:
    """Even-odd crossing test, half-open; a ring under three vertices holds nothing."""
    x, y, ring = col(x), col(y), col(ring)

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))
        return F.when((p["y"] > y) != (q["y"] > y), (x < at).cast("int")).otherwise(0)

    hits = F.aggregate(F.transform(ring_pairs(ring), crosses), F.lit(0), lambda a, v: a + v)
    return (F.size(ring) >= 3) & (hits % 2 == 1)


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / len2))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))
