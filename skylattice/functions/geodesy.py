"""Coordinates, winds, distances and plane geometry as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice.settings import EARTH_RADIUS_M, KM_PER_DEG_LAT, KM_PER_DEG_LON_EQUATOR


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))


# ---------------------------------------------------------------- local plane
def offset_east_km(lon, lat0, lon0) -> Column:
    return (_col(lon) - _col(lon0)) * F.lit(KM_PER_DEG_LON_EQUATOR) * F.cos(F.radians(_col(lat0)))


def offset_north_km(lat, lat0) -> Column:
    return (_col(lat) - _col(lat0)) * F.lit(KM_PER_DEG_LAT)


def distance_km(lat, lon, lat0, lon0) -> Column:
    dx, dy = offset_east_km(lon, lat0, lon0), offset_north_km(lat, lat0)
    return F.sqrt(dx * dx + dy * dy)


def within_radius(lat, lon, lat0, lon0, radius_km) -> Column:
    """Closed disc in the local plane."""
    return distance_km(lat, lon, lat0, lon0) <= _col(radius_km)


def in_box(lat, lon, box, pad: float = 0.0) -> Column:
    """Closed box (lat_lo, lat_hi, lon_lo, lon_hi), widened by `pad` degrees."""
    lat_lo, lat_hi, lon_lo, lon_hi = box
    return _col(lat).between(lat_lo - pad, lat_hi + pad) & _col(lon).between(lon_lo - pad, lon_hi + pad)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dp, dl = p2 - p1, F.radians(_col(lon2)) - F.radians(_col(lon1))
    h = F.pow(F.sin(dp / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), F.lit(2))
    return 2 * F.lit(EARTH_RADIUS_M) * F.asin(F.sqrt(h))


# ---------------------------------------------------------------- wind
def wind_speed(u, v) -> Column:
    return F.sqrt(_col(u) * _col(u) + _col(v) * _col(v))


def wind_from_deg(u, v) -> Column:
    """Direction the wind blows from, degrees in [0, 360)."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(_col(v), _col(u))), F.lit(360.0))


def along_wind(dx, dy, u, v) -> Column:
    theta = F.atan2(_col(v), _col(u))
    return _col(dx) * F.cos(theta) + _col(dy) * F.sin(theta)


def across_wind(dx, dy, u, v) -> Column:
    theta = F.atan2(_col(v), _col(u))
    return -_col(dx) * F.sin(theta) + _col(dy) * F.cos(theta)


# ---------------------------------------------------------------- transverse Mercator
# WGS84 ellipsoid and the UTM scale; zone 43 has its central meridian at 75 E.
_A, _FLAT, _K0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _FLAT / (2 - _FLAT)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Published Krueger series (third order is below a millimetre within a zone).
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_forward(lat, lon, central_meridian: float = 75.0) -> tuple[Column, Column]:
    """(easting, northing) in metres, northern hemisphere."""
    phi, lam = F.radians(_col(lat)), F.radians(_col(lon) - F.lit(central_meridian))
    ecc = 2 * math.sqrt(_N) / (1 + _N)
    conformal = F.sinh(F.atanh(F.sin(phi)) - F.lit(ecc) * F.atanh(F.lit(ecc) * F.sin(phi)))
    xi = F.atan2(conformal, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + conformal * conformal))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(_E0) + F.lit(_K0 * _RECT) * east, F.lit(_K0 * _RECT) * north


def utm_inverse(x, y, central_meridian: float = 75.0) -> tuple[Column, Column]:
    """(lat, lon) in degrees from easting and northing, northern hemisphere."""
    xi, eta = _col(y) / F.lit(_K0 * _RECT), (_col(x) - F.lit(_E0)) / F.lit(_K0 * _RECT)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(_DELTA, start=1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    lon = F.lit(central_meridian) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return F.degrees(lat), lon


# ---------------------------------------------------------------- segments, rings, cells
def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    px, py, x1, y1, x2, y2 = map(_col, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, len2), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def distance_to_path(px, py, path) -> Column:
    """Distance to a polyline given as a short constant list of (x, y) vertices."""
    parts = [point_segment_distance(px, py, a[0], a[1], b[0], b[1]) for a, b in zip(path[:-1], path[1:])]
    return F.least(*parts) if len(parts) > 1 else parts[0]


def in_corridor(px, py, path, buffer_km, discs=()) -> Column:
    """Within `buffer_km` of the path, or inside one of the (x, y, radius) discs."""
    tests = [distance_to_path(px, py, path) <= F.lit(buffer_km)]
    for x, y, r in discs:
        tests.append(F.sqrt((_col(px) - x) * (_col(px) - x) + (_col(py) - y) * (_col(py) - y)) <= F.lit(r))
    return reduce(lambda a, b: a | b, tests)


def _clip(x1, y1, x2, y2, bx0, by0, bx1, by1) -> tuple[Column, Column]:
    """Entry and exit parameters of a segment in a closed box; the entry is the larger one where they do not meet."""
    x1, y1, x2, y2, bx0, by0, bx1, by1 = map(_col, (x1, y1, x2, y2, bx0, by0, bx1, by1))
    inf = F.lit(float("inf"))

    def slab(p, q, lo, hi):
        d = q - p
        a, b = F.try_divide(lo - p, d), F.try_divide(hi - p, d)
        enter = F.when(d == 0, F.when((p >= lo) & (p <= hi), -inf).otherwise(inf)).otherwise(F.least(a, b))
        leave = F.when(d == 0, F.when((p >= lo) & (p <= hi), inf).otherwise(-inf)).otherwise(F.greatest(a, b))
        return enter, leave

    ex, lx = slab(x1, x2, bx0, bx1)
    ey, ly = slab(y1, y2, by0, by1)
    return F.greatest(F.lit(0.0), ex, ey), F.least(F.lit(1.0), lx, ly)


def meets_box(x1, y1, x2, y2, bx0, by0, bx1, by1) -> Column:
    """True where a segment and a closed box share a point, be it a single one."""
    t0, t1 = _clip(x1, y1, x2, y2, bx0, by0, bx1, by1)
    return t1 >= t0


def clipped_length(x1, y1, x2, y2, bx0, by0, bx1, by1) -> Column:
    """Length of a segment inside a closed box, from the entry and exit parameters along the segment."""
    x1, y1, x2, y2 = map(_col, (x1, y1, x2, y2))
    t0, t1 = _clip(x1, y1, x2, y2, bx0, by0, bx1, by1)
    length = F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    return F.when(t1 > t0, (t1 - t0) * length).otherwise(F.lit(0.0))


def edge_crosses(px, py, x1, y1, x2, y2) -> Column:
    """True where the ray from (px, py) towards +x crosses the edge (half-open in y)."""
    px, py, x1, y1, x2, y2 = map(_col, (px, py, x1, y1, x2, y2))
    straddles = (y1 > py) != (y2 > py)
    return straddles & (px < F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1)


def in_ring(px, py, ring) -> Column:
    """Even-odd test against an ARRAY<STRUCT<x, y>> ring (closing edge implied)."""
    ring, px, py = _col(ring), _col(px), _col(py)
    shifted = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1)))
    crossings = F.filter(F.arrays_zip(ring.alias("a"), shifted.alias("b")),
                         lambda e: edge_crosses(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return F.size(crossings) % 2 == 1


def grid_index(x, size) -> Column:
    return F.floor(_col(x) / _col(size)).cast("bigint")


def cell_name(iy, ix) -> Column:
    return F.format_string("c%03d_%03d", _col(iy), _col(ix))


def region_cell_name(x_m, y_m) -> Column:
    return F.format_string("g%04d_%05d", grid_index(x_m, 1000), grid_index(y_m, 1000))


def block_name(x, y, size) -> Column:
    return F.concat(grid_index(x, size).cast("string"), F.lit("_"), grid_index(y, size).cast("string"))


def bin_index(x, lo: float, step: float, n: int) -> Column:
    """Half-open uniform bins [lo + i*step, lo + (i+1)*step); NULL outside."""
    i = F.floor((_col(x) - F.lit(lo)) / F.lit(step))
    return F.when((i >= 0) & (i < n), i.cast("int"))
