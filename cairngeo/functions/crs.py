"""SWEREF 99 TM (3006) and WGS 84 (4326) as column expressions.

Krueger's transverse Mercator series in the third flattening, carried to the
fourth order (well under a millimetre inside the zone). The datums are taken as
equal, as is usual for these two systems. All of it is built-in functions, so a
projection stays inside whole-stage codegen and reads no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

SWEREF = 3006
WGS84 = 4326

# GRS 80 ellipsoid and the SWEREF 99 TM projection.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
CENTRAL_MERIDIAN = 15.0
FALSE_EASTING = 500000.0

# Range outside which a metric position is refused.
EAST_RANGE = (100000.0, 1100000.0)
NORTH_RANGE = (6000000.0, 7800000.0)

_n = FLATTENING / (2 - FLATTENING)
_ecc = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = SCALE * SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)

# Published series coefficients: geographic to grid, grid to geographic, and
# conformal to geodetic latitude.
TO_GRID = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)
FROM_GRID = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
)
LATITUDE = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
)


def _series(weights, outer: str, inner: str, a: str, b: str) -> str:
    terms = [f"{w!r}D * {outer}({2 * k}.0D * ({a})) * {inner}({2 * k}.0D * ({b}))" for k, w in enumerate(weights, 1)]
    return " + ".join(terms)


# The two directions go in steps over SQL snippets, so a transform of whole rings
# can chain the steps without repeating the work of the step before.


def _grid_angles(east: str, north: str) -> tuple[str, str]:
    up, across = f"({north}) / {RADIUS!r}D", f"(({east}) - {FALSE_EASTING!r}D) / {RADIUS!r}D"
    return (
        f"({up} - ({_series(FROM_GRID, 'sin', 'cosh', up, across)}))",
        f"({across} - ({_series(FROM_GRID, 'cos', 'sinh', up, across)}))",
    )


def _geographic(up: str, across: str) -> tuple[str, str]:
    """(longitude in degrees, conformal latitude) from the corrected grid angles."""
    lon = f"(degrees(atan2(sinh({across}), cos({up}))) + {CENTRAL_MERIDIAN!r}D)"
    return lon, f"asin(sin({up}) / cosh({across}))"


def _geodetic(conformal: str) -> str:
    terms = [f"{w!r}D * sin({2 * k}.0D * ({conformal}))" for k, w in enumerate(LATITUDE, 1)]
    return f"degrees({conformal} + " + " + ".join(terms) + ")"


def _gauss_angles(lon: str, lat: str) -> tuple[str, str]:
    phi, lam = f"radians({lat})", f"radians(({lon}) - {CENTRAL_MERIDIAN!r}D)"
    tau = f"sinh(asinh(tan({phi})) - {_ecc!r}D * atanh({_ecc!r}D * sin({phi})))"
    return f"atan2({tau}, cos({lam}))", f"asinh(sin({lam}) / sqrt(pow({tau}, 2) + pow(cos({lam}), 2)))"


def _grid(up: str, across: str) -> tuple[str, str]:
    east = f"({FALSE_EASTING!r}D + {RADIUS!r}D * ({across} + {_series(TO_GRID, 'cos', 'sinh', up, across)}))"
    north = f"({RADIUS!r}D * ({up} + {_series(TO_GRID, 'sin', 'cosh', up, across)}))"
    return east, north


def grid_to_lonlat(east: str, north: str) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of two SQL snippets, without a range check."""
    lon, conformal = _geographic(*_grid_angles(east, north))
    return F.expr(lon), F.expr(_geodetic(conformal))


def lonlat_to_grid(lon: str, lat: str) -> tuple[Column, Column]:
    """(easting, northing) in metres of two SQL snippets."""
    east, north = _grid(*_gauss_angles(lon, lat))
    return F.expr(east), F.expr(north)


def in_range_sql(east: str, north: str) -> str:
    return (
        f"{east} > {EAST_RANGE[0]!r}D AND {east} < {EAST_RANGE[1]!r}D "
        f"AND {north} > {NORTH_RANGE[0]!r}D AND {north} < {NORTH_RANGE[1]!r}D"
    )


def sweref_to_wgs84_sql(east: str, north: str) -> str:
    lon, conformal = _geographic(*_grid_angles(east, north))
    at = f"struct({_geodetic(conformal)} AS lat, {lon} AS lon)"
    return f"CASE WHEN {in_range_sql(east, north)} THEN {at} END"


def sweref_to_wgs84(east: str, north: str) -> Column:
    """STRUCT<lat, lon>, null outside the accepted metric range."""
    return F.expr(sweref_to_wgs84_sql(east, north))


def transform_xy(x: str, y: str, source: int, target: int) -> tuple[Column, Column]:
    """Position moved from one system to the other; unchanged when they are equal."""
    if source == target:
        return F.expr(x), F.expr(y)
    if (source, target) == (SWEREF, WGS84):
        return grid_to_lonlat(x, y)
    if (source, target) == (WGS84, SWEREF):
        return lonlat_to_grid(x, y)
    raise ValueError(f"no transform from {source} to {target}")


def transform_sql(g: str, source: int, target: int) -> str:
    if source == target:
        return g
    if (source, target) == (SWEREF, WGS84):
        steps = [_grid_angles("v.x", "v.y"), _geographic("v.x", "v.y"), ("v.x", _geodetic("v.y"))]
    elif (source, target) == (WGS84, SWEREF):
        steps = [_gauss_angles("v.x", "v.y"), _grid("v.x", "v.y")]
    else:
        raise ValueError(f"no transform from {source} to {target}")
    ring = "r"
    for x, y in steps:
        # the middle step of the first chain reads (up, across) as (x, y)
        ring = f"transform({ring}, v -> struct({x} AS x, {y} AS y))"
    return G.map_rings_sql(g, ring)


def transform_geometry(g: str, source: int, target: int) -> Column:
    """Every vertex moved; the geometry itself when both systems are equal."""
    return F.expr(transform_sql(g, source, target))
