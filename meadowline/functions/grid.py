"""Grid addressing, tiles and projections as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_index(x: Column, size: float) -> Column:
    """Index of the block that holds a coordinate; negative ones round down."""
    return F.floor(x / F.lit(float(size))).cast("long")


def parent_block(index: Column, ratio: int) -> Column:
    """Index of the larger block of ``ratio`` blocks a side."""
    return F.floor(index / F.lit(float(ratio))).cast("long")


def split_index(flat: Column, width: int) -> tuple[Column, Column]:
    """Row and column of a flat index."""
    return F.floor(flat / F.lit(float(width))).cast("long"), F.pmod(flat, F.lit(width)).cast("long")


def pixel_centre(row: Column, col: Column, left: float, top: float, pixel: float) -> tuple[Column, Column]:
    return F.lit(float(left)) + (col + 0.5) * float(pixel), F.lit(float(top)) - (row + 0.5) * float(pixel)


def pixel_at(x: Column, y: Column, left: float, top: float, pixel: float) -> tuple[Column, Column]:
    """Row and column of the pixel a point lies in; its left and upper edges belong to it."""
    return F.floor((F.lit(float(top)) - y) / float(pixel)).cast("long"), F.floor((x - float(left)) / float(pixel)).cast("long")


def global_row(tile_row: Column, local_row: Column, tile: int) -> Column:
    """Row that grows southward over the whole grid, whose tile rows grow northward."""
    return -(tile_row + 1) * tile + local_row


def tile_id(tile_col: Column, tile_row: Column) -> Column:
    return F.format_string("x%+07d_y%+07d", tile_col, tile_row)


def display_cell(row: Column, col: Column, height: int, width: int, cells_high: int, cells_wide: int) -> tuple[Column, Column]:
    """Cell of a coarser display grid; the last one takes the remainder."""
    at = lambda i, n, cells: F.least(F.floor(i * cells / F.lit(float(n))), F.lit(cells - 1)).cast("long")
    return at(row, height, cells_high), at(col, width, cells_wide)


@dataclass(frozen=True)
class Grid:
    """A raster's grid: its coordinate system, upper left corner and the size of its cells."""

    crs: str
    left: float
    top: float
    width: float
    height: float


def source_cell(x: Column, y: Column, left: float, top: float, width: float, height: float | None = None) -> tuple[Column, Column]:
    """Row and column of the cell of another raster that holds a point: its nearest cell."""
    return F.floor((F.lit(float(top)) - y) / float(height or width)).cast("long"), F.floor((x - float(left)) / float(width)).cast("long")


# The WGS84 ellipsoid, the standard parallel of the cylindrical equal-area grid, the Equal Earth polynomial.
_A, _F = 6378137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)
_PARALLEL = math.radians(30)
_EARTH = (1.340264, -0.081106, 0.000893, 0.003796)


def _q(sine: float) -> float:
    return (1 - _E2) * (sine / (1 - _E2 * sine**2) - math.log((1 - _E * sine) / (1 + _E * sine)) / (2 * _E))


_QP, _K0 = _q(1.0), math.cos(_PARALLEL) / math.sqrt(1 - _E2 * math.sin(_PARALLEL) ** 2)


def lonlat_to_cylindrical(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to the cylindrical equal-area grid with true scale at 30 degrees."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    return _A * _K0 * F.radians(lon), _A * q / (2 * _K0)


def _authalic(y: Column) -> Column:
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * y * _K0 / (_A * _QP))))


def cylindrical_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / (_A * _K0)), _geodetic(_authalic(y))


def _geodetic(b: Column) -> Column:
    """Latitude in degrees of an authalic latitude in radians."""
    e2, e4, e6 = _E2, _E2**2, _E2**3
    return F.degrees(b + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b) + 761 * e6 / 45360 * F.sin(6 * b))


_RADIUS = _A * math.sqrt(_QP / 2)


def _slope(t: Column) -> Column:
    a1, a2, a3, a4 = _EARTH
    t2 = t * t
    t6 = t2 * t2 * t2
    return 9 * a4 * t6 * t2 + 7 * a3 * t6 + 3 * a2 * t2 + a1


def _height(t: Column) -> Column:
    a1, a2, a3, a4 = _EARTH
    t2 = t * t
    t6 = t2 * t2 * t2
    return t * (a4 * t6 * t2 + a3 * t6 + a2 * t2 + a1)


def _equal_earth(lam: Column, authalic: Column) -> tuple[Column, Column]:
    t = F.asin(math.sqrt(3) / 2 * F.sin(authalic))
    return 2 * math.sqrt(3) * _RADIUS * lam * F.cos(t) / (3 * _slope(t)), _RADIUS * _height(t)


def cylindrical_to_equal_earth(x: Column, y: Column) -> tuple[Column, Column]:
    """From one equal-area projection to another, through the authalic latitude."""
    return _equal_earth(x / (_A * _K0), _authalic(y))


def lonlat_to_equal_earth(lon: Column, lat: Column) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    return _equal_earth(F.radians(lon), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / _QP))))


#: Newton steps of the inverse; from the height itself as a start each at least squares the error.
NEWTON_STEPS = 8


def equal_earth_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """The parametric latitude by Newton's iteration, as a fold over a sequence, so that the expression does not grow with its
    steps. NULL where the height or the longitude is beyond the world's edge."""
    height = y / _RADIUS
    start = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), height / _EARTH[0], lambda a, _: a - (_height(a) - height) / _slope(a))

    def place(t: Column) -> Column:
        s = 2 / math.sqrt(3) * F.sin(t)
        lon = F.degrees(3 * x * _slope(t) / (2 * math.sqrt(3) * _RADIUS * F.cos(t)))
        there = (F.abs(s) <= 1 + 1e-12) & (F.abs(lon) <= 180 + 1e-9)
        lat = _geodetic(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))
        return F.struct(F.when(there, lon).alias("lon"), F.when(there, lat).alias("lat"))

    found = F.get(F.transform(F.array(start), place), 0)  # what the iteration finds is a variable of the rest
    return found["lon"], found["lat"]


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator; NULL at the poles."""
    return _A * F.radians(lon), F.when(F.abs(lat) < 90, _A * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)))


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / _A), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2)


#: Coordinate systems by their EPSG number: to degrees, and from them.
_SYSTEMS = {
    4326: (lambda x, y: (x, y), lambda x, y: (x, y)), 6933: (cylindrical_to_lonlat, lonlat_to_cylindrical),
    8857: (equal_earth_to_lonlat, lonlat_to_equal_earth), 3857: (mercator_to_lonlat, lonlat_to_mercator),
}


def epsg(name: str) -> int:
    """Number of a system such as ``EPSG:6933``, ``urn:ogc:def:crs:EPSG::8857`` or ``urn:ogc:def:crs:OGC:1.3:CRS84``."""
    if name.upper().endswith("CRS84"):
        return 4326
    number = name.rpartition(":")[2]
    if "EPSG" not in name.upper() or not number.isdigit() or int(number) not in _SYSTEMS:
        raise ValueError(f"not a coordinate system this library knows: {name!r}")
    return int(number)


def project(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates of one system in another, x first also where they are degrees."""
    a, b = epsg(source), epsg(target)
    if a == b:
        return x, y
    if (a, b) == (6933, 8857):
        return cylindrical_to_equal_earth(x, y)
    return _SYSTEMS[b][1](*_SYSTEMS[a][0](x, y))


def output_bounds(bounds: tuple[float, float, float, float], pixel: float, origin: tuple[float, float] = (0.0, 0.0), snap: float = 1e-9) -> tuple[int, int, int, int]:
    """First and last-but-one row and column (rows grow southward) of the pixels that cover bounds (left, bottom, right, top);
    edges within ``snap`` pixels of a line count as on it."""
    left, bottom, right, top = bounds
    at = lambda v: (v[0] - v[1]) / pixel
    first_col, last_col = math.floor(at((left, origin[0])) + snap), math.ceil(at((right, origin[0])) - snap)
    first_row, last_row = math.floor(-at((top, origin[1])) + snap), math.ceil(-at((bottom, origin[1])) - snap)
    return first_row, last_row, first_col, last_col


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> tuple[Column, Column]:
    """Common part of two index ranges (ends exclusive), as start and length; length 0 where they are apart."""
    low = F.greatest(low_a, low_b)
    return low, F.greatest(F.least(high_a, high_b) - low, F.lit(0))


def windows(spark, height: int, width: int, size: int) -> DataFrame:
    """Windows that cover a raster: row_off, col_off, rows, cols; those at the edges are smaller."""
    rows = spark.range(0, height, size).select(F.col("id").alias("row_off"))
    cells = rows.withColumn("col_off", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"), F.lit(size).cast("long"))))
    return cells.select("row_off", "col_off", F.least(F.lit(size), F.lit(height) - F.col("row_off")).alias("rows"), F.least(F.lit(size), F.lit(width) - F.col("col_off")).alias("cols"))


def locator_bounds(bounds: tuple[float, float, float, float], least_span: float) -> tuple[float, float, float, float]:
    """Degrees around bounds, at least so wide and high, moved into the world where they would reach beyond it."""
    out = []
    for low, high, world in ((bounds[0], bounds[2], 180.0), (bounds[1], bounds[3], 90.0)):
        span = min(max(high - low, least_span), 2 * world)
        start = min(max((low + high - span) / 2, -world), world - span)
        out.append((start, start + span))
    return out[0][0], out[1][0], out[0][1], out[1][1]
