"""Cells: the layout key of published layers, map tiles, join grid, LiDAR grid."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ZOOM = 14
CELL_BITS = 16

# LiDAR tile grid (kilometre easting, ten-kilometre northing above 6000 km).
TILE_SIDE = 2500
TILE_EAST_STEP = 1000
TILE_NORTH_STEP = 10000
TILE_NORTH_BASE = 6000000


def _spread(v: Column) -> Column:
    """Put a zero bit after each of the low 16 bits."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def _domain(srid: int, axis: str) -> tuple[float, float]:
    """(offset, width) of an axis of the grid: the whole Earth in degrees, else 16,777 km from the origin."""
    if srid == 4326:
        return (180.0, 360.0) if axis == "x" else (90.0, 180.0)
    return 0.0, 16777216.0


def _step(value: Column, srid: int, axis: str) -> Column:
    """Number of the grid square along an axis; outside the grid that of its edge."""
    offset, width = _domain(srid, axis)
    top = (1 << CELL_BITS) - 1
    return F.least(F.greatest(F.floor((value + offset) / width * (top + 1)), F.lit(0)), F.lit(top)).cast("bigint")


def cell(x: Column, y: Column, srid: int) -> Column:
    """Interleaved-bit number of the grid square around a position."""
    return _spread(_step(x, srid, "x")).bitwiseOR(F.shiftleft(_spread(_step(y, srid, "y")), 1))


# --- layout cells of features ------------------------------------------------------

LEVEL_FACTOR = 32  # a cell's number is its corner's interleaved number and its level in the lowest five bits
MAX_RANGES = 64


def _square_sql(value: str, srid: int, axis: str) -> str:
    offset, width = _domain(srid, axis)
    top = (1 << CELL_BITS) - 1
    return f"cast(least(greatest(floor(({value} + {offset!r}D) / {width!r}D * {top + 1}), 0), {top}) AS bigint)"


def with_feature_cell(df: DataFrame, srid: int, name: str = "cell") -> DataFrame:
    """``df`` with the quadtree cell of each envelope: the smallest whose double square, to the right and upwards, holds it.

    The cell holds the lower left corner, level 16 are the grid squares. Cells are numbered so that a cell comes before
    the cells within it and these lie together: what may meet a box is a few ranges of numbers, however
    large single features of the layer are (:func:`box_ranges`), and rows in this order keep neighbours in
    the same Parquet row groups. A row without an envelope has no cell.
    """
    kept = [f"`{c}`" for c in df.columns if c != name]
    squares = [f"{_square_sql(axis + end, srid, axis)} AS _{axis}_{end}" for axis in "xy" for end in ("min", "max")]
    there = " AND ".join(f"{axis}{end} IS NOT NULL" for axis in "xy" for end in ("min", "max"))
    wide = "greatest(_x_max - _x_min, _y_max - _y_min)"
    spans = ", ".join(f"shiftright(_{a}_max, _least) - shiftright(_{a}_min, _least)" for a in "xy")
    return (
        df.selectExpr(*kept, *squares)
        .selectExpr("*", f"CASE WHEN {wide} > 1 THEN length(bin({wide} - 1)) - 1 ELSE 0 END AS _least")
        .selectExpr("*", f"CASE WHEN greatest({spans}) > 1 THEN _least + 1 ELSE _least END AS _shift")
        .select("*", _spread(F.col("_x_min")).bitwiseOR(F.shiftleft(_spread(F.col("_y_min")), 1)).alias("_corner"))
        .selectExpr(*kept, f"CASE WHEN {there} THEN shiftleft(shiftright(_corner, 2 * _shift), 2 * _shift) * {LEVEL_FACTOR} + ({CELL_BITS} - _shift) END AS `{name}`")
    )


def _interleaved(x: int, y: int) -> int:
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(CELL_BITS))


def _square(value: float, srid: int, axis: str) -> int:
    offset, width = _domain(srid, axis)
    top = (1 << CELL_BITS) - 1
    place = (value + offset) / width * (top + 1)
    return top if place >= top else 0 if not place > 0 else int(place)


def box_ranges(box: tuple[float, float, float, float], srid: int, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Ranges of cell numbers, ends included, that hold every feature whose envelope meets the box; about ``most`` of them.

    The quadtree is walked from the root, widest cells first. A cell whose double square the box covers counts with
    all within it, one that only meets it counts alone and its quarters are looked at; when there are enough
    ranges, what is left counts whole. The ranges may hold features outside the box, never miss one in it.
    """
    left, low, right, high = (_square(v, srid, a) for v, a in zip(box, "xyxy", strict=True))
    out, queue = [], [(0, 0, 0)]
    while queue:
        level, x, y = queue.pop(0)
        size = 1 << (CELL_BITS - level)
        if x * size > right or (x + 2) * size - 1 < left or y * size > high or (y + 2) * size - 1 < low:
            continue
        corner = _interleaved(x * size, y * size)
        first = corner * LEVEL_FACTOR + level
        covered = left <= x * size and (x + 2) * size - 1 <= right and low <= y * size and (y + 2) * size - 1 <= high
        if covered or level == CELL_BITS or len(out) + len(queue) >= most:
            out.append((first, (corner + size * size) * LEVEL_FACTOR - 1))
        else:
            out.append((first, first))
            queue += [(level + 1, 2 * x + i, 2 * y + j) for j in (0, 1) for i in (0, 1)]
    merged: list[tuple[int, int]] = []
    for first, last in sorted(out):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def in_ranges(cell_: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a cell number lies in one of the ranges, as comparisons that Parquet takes."""
    return functools.reduce(lambda a, b: a | b, [cell_ == a if a == b else cell_.between(a, b) for a, b in ranges], F.lit(False))


# --- web map tiles -------------------------------------------------------------


def tile_x(lon: Column, zoom: int = MAX_ZOOM) -> Column:
    n = 1 << zoom
    return _clamp((lon + 180.0) / 360.0 * float(n), n)


def tile_y(lat: Column, zoom: int = MAX_ZOOM) -> Column:
    n = 1 << zoom
    return _clamp((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * float(n), n)


def _clamp(t: Column, n: int) -> Column:
    return F.least(F.greatest(F.floor(t), F.lit(0)), F.lit(n - 1)).cast("bigint")


# --- LiDAR grid ------------------------------------------------------------------


def tile_box(grid_x: Column, grid_y: Column) -> dict[str, Column]:
    """Metric box of a tile from its grid numbers."""
    xmin = grid_x.cast("bigint") * TILE_EAST_STEP
    ymin = grid_y.cast("bigint") * TILE_NORTH_STEP + TILE_NORTH_BASE
    return {"xmin": xmin, "ymin": ymin, "xmax": xmin + TILE_SIDE, "ymax": ymin + TILE_SIDE}
