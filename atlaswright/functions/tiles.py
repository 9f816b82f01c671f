"""Tile arithmetic of the web-mercator pyramid (TL-1, 2, 3, 7)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_x(lng: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.least(F.greatest(F.floor((lng + 180) / 360 * n), F.lit(0)), F.lit(n - 1)).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    """Rows count from the north."""
    n = 1 << zoom
    s = F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat)))
    return F.least(F.greatest(F.floor((1 - s / math.pi) / 2 * n), F.lit(0)), F.lit(n - 1)).cast("int")


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """A digit a level, the bits of ``y`` and ``x`` from the highest down."""
    bit = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(F.lit(1))
    digits = F.transform(F.sequence(F.lit(zoom - 1), F.lit(0), F.lit(-1)), lambda k: (bit(x, k) + 2 * bit(y, k)).cast("string"))
    return F.array_join(digits, "") if zoom else F.lit("")


def flipped(y: Column, zoom: Column) -> Column:
    """The row as tile stores count it, from the south."""
    return F.call_function("shiftleft", F.lit(1), zoom) - 1 - y


def tile_bounds(x: Column, y: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a tile in degrees."""
    n = 1 << zoom
    lat = lambda row: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * row / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


#: Pixels of a tile's side.
PIXELS = 512
#: How far inside its east and south edges an extent ends, in degrees.
_EDGE = 1e-11


def extent_tiles(west: Column, south: Column, east: Column, north: Column, zoom: int) -> Column:
    """TL-1: the first and last tile of an extent: ``struct<x0,y0,x1,y1>``."""
    return F.struct(tile_x(west, zoom).alias("x0"), tile_y(north, zoom).alias("y0"), tile_x(east - _EDGE, zoom).alias("x1"), tile_y(south + _EDGE, zoom).alias("y1"))


def metres_to_pixels(x: Column, y: Column, first_x: Column, first_y: Column, zoom: int) -> tuple[Column, Column]:
    """TL-2: world metres to pixels from the upper left corner of a first tile."""
    side = 2 * math.pi * 6378137.0 / (1 << zoom)
    half = math.pi * 6378137.0
    return ((x + half) / side - first_x) * PIXELS, ((half - y) / side - first_y) * PIXELS


def pixels_to_metres(px: Column, py: Column, first_x: Column, first_y: Column, zoom: int) -> tuple[Column, Column]:
    """TL-2 the other way."""
    side = 2 * math.pi * 6378137.0 / (1 << zoom)
    half = math.pi * 6378137.0
    return (px / PIXELS + first_x) * side - half, half - (py / PIXELS + first_y) * side
