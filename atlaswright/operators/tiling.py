"""Tile operators: pyramid counts and the tiles that boxes meet (TL-1, 2, 4, 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import tiles as t


def pyramid(tiles: DataFrame, top: int, bottom: int) -> DataFrame:
    """``tiles(x, y, n)`` of zoom ``top`` and every overview down to ``bottom``: each level sums
    the four tiles of the one above it, so levels shrink as they go."""
    level = tiles.select("x", "y", "n")
    out = level.select(F.lit(top).alias("zoom"), "x", "y", "n")
    for zoom in range(top - 1, bottom - 1, -1):
        level = level.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(F.sum("n").alias("n"))
        out = out.union(level.select(F.lit(zoom).alias("zoom"), "x", "y", "n"))
    return out


def tiles_of_boxes(boxes: DataFrame, size: int) -> DataFrame:
    """The tiles of ``size`` units that each box meets."""
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    return boxes.select("id", F.explode(F.sequence(at("x0"), at("x1"))).alias("tx"), "y0", "y1").select("id", "tx", F.explode(F.sequence(at("y0"), at("y1"))).alias("ty"))


def extents(maps: DataFrame, zoom: int) -> DataFrame:
    """TL-1, 2: of maps ``(id, west, south, east, north)`` in degrees the range of tiles, their number, and the extent in pixels
    from the first tile's corner: ``(id, x0, y0, x1, y1, tiles, left, top, right, bottom)``."""
    rows = maps.withColumn("t", t.extent_tiles(F.col("west"), F.col("south"), F.col("east"), F.col("north"), zoom))
    left, top = t.metres_to_pixels(*g.to_metres(F.col("west"), F.col("north")), F.col("t.x0"), F.col("t.y0"), zoom)
    right, bottom = t.metres_to_pixels(*g.to_metres(F.col("east"), F.col("south")), F.col("t.x0"), F.col("t.y0"), zoom)
    n = (F.col("t.x1") - F.col("t.x0") + 1).cast("long") * (F.col("t.y1") - F.col("t.y0") + 1)
    return rows.select("id", "t.*", n.alias("tiles"), left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def cover(maps: DataFrame, zoom: int) -> DataFrame:
    """TL-1: a row ``(id, x, y)`` for each tile of the extents of maps."""
    rows = extents(maps, zoom).select("id", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1")
    return rows.select("id", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def ring_tiles(rings: DataFrame, zoom: int) -> DataFrame:
    """TL-1 for shapes: the tiles ``(id, x, y)`` that share area with each of ``rings(id, ring)``, in coordinates from 0 to 1 east and
    south across the whole pyramid. From the one tile at the top each level keeps those of the four quarters that a ring still meets,
    so the work follows the ring rather than its box."""
    level = rings.select("id", "ring", F.lit(0).alias("x"), F.lit(0).alias("y"))
    quarter = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    for k in range(1, zoom + 1):
        side = 1.0 / (1 << k)
        level = level.select("id", "ring", F.explode(quarter).alias("q"), "x", "y").select("id", "ring", (2 * F.col("x") + F.col("q.i")).alias("x"), (2 * F.col("y") + F.col("q.j")).alias("y"))
        level = level.withColumns({"x0": F.col("x") * side, "y0": F.col("y") * side, "x1": (F.col("x") + 1) * side, "y1": (F.col("y") + 1) * side})
        level = level.where(g.ring_overlap(F.col("ring"), g.box_ring()) > 1e-12 * side * side).select("id", "ring", "x", "y")
    return level.select("id", "x", "y")
