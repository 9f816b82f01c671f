"""Classification of shapes by metrics and colour (SC-21, 22, 36, JN-24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour


def shape_type(kind: Column, background: Column, aspect: Column, coverage: Column, box_share: Column, corners: Column, next_kind: Column) -> Column:
    """SC-21: the first rule that holds; ``kind`` is the geometry's type."""
    multi, line = kind == "MultiPolygon", kind.contains("LineString")
    return (
        F.when(background, "excluded")
        .when((box_share > 0.001) & multi, "boundary")
        .when((next_kind == "text") & (coverage < 0.5) & (box_share < 0.001), "excluded")
        .when(line | ((coverage < 0.4) & ~multi), "connection")
        .when(corners == 4, "port")
        .when((box_share > 0.001) & (coverage > 0.9), "component")
        .when((box_share < 0.0003) & (coverage > 0.7) & (coverage <= 0.8), "annotation")
        .when((box_share < 0.001) & (coverage > 0.75), "component")
        .otherwise("unclassified")
    )


def paint_category(fill: Column, stroke: Column) -> Column:
    """SC-36: what an element's paint says it is; without paint, nothing."""
    return F.when(fill.isNotNull() & stroke.isNotNull(), "region").when(fill.isNotNull(), "nuclei").when(stroke.isNotNull(), "plexus")


def palette_join(shapes: DataFrame, palette: DataFrame, default: str, threshold: float = colour.THRESHOLD) -> DataFrame:
    """JN-24: for each shape the kind of the first palette entry (``ord, colour, kind``) within
    the threshold; every distinct colour is compared once. A palette is a fixed list of a
    few dozen entries."""
    distinct = shapes.select("colour").distinct().withColumn("s", colour.lab(F.col("colour")))
    entries = palette.select("ord", "kind", colour.lab(F.col("colour")).alias("p"))
    near = distinct.join(F.broadcast(entries), colour.delta_e(F.col("s"), F.col("p")) < threshold).groupBy("colour").agg(F.min_by("kind", "ord").alias("kind"))
    return shapes.join(near, "colour", "left").withColumn("kind", F.coalesce("kind", F.lit(default)))
