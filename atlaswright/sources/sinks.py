"""What is written: feature documents, annotations, labelled features (SNK-1, 2, 3, 15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Properties of features that are written; fixed values.
EXPORTED = (
    "associated-details", "centreline", "children", "class", "colour", "description", "details-layer", "error", "featureId", "group", "hyperlink", "hyperlinks", "id", "invisible",
    "kind", "label", "labelled", "maxzoom", "minzoom", "models", "name", "nerves", "nerveId", "node", "nodeId", "opacity", "parents", "path-ids", "scale", "sckan", "shape-type",
    "source", "stroke", "stroke-width", "target", "taxons", "tile-layer", "type", "warning", "completeness", "missing-nodes", "alert", "biological-sex", "anatomical-nodes", "userdata",
)
#: Those of them that annotations hold as JSON texts; fixed values.
ENCODED = ("associated-details", "hyperlinks", "userdata")


def _exported(features: DataFrame) -> list[Column]:
    """The exported columns but for ``id``, empty texts as nulls, which JSON leaves out."""
    kinds = dict(features.dtypes)
    return [(F.nullif(F.col(f"`{c}`"), F.lit("")) if kinds[c] == "string" else F.col(f"`{c}`")).alias(c) for c in EXPORTED if c in features.columns and c != "id"]


def _bounds() -> Column:
    of = lambda c, f: f(F.transform("points", lambda p: p[c]))
    return F.array(of("x", F.array_min), of("y", F.array_min), of("x", F.array_max), of("y", F.array_max))


def _coordinates() -> tuple[Column, Column, Column]:
    """Whether the points are one, or a line, or a polygon: its type, and its coordinates as JSON."""
    pairs = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    ring = F.concat(pairs, F.slice(pairs, 1, 1))
    kind = F.when(F.size("points") == 1, "Point").when(F.coalesce("open", F.lit(False)), "LineString").otherwise("Polygon")
    return kind, pairs, ring


def feature_documents(features: DataFrame, map_area: float) -> DataFrame:
    """SNK-1 whole: ``(tile_layer, id, feature)`` of ``features(id, layer, points, open, exclude, "tile-layer", exported ...)``:
    what is excluded is not written; a document has the geometry, its bounds, area, length and layer, how much longer than it the
    map is (as a power of two; 10 without an area), the exported properties, and hints for tiles: its zooms, or from zoom 4 on
    where it is over 2**6 times shorter than the map and in no group."""
    kind, pairs, ring = _coordinates()
    rows = features.where("not coalesce(exclude, false)").withColumn("geometry", kind)
    polygon = F.col("geometry") == "Polygon"
    area = F.when(polygon, F.abs(g.ring_area(F.col("points")))).otherwise(0.0)
    length = g.path_length(F.when(polygon, F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points")))
    rows = rows.withColumns({"area": area, "length": F.round(length, 6)})
    scale = F.when(F.col("area") > 0, F.round(F.log2(F.sqrt(map_area / F.col("area"))), 6)).otherwise(10.0)
    have = lambda c: F.col(c) if c in features.columns else F.lit(None).cast("int")
    low = F.coalesce(have("minzoom"), F.when((F.col("area") > 0) & (scale > 6) & have("group").isNull(), 4))
    tile = F.concat_ws("_", F.replace("layer", F.lit("/"), F.lit("_")), F.replace("`tile-layer`", F.lit("/"), F.lit("_")))
    shape = lambda c: F.struct(F.col("geometry").alias("type"), c.alias("coordinates"))
    text = F.when(F.col("geometry") == "Point", F.to_json(shape(pairs[0]))).when(polygon, F.to_json(shape(F.array(ring)))).otherwise(F.to_json(shape(pairs)))
    hints = F.to_json(F.struct(tile.alias("layer"), have("maxzoom").alias("maxzoom"), low.alias("minzoom")))
    properties = F.to_json(F.struct(_bounds().alias("bounds"), "area", "length", "layer", scale.alias("scale"), *_exported(features.drop("scale"))))
    document = F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit(',"tippecanoe":'), hints, F.lit(',"geometry":'), text, F.lit(',"properties":'), properties, F.lit("}"))
    return rows.select(tile.alias("tile_layer"), "id", document.alias("feature"))


def feature_annotations(features: DataFrame, nodes: DataFrame, centreline_map: bool = False) -> DataFrame:
    """SNK-2 whole: ``(id, annotation)``, a JSON document per feature: exported properties (those of ``ENCODED`` as JSON texts),
    bounds, the place of the marker (inside a polygon, else the middle of the corners), type of geometry and layer; where a line
    starts and ends, and in maps of centrelines these lines' coordinates; and the anatomical nodes that used it, ``nodes(id,
    node)`` with ``node`` as JSON."""
    kind, pairs, _ = _coordinates()
    held = nodes.groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("used"))
    rows = features.where("not coalesce(exclude, false)").withColumn("geometry", kind).join(held, "id", "left")
    kinds = dict(features.dtypes)
    listed = lambda c: F.to_json(F.array(F.col(f"`{c}`")))  # noqa: E731  # a text alone is no document
    encoded = {c: F.substring(listed(c), F.lit(2), F.length(listed(c)) - 2) if kinds[c] == "string" else F.to_json(F.col(f"`{c}`")) for c in ENCODED if c in features.columns}
    rows = rows.withColumns(encoded) if encoded else rows
    mean = lambda c: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[c]) / F.size("points")
    inner = g.representative_point(F.col("points"))
    marker = F.when(F.col("geometry") == "Polygon", F.array(inner["x"], inner["y"])).otherwise(F.array(mean("x"), mean("y")))
    line = F.col("geometry") == "LineString"
    at = lambda k: F.when(line, F.array(F.element_at("points", k)["x"], F.element_at("points", k)["y"]))
    along = F.when(line & (F.col("kind") == "centreline"), pairs) if centreline_map and "kind" in features.columns else F.lit(None).cast("array<array<double>>")
    parts = [*_exported(features), _bounds().alias("bounds"), marker.alias("markerPosition"), "geometry", "layer", at(1).alias("pathStartPosition"), at(-1).alias("pathEndPosition"), along.alias("coordinates")]
    plain = F.to_json(F.struct(*parts))
    with_nodes = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(',"anatomical-nodes":['), F.array_join("used", ","), F.lit("]}"))
    return rows.select("id", F.when(F.col("used").isNull(), plain).otherwise(with_nodes).alias("annotation"))


def geojson(features: DataFrame, tile_layer: str = "features") -> DataFrame:
    """SNK-1: rows ``(tile_layer, id, feature)`` of ``features(id, layer, x0, y0, x1, y1,
    props)``, one document each; write them with ``partitionBy("tile_layer").text``."""
    corner = lambda x, y: F.array(x, y)
    ring = F.array(*[corner(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    document = F.to_json(F.struct(F.lit("Feature").alias("type"), "id", shape.alias("geometry"), F.col("props").alias("properties")))
    return features.select(F.concat_ws("_", F.replace("layer", F.lit("/"), F.lit("_")), F.lit(tile_layer)).alias("tile_layer"), "id", document.alias("feature"))


def labelled(features: DataFrame) -> DataFrame:
    """SNK-3: id, models and label of features that have a model, as JSON."""
    return features.where("models is not null").select("id", F.to_json(F.struct("id", "models", "label")).alias("feature"))


def shape_triples(shapes: DataFrame) -> DataFrame:
    """SNK-15: type, label, comment and ends of ``shapes(id, kind, label, name, source, target)``."""
    row = lambda p, o, where="true": shapes.where(where).select(F.col("id").alias("s"), F.lit(p).alias("p"), F.col(o).alias("o"))
    return row("type", "kind").union(row("label", "label", "label is not null")).union(row("comment", "name", "lower(name) <> lower(label)")).union(row("hasSource", "source", "source is not null")).union(row("hasTarget", "target", "target is not null"))
