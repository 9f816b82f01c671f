"""What maps and reports are written as (SNK-2, 4, 5, 7..9, 12, 14, 16, SC-30, 32, TL-8, TK-5, 7, SO-5, 6)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of files and their kinds; fixed values. Others are named by their suffix.
MIME = {"json": "application/json", "csv": "text/csv", "txt": "text/plain", "xml": "application/xml", "parquet": "application/vnd.apache.parquet"}
#: Colours of paths by kind; fixed values.
PATH_COLOURS = {
    "cns": "#9B1FC1", "intracardiac": "#F19E38", "para-pre": "#3F8F4A", "para-post": "#3F8F4A", "sensory": "#2A62F6", "motor": "#98561D", "somatic": "#98561D", "symp-pre": "#EA3423",
    "symp-post": "#EA3423", "other": "#888", "arterial": "#F00", "venous": "#2F6EBA", "centreline": "#CCC", "error": "#FF0",
}
EXPORTED = ("label", "models", "kind", "source", "sex", "taxons")


def path_colour(kind: Column) -> Column:
    """SC-30: the colour of a kind of path, by default that of ``other``."""
    known = F.create_map(*[F.lit(x) for pair in PATH_COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit(PATH_COLOURS["other"]))


def json_encoded(props: DataFrame, columns: list[str]) -> DataFrame:
    """SC-32: lists and structures of ``columns`` as JSON texts."""
    return props.withColumns({c: F.to_json(c) for c in columns})


def annotation_rows(features: DataFrame) -> DataFrame:
    """SNK-2: per feature its exported properties, bounds, the place of its marker, the type of its
    geometry, and, for lines of two ends, where they start and stop: ``features(id, points, exported...)``."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    bounds = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    at = lambda p: F.array(p["x"], p["y"])
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    is_line = F.size("points") == 2
    kept = [c for c in features.columns if c in EXPORTED]
    kind = F.when(F.size("points") == 1, "Point").when(is_line, "LineString").otherwise("Polygon")
    marker = F.array((bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2)
    return features.select("id", *kept, F.to_json(bounds).alias("bounds"), F.to_json(marker).alias("marker"), kind.alias("geometry"), F.when(is_line, F.to_json(at(first))).alias("path_start"), F.when(is_line, F.to_json(at(last))).alias("path_end"))


def layer_documents(layers: DataFrame, images: DataFrame, details: DataFrame) -> DataFrame:
    """SNK-4: a JSON document per layer with its image layers in order and what its detail layers add:
    ``layers(layer, description)``, ``images(layer, ordinal, id)``, ``details(layer, extra)``."""
    pictures = images.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id"))).alias("i"))
    more = details.groupBy("layer").agg(F.array_sort(F.collect_set("extra")).alias("extras"))
    rows = layers.join(pictures, "layer", "left").join(more, "layer", "left")
    document = F.struct(F.col("layer").alias("id"), "description", F.col("i.id").alias("image-layers"), "extras")
    return rows.select("layer", F.to_json(document).alias("document"))


def map_documents(maps: DataFrame, layers: DataFrame, features: DataFrame) -> DataFrame:
    """SNK-5: a JSON document per map: what it says of itself, its layers, and how many features it has."""
    names = layers.groupBy("map_id").agg(F.array_sort(F.collect_set("layer")).alias("layers"))
    count = features.groupBy("map_id").agg(F.count("*").alias("features"))
    rows = maps.join(names, "map_id", "left").join(count, "map_id", "left")
    own = [c for c in maps.columns if c != "map_id"]
    document = F.struct(F.col("map_id").alias("id"), *own, F.coalesce("layers", F.array().cast("array<string>")).alias("layers"), F.coalesce("features", F.lit(0)).alias("features"))
    return rows.select("map_id", F.to_json(document).alias("document"))


def hierarchy_documents(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """SNK-7: rows ``(part, document)``: a JSON text per node and per link of a hierarchy."""
    return nodes.select(F.lit("nodes").alias("part"), F.to_json(F.struct(F.col("node").alias("id"))).alias("document")).union(
        links.select(F.lit("links"), F.to_json(F.struct(F.col("node").alias("source"), F.col("parent").alias("target"))))
    )


def evidenced(neurons: DataFrame, derivations: DataFrame) -> DataFrame:
    """SNK-8: neurons of two end nodes or more, with their latest derivation: ``neurons(neuron, ends)``,
    ``derivations(neuron, at, evidence)``."""
    latest = derivations.groupBy("neuron").agg(F.max(F.struct("at", "evidence")).alias("d")).select("neuron", F.col("d.evidence").alias("evidence"))
    return neurons.where(F.size(F.array_distinct("ends")) >= 2).join(latest, "neuron", "left")


def missing_reports(blocked: DataFrame) -> DataFrame:
    """SNK-9: the rows of the reports on ``blocked(node, path, map_id)``: ``paths_minimal`` lists each path's
    missing nodes, ``node_minimal`` counts each node's paths, ``node_complete`` adds its maps."""
    text = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    count = F.countDistinct("path").cast("string")
    return functools.reduce(
        DataFrame.union,
        [
            blocked.groupBy(F.col("path").alias("key")).agg(text("node").alias("value")).select(F.lit("paths_minimal").alias("report"), "key", "value"),
            blocked.groupBy("node").agg(count.alias("value")).select(F.lit("node_minimal"), "node", "value"),
            blocked.groupBy("node").agg(F.concat_ws(";", count, text("map_id")).alias("value")).select(F.lit("node_complete"), "node", "value"),
        ],
    )


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SNK-12: ``(suffix, mime, length)`` of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    kinds = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return files.select("path", suffix.alias("suffix"), F.coalesce(F.try_element_at(kinds, suffix), suffix).alias("mime"), "length")


def written_back(sheet: DataFrame, found: DataFrame) -> DataFrame:
    """SNK-14, TK-5: a term sheet ``(section, name, parent, term)`` with the names of ``found(section, name,
    parent)`` that it lacks, their terms blank; ``row`` numbers the rows of a section without regard to case."""
    both = sheet.join(found.distinct().withColumn("new", F.lit(True)), ["section", "name", "parent"], "full_outer")
    rows = both.select("section", F.struct(F.lower("name").alias("k"), F.lower("parent").alias("l"), "name", "parent", F.coalesce("term", F.lit("")).alias("term")).alias("r"))
    return rows.groupBy("section").agg(F.array_sort(F.collect_list("r")).alias("rows")).select("section", F.posexplode("rows").alias("row", "r")).select("section", "row", "r.name", "r.parent", "r.term")


def bond_triples(shapes: DataFrame, connections: DataFrame, kinds: DataFrame) -> DataFrame:
    """SNK-16: triples of a bond graph: nodes have the kind of their border colour, or of the first letter
    of their symbol; connections join nodes, a missing end being ``MISSING``."""
    known = shapes.join(F.broadcast(kinds), "colour", "left")  # a palette: a row per kind
    by_symbol = F.when(F.col("symbol").startswith("u"), "potential").when(F.col("symbol").startswith("v"), "flow").otherwise("node")
    nodes = known.select("id", F.coalesce("kind", by_symbol).alias("kind"))
    end = lambda c: nodes.select(F.col("id").alias(c), F.col("id").alias(f"{c}_known"))
    lines = connections.join(end("source"), "source", "left").join(end("target"), "target", "left")
    row = lambda p, c: lines.select(F.concat(F.lit("L"), "line").alias("s"), F.lit(p).alias("p"), F.coalesce(F.concat(F.lit("N"), f"{c}_known"), F.lit("MISSING")).alias("o"))
    return nodes.select(F.concat(F.lit("N"), "id").alias("s"), F.lit("type").alias("p"), F.col("kind").alias("o")).union(row("hasSource", "source")).union(row("hasTarget", "target"))


#: Levels by which the images of a map with a base feature begin earlier.
BASE_OFFSET = 2


def zoom_hints(features: DataFrame, layers: DataFrame, map_area: float) -> DataFrame:
    """TL-8: ``(id, scale, minzoom, maxzoom, image_minzoom)`` of ``features(id, layer, area, group, minzoom, maxzoom)``: a
    feature's own hints; else the level before its layer's first; else 4 for one outside all groups that is over 2**6 times
    shorter than the map; else none. ``scale`` is that ratio's logarithm, 10 without an area. ``layers(layer, minzoom, detail,
    based)``: its images begin at its first level, one later in a detail layer, ``BASE_OFFSET`` earlier where the map has a base
    feature."""
    own = layers.select("layer", F.col("minzoom").alias("first"), "detail", "based")
    rows = features.join(own, "layer", "left")
    scale = F.when(F.col("area") > 0, F.log2(F.sqrt(map_area / F.col("area"))))
    low = F.coalesce("minzoom", F.when(F.col("first").isNotNull(), F.greatest(F.col("first") - 1, F.lit(0))), F.when((scale > 6) & F.col("group").isNull(), 4))
    images = F.col("first") + F.when(F.col("detail"), 1).otherwise(0) - F.when(F.col("based"), BASE_OFFSET).otherwise(0)
    return rows.select("id", F.round(F.coalesce(scale, F.lit(10.0)), 9).alias("scale"), low.cast("int").alias("minzoom"), F.col("maxzoom").cast("int").alias("maxzoom"), images.cast("int").alias("image_minzoom"))


def by_status(rows: DataFrame, order: list[str]) -> DataFrame:
    """TK-7: the turn of each row ``(status, seq)`` in a report: by status in the order given, others
    last, then by appearance; turns are counted in each status."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    ranked = rows.select("status", "seq", F.when(place > 0, place).otherwise(len(order) + 1).cast("int").alias("section"))
    return ranked.groupBy("section", "status").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def used(drawn: DataFrame, mapped: DataFrame) -> DataFrame:
    """SO-5: the ids of a drawing that are in the map."""
    return drawn.select("id").distinct().join(mapped.select("id"), "id", "left_semi")


def merged_triples(*graphs: DataFrame) -> DataFrame:
    """SO-6: the triples of any of the graphs."""
    return functools.reduce(DataFrame.union, [g.select("s", "p", "o") for g in graphs]).distinct()
