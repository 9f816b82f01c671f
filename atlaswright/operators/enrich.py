"""Feature enrichment: the property cascade, lookups and visibility (JN-1..5, FLT-1..14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Properties that a shape does not inherit from its group.
NOT_INHERITED = ("class", "group", "id", "markup", "models", "name")


def cascade(features: DataFrame, rules: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """JN-1: properties of ``features(id, classes)`` by rules ``(scope, key, prop, value)``.

    Classes count in order, their term (``terms(class, term)`` as ``models``) before their
    rules, and then the id; later values override. Returns ``(id, prop, value)``."""
    classes = features.select("id", F.posexplode("classes").alias("pos", "key"))
    by_class = classes.join(rules.where("scope = 'class'").drop("scope"), "key").select("id", "prop", "value", (2 * F.col("pos") + 1).alias("priority"))
    by_id = features.select("id", F.col("id").cast("string").alias("key")).join(rules.where("scope = 'id'").drop("scope"), "key").select("id", "prop", "value", F.lit(1 << 30).alias("priority"))
    found = by_class.unionByName(by_id)
    if terms is not None:
        found = found.unionByName(classes.join(terms.toDF("key", "value"), "key").select("id", F.lit("models").alias("prop"), "value", (2 * F.col("pos")).alias("priority")))
    return found.groupBy("id", "prop").agg(F.max_by("value", "priority").alias("value"))


def as_map(properties: DataFrame) -> DataFrame:
    """``(id, prop, value)`` to one sorted entry list per id; empty values are not set."""
    return properties.where("value is not null and value <> ''").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "value")))).alias("props"))


def class_terms(features: DataFrame, anatomical_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-2: each feature's term by its class, and the classes that have none, once."""
    joined = features.join(anatomical_map, "class", "left")
    return joined.select("id", "class", "term"), features.select("class").distinct().join(anatomical_map, "class", "left_anti")


def labelled(features: DataFrame, knowledge: DataFrame) -> DataFrame:
    """JN-3, SRC-12: label and taxons of ``features(id, models, name)``: the knowledge's label,
    else the model itself; without a model, the name."""
    known = features.join(knowledge.withColumnRenamed("entity", "models"), "models", "left")
    return known.select("id", "models", F.when(F.col("models").isNull(), F.col("name")).otherwise(F.coalesce("label", "models")).alias("label"), F.coalesce("taxons", F.array().cast("array<string>")).alias("taxons"))


def marker_kind(datasets: Column, scaffolds: Column, simulations: Column) -> Column:
    """JN-4."""
    return F.when(datasets.isNotNull(), "dataset").when(scaffolds.isNotNull(), "scaffold").when(simulations.isNotNull(), "simulation")


def tag_lines(features: DataFrame, lines: DataFrame, nerves: DataFrame) -> DataFrame:
    """JN-5: features that paths name as a line, else as a nerve: ``lines(feature, path)``."""
    first = lambda df, name: df.groupBy(F.col("feature").alias("id")).agg(F.array_sort(F.collect_set("path")).alias(name))
    out = features.join(first(lines, "line_paths"), "id", "left").join(first(nerves, "nerve_paths"), "id", "left")
    return out.withColumn("type", F.when(F.col("line_paths").isNotNull(), "line").when(F.col("nerve_paths").isNotNull(), "nerve"))


def filtered_paths(paths: DataFrame, include: DataFrame, trace: DataFrame, exclude: DataFrame) -> DataFrame:
    """FLT-1: included or traced paths (all, where neither names one) that are not excluded."""
    wanted = include.select("path").union(trace.select("path")).distinct()
    anything = wanted.limit(1).select(F.lit(True).alias("some"))
    kept = paths.join(wanted.withColumn("hit", F.lit(True)), "path", "left").join(F.broadcast(anything), how="left").where("some is null or hit")
    return kept.drop("some", "hit").join(exclude.select("path").distinct(), "path", "left_anti")


def compatible_sex(a: Column, b: Column) -> Column:
    """FLT-2."""
    return a.isNull() | b.isNull() | (a == b)


def output_rows(features: DataFrame, authoring: bool = False) -> DataFrame:
    """FLT-4: excluded rows go, and erroneous ones unless authoring, when warnings stay too."""
    kept = features.where(~F.coalesce(F.col("exclude"), F.lit(False)))
    return kept if authoring else kept.where(F.col("error").isNull()).withColumn("warning", F.lit(None).cast("string"))


def whitelisted(props: Column, allowed: list[str]) -> Column:
    """FLT-5, D: properties that are output."""
    return F.map_filter(props, lambda k, v: k.isin(allowed) & v.isNotNull() & (v != ""))


def default_visibility(features: DataFrame) -> DataFrame:
    """FLT-6: hidden by class, as a node, or as a nerve that is no centreline; nerves and
    nodes go to the layer of pathways."""
    hidden = (F.col("class") == "auto-hide") | (F.col("kind") == "node") | ((F.col("kind") == "nerve") & ~F.coalesce(F.col("centreline"), F.lit(False)))
    return features.withColumn("exclude", F.coalesce(hidden, F.lit(False))).withColumn("tile_layer", F.when(F.col("kind").isin("nerve", "node"), "pathways").otherwise("features"))


def visible_again(features: DataFrame, used: DataFrame) -> DataFrame:
    """FLT-7: what a path uses is shown."""
    hit = used.select("id").distinct().withColumn("hit", F.lit(True))
    return features.join(hit, "id", "left").withColumn("exclude", F.when(F.col("hit"), False).otherwise(F.col("exclude"))).drop("hit")


def network_only(features: DataFrame, network_ids: DataFrame) -> DataFrame:
    """FLT-8."""
    hit = network_ids.select("id").distinct().withColumn("hit", F.lit(True))
    return features.join(hit, "id", "left").where("hit or tile_layer = 'pathways'").drop("hit")


def first_of_each_id(features: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """FLT-9: the first feature of an id, and those rejected."""
    first = features.groupBy("id").agg(F.min(order).alias("first"))
    joined = features.join(first, "id")
    return joined.where(F.col(order) == F.col("first")).drop("first"), joined.where(F.col(order) != F.col("first")).drop("first")


def inherited(shapes: DataFrame) -> DataFrame:
    """FLT-11: properties of ``shapes(id, parent, props)`` with those of the group below their own."""
    groups = shapes.select(F.col("id").alias("parent"), F.map_filter("props", lambda k, v: ~k.isin(*NOT_INHERITED)).alias("up"))
    rest = F.map_filter("up", lambda k, v: ~F.map_contains_key("props", k))
    return shapes.join(groups, "parent", "left").select("id", "parent", F.when(F.col("up").isNull(), F.col("props")).otherwise(F.map_concat(rest, "props")).alias("props"))


def painted(shapes: DataFrame) -> DataFrame:
    """FLT-12, 13: shapes that make features: painted or named, and not just path, invisible or styling."""
    return shapes.where("(fill is not null or stroke is not null or id is not null) and not (is_path or invisible or styling)")


def hyperlinks(shapes: DataFrame) -> DataFrame:
    """FLT-14: hyperlinks of each parent, ``(id, url)`` in order."""
    return shapes.where("kind = 'hyperlink'").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("id", "url"))).alias("hyperlinks"))


def filled_labels(terms: DataFrame, knowledge: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    """JN-39: the label of each term of a map, by ``knowledge(entity, label)``; unknown ones are marked."""
    return terms.join(knowledge.toDF("term", "label"), "term", "left").select("term", F.coalesce("label", F.lit(unknown)).alias("label"))
