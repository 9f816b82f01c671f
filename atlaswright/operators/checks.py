"""Checks of whole networks, functional drawings, proxies and layers (QA-17, 19, 22, 24, 26), each giving rows of the one
issue schema of ``quality``, a row for each thing found."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import issue


def _all(*parts: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _listed(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ", ")


def centreline_checks(centrelines: DataFrame, terms: DataFrame, nerves: DataFrame) -> DataFrame:
    """QA-17 of ``centrelines(seq, id, models, nodes, containers)`` in order of ``seq``: no id; an id that an earlier one has;
    fewer than two nodes; another model than the properties give it (``terms(feature, models)``); containers without a term, that
    model another nerve than the centreline (``nerves(feature, models)``), or that are an end of a centreline; nodes inside
    several centrelines, or inside one and at the end of several. Those without an id, or with one that is taken, are checked no
    further."""
    place = lambda text: F.concat_ws("/", "id", text)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    named = centrelines.where("id is not null").withColumn("nth", nth)
    first = named.where("nth = 1").drop("nth")
    modelled = first.join(terms.select(F.col("feature").alias("id"), F.col("models").alias("known")), "id", "left")
    inside = first.select("id", "models", F.explode(F.array_distinct("containers")).alias("feature"))
    known = inside.join(terms.select("feature", F.lit(True).alias("term")).distinct(), "feature", "left").join(nerves.select("feature", F.col("models").alias("nerve")), "feature", "left")
    whole = first.where(F.size("nodes") >= 2)
    ends = whole.select("id", F.explode(F.array_distinct(F.array(F.element_at("nodes", 1), F.element_at("nodes", -1)))).alias("feature"))
    kept = known.where("term and nerve is null").select("id", "feature").distinct()
    middle = whole.select("id", F.explode(F.array_distinct(F.slice("nodes", 2, F.greatest(F.size("nodes") - 2, F.lit(0))))).alias("feature"))
    many = middle.groupBy("feature").agg(F.countDistinct("id").alias("n"), _listed("id").alias("ids"))
    branches = ends.groupBy("feature").agg(F.countDistinct("id").alias("n"), _listed("id").alias("ids")).where("n > 1").join(middle.select("feature").distinct(), "feature", "left_semi")
    q = functools.partial(issue, kind="centreline", code="QA-17")
    return _all(
        q(centrelines.where("id is null"), location=F.col("seq"), text=F.lit("Centreline has no id")),
        q(named.where("nth > 1"), location=F.concat_ws("/", "id", "seq"), text=F.lit("Centreline has a duplicate id")),
        q(first.where(F.size("nodes") < 2), location=F.col("id"), text=F.lit("Centreline has too few nodes")),
        q(modelled.where("models <> known"), location=F.col("id"), text=F.concat(F.lit("Centreline models two entities: "), "models", F.lit(", "), "known")),
        q(known.where("term is null"), location=place("feature"), text=F.lit("Container has no anatomical term")),
        q(known.where("term and nerve <> models"), location=place("feature"), text=F.lit("Container models a different nerve")),
        q(kept.join(ends.select("feature").distinct(), "feature", "left_semi"), location=place("feature"), text=F.lit("Container is also an end node")),
        q(many.where("n > 1"), location=F.col("feature"), text=F.concat(F.lit("Node is inside several centrelines: "), "ids")),
        q(branches, location=F.col("feature"), text=F.concat(F.lit("Inner node branches to several centrelines: "), "ids")),
    )


def nerve_checks(properties: DataFrame) -> DataFrame:
    """QA-19 of ``properties(seq, feature, type, models)`` in order: a nerve's term that an earlier feature has, and a feature
    that an earlier row has given a term."""
    rows = properties.where("type = 'nerve' and models is not null")
    again = lambda key: rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where("nth > 1")
    q = functools.partial(issue, kind="nerve", code="QA-19")
    return _all(
        q(again("models"), location=F.concat_ws("/", "models", "feature"), text=F.lit("Nerve has already been assigned to a feature")),
        q(again("feature"), location=F.concat_ws("/", "feature", "models"), text=F.lit("Feature has already been assigned a model")),
    )


def functional_checks(shapes: DataFrame, parents: DataFrame, connections: DataFrame) -> DataFrame:
    """QA-22 of ``shapes(id, name, class, kind)``, whose ``parents(id, parent)``, and ``connections(id, source, target,
    colour_kind)``, null being an end that meets no connector. Connectors have the class ``neural`` or ``vascular`` and as
    ``kind`` what their colour stands for; others are organs, units, regions and so on."""
    of = shapes.select("id", "name", "class", "kind")
    up = parents.join(of.select(F.col("id").alias("parent"), F.col("class").alias("above")), "parent", "left")
    rows = of.join(up.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("above") == "system").alias("systems"), F.count_if(F.col("above") == "organ").alias("organs"), F.count_if(F.col("above") == "unit").alias("units")), "id", "left").na.fill(0, ["n", "systems", "organs", "units"])
    ports = F.col("class").isin("neural", "vascular")
    end = lambda c: of.where(ports).select(F.col("id").alias(c), F.col("class").alias(f"{c}_class"), F.col("kind").alias(f"{c}_kind"))
    lines = connections.select("id", "source", "target", "colour_kind").join(end("source"), "source", "left").join(end("target"), "target", "left")
    q = functools.partial(issue, code="QA-22")
    say = lambda df, kind, text: q(df, kind=kind, location=F.col("id"), text=text if isinstance(text, Column) else F.lit(text))
    return _all(
        say(rows.where("class = 'organ' and coalesce(name, '') = ''"), "organ", "An organ must have a name"),
        say(rows.where("class = 'organ' and systems = 0"), "organ", "An organ must be in at least one system"),
        say(rows.where("class in ('unit', 'region') and organs > 1"), "unit", "Units and regions can only be in a single organ"),
        say(rows.where(ports & (F.col("n") == 0)), "connector", "Connector has no parent"),
        say(rows.where("class = 'neural' and n > 0 and units = 0"), "connector", "Connector is not in a unit"),
        say(lines.where("source_class is null or target_class is null"), "connection", "Connection has unconnected ends"),
        say(lines.where("source_class <> target_class"), "connection", F.concat(F.lit("Connection ends are not compatible: "), "source_class", F.lit(", "), "target_class")),
        say(lines.where("colour_kind is null"), "connection", "Connection's colour is of no known kind"),
        say(lines.where("colour_kind <> source_kind"), "connection", F.concat(F.lit("Connection's kind is not its connector's: "), "colour_kind", F.lit(", "), "source_kind")),
    )


def proxy_checks(proxies: DataFrame, features: DataFrame) -> DataFrame:
    """QA-24 of ``proxies(models, host)`` on ``features(id, models, geometry)``: what is proxied is on the map already, and then
    nothing more is looked at; a host that is not there; a host's feature that is no polygon."""
    have = features.select("models").distinct()
    on_map = proxies.select("models").distinct().join(have, "models", "left_semi")
    rest = proxies.join(on_map, "models", "left_anti")
    shapes = rest.join(features.select("id", F.col("models").alias("host"), "geometry"), "host")
    q = functools.partial(issue, kind="proxy", code="QA-24")
    pair = F.concat_ws("/", "models", "host")
    return _all(
        q(on_map, location=F.col("models"), text=F.lit("Proxied feature is already on the map")),
        q(rest.join(have.toDF("host"), "host", "left_anti").distinct(), location=pair, text=F.lit("Proxy is missing from the map")),
        q(shapes.where("geometry <> 'Polygon'"), location=F.concat_ws("/", "models", "id"), text=F.lit("Proxy feature must have a polygon shape")),
    )


def layer_checks(layers: DataFrame, features: DataFrame) -> DataFrame:
    """QA-26 of ``layers(map_id, seq, id, kind, feature, zoom)``, the sources of maps in order, and ``features(map_id, id)``: an
    id twice on a map; details as the first, which is the base map; a later one that is of no kind for details, images or layers;
    of details, no feature or an unknown one, and a zoom below 1."""
    details = F.col("kind").isin("details", "anatomical", "functional")
    first = F.row_number().over(Window.partitionBy("map_id").orderBy("seq")) == 1
    again = F.row_number().over(Window.partitionBy("map_id", "id").orderBy("seq"))
    rows = layers.withColumns({"first": first, "again": again})
    fits = rows.where(details).join(features.select("map_id", F.col("id").alias("feature"), F.lit(True).alias("known")).distinct(), ["map_id", "feature"], "left")
    q = functools.partial(issue, kind="layer", code="QA-26", location=F.col("id"))
    return _all(
        q(rows.where("again > 1"), text=F.lit("Duplicate layer id")),
        q(rows.where(F.col("first") & (F.col("kind") == "details")), text=F.lit("Details layer cannot be the base map")),
        q(rows.where(~F.col("first") & ~details & ~F.col("kind").isin("image", "layer")), text=F.lit("Can only have a single base map")),
        q(fits.where("feature is null"), text=F.lit("Details need a feature")),
        q(fits.where("feature is not null and known is null"), text=F.concat(F.lit("Unknown source feature: "), F.col("feature").cast("string"))),
        q(fits.where("coalesce(zoom, 0) < 1"), text=F.lit("Details need a zoom")),
    )
