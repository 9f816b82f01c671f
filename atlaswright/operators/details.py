"""Detail layers, groups, functional components and lines of drawings (JN-18, 20, 28, 35..37, AG-19, 22, 26, 27, FLT-3, 10, 15,
GR-16, SC-22, 23, 25, 29, 33, 38, 40, WN-9)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graph, spatial


def connected_only(paths: DataFrame, disconnected: bool = False) -> DataFrame:
    """FLT-3: paths that are connected, or on request all."""
    return paths if disconnected else paths.where(~F.coalesce("path_disconnected", F.lit(False)))


def display_copy(elements: DataFrame, layers: list[str], kinds: list[str]) -> DataFrame:
    """FLT-10: elements ``(id, at, layer, kind, exclude)`` of a drawing that its display copy keeps: not of
    an excluded layer or kind, not flagged, and in no such element; ``at`` is an element's path of ordinals."""
    bad = F.coalesce(F.col("layer").isin(layers), F.lit(False)) | F.coalesce(F.col("kind").isin(kinds), F.lit(False)) | F.coalesce("exclude", F.lit(False))
    gone = elements.where(bad).select(F.col("at").alias("prefix")).distinct()
    prefixes = elements.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("at")), lambda k: F.slice("at", 1, k))).alias("prefix"))
    return elements.join(prefixes.join(gone, "prefix", "left_semi").select("id").distinct(), "id", "left_anti")


def drawn_centrelines(features: DataFrame, exported: DataFrame) -> DataFrame:
    """FLT-15: centrelines with an id, in an exported layer and not excluded, as drawn connections."""
    rows = features.where("centreline and id is not null and not coalesce(exclude, false)").join(exported.select("layer").distinct(), "layer", "left_semi")
    return rows.select("id", "layer", F.lit("centreline").alias("kind"), F.lit("centreline").alias("type"))


def end_components(ends: DataFrame, components: DataFrame, buffer: int) -> DataFrame:
    """JN-18: for each line end ``(line, end, x, y)`` the components within ``buffer``: ports first, the
    smallest, then the least id is its ``terminal``, and ``touched`` counts all."""
    boxes = ends.select(F.concat_ws("/", "line", "end").alias("id"), "line", "end", *[(F.col(c) + d * buffer).alias(n) for n, c, d in (("x0", "x", -1), ("y0", "y", -1), ("x1", "x", 1), ("y1", "y", 1))])
    pairs = spatial.box_pairs(boxes, components)
    first = F.min(F.struct((~F.col("b_port")).alias("k"), g.area("b_").alias("area"), "b_id"))
    return pairs.groupBy(F.col("a_line").alias("line"), F.col("a_end").alias("end")).agg(first.alias("m"), F.count("*").alias("touched")).select("line", "end", F.col("m.b_id").alias("terminal"), "touched")


def touching(ends: DataFrame, components: DataFrame, buffer: int) -> DataFrame:
    """JN-18, the other way round: the lines that touch each component with an end: ``(component, lines)``."""
    boxes = ends.select(F.concat_ws("/", "line", "end").alias("id"), "line", *[(F.col(c) + d * buffer).alias(n) for n, c, d in (("x0", "x", -1), ("y0", "y", -1), ("x1", "x", 1), ("y1", "y", 1))])
    pairs = spatial.box_pairs(boxes, components)
    return pairs.groupBy(F.col("b_id").alias("component")).agg(F.array_sort(F.collect_set("a_line")).alias("lines"))


def connection_nodes(connectors: DataFrame, parents: DataFrame, components: DataFrame, intermediates: DataFrame) -> DataFrame:
    """AG-29: ``(connection, nodes, free_end)``: the connectors of a connection ``(connection, connector, kind)``, their parents
    ``(connector, parent)``, the components ``(connection, component)`` it crosses and the connectors ``(connection, connector)``
    it passes; whether one of its own is a free end or a joiner."""
    up = connectors.join(parents, "connector").select("connection", F.col("parent").alias("node"))
    every = connectors.select("connection", F.col("connector").alias("node")).union(up).union(components.select("connection", "component")).union(intermediates.select("connection", "connector"))
    nodes = every.groupBy("connection").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    free = connectors.groupBy("connection").agg(F.bool_or(F.col("kind").isin("free-end", "joiner")).alias("free_end"))
    return nodes.join(free, "connection", "left").select("connection", "nodes", F.coalesce("free_end", F.lit(False)).alias("free_end"))


def line_classes(lines: DataFrame, connectors: DataFrame) -> DataFrame:
    """JN-20: ``(line, class, issue)``: a line has the class of its ends; one end without a class takes
    the other's, two different ones are an issue: ``lines(line, source, target)``, ``connectors(id, class)``."""
    c = connectors.select("id", "class")
    rows = lines.join(c.toDF("source", "a"), "source", "left").join(c.toDF("target", "b"), "target", "left")
    return rows.select("line", F.when(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b")), F.coalesce("a", "b")).alias("class"), F.when(F.col("a") != F.col("b"), F.concat_ws(" and ", "a", "b")).alias("issue"))


def unit_children(units: DataFrame, children: DataFrame) -> DataFrame:
    """JN-28: for each functional unit ``(unit, model, path_type)`` the child ``(unit, child, kind, model,
    path_type)`` that a path ends at: a unit of the same model, else a connector of a type that differs at
    most in being pre or post; the least of equals."""
    plain = lambda c: F.regexp_replace(c, "-(pre|post)$", "")
    rows = children.join(units.select("unit", F.col("model").alias("own"), F.col("path_type").alias("wanted")), "unit")
    rank = F.when((F.col("kind") == "unit") & (F.col("model") == F.col("own")), 0).when((F.col("kind") == "connector") & (plain("path_type") == plain("wanted")), 1)
    return rows.withColumn("rank", rank).where("rank is not null").groupBy("unit").agg(F.min(F.struct("rank", "child")).alias("m")).select("unit", "m.child", "m.rank")


def ensured_systems(parents: DataFrame, kinds: DataFrame) -> DataFrame:
    """GR-16: ``(id, system)`` of the components whose way up ``parents(id, parent)`` meets a system before
    any unit or organ: the first system on it. A step up a round, until nobody is on the way; containment
    that runs in a circle is an error."""
    kind = kinds.select("id", "kind")
    here, found = graph.cut(parents.select("id", F.col("parent").alias("at"))), []
    while not here.isEmpty():
        if not here.where("id = at").isEmpty():  # whoever is on a circle comes back to itself
            raise ValueError("components contain each other in a circle")
        at = graph.cut(here.join(kind.withColumnRenamed("id", "at"), "at", "left"))
        found.append(at.where("kind = 'system'").select("id", F.col("at").alias("system")))
        here = graph.cut(at.where("kind is null or kind not in ('system', 'unit', 'organ')").join(parents.toDF("at", "up"), "at").select("id", F.col("up").alias("at")))
    return functools.reduce(DataFrame.union, found)


def attached_details(features: DataFrame, details: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-35: features ``(id, details)`` with the detail layer they open, and the connections of all that is
    associated with them, tagged with it: ``details(layer, associated)``, ``connections(id, connection)``."""
    opened = features.where("details is not null").join(details.select(F.col("layer").alias("details"), "associated"), "details")
    # a layer counts once, however many features open it, and a feature hands on all its layers at once
    of = details.join(features.select(F.col("details").alias("layer")).distinct(), "layer", "left_semi").select("layer", F.explode("associated").alias("id"))
    layers = of.groupBy("id").agg(F.collect_set("layer").alias("layers"))
    tagged = connections.select("id", "connection").distinct().join(layers, "id").groupBy("connection").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("layers")))).alias("layers"))
    return opened.select("id", "details"), tagged


def replicated(hosts: DataFrame, boundaries: DataFrame, members: DataFrame) -> DataFrame:
    """JN-36: copies ``(host, path, id, x0, y0, x1, y1)`` of the members of the detail layer that each host opens, fitted from the
    box of the layer's boundary to the host's: ``hosts(host, layer, x0 .. y1)``, ``boundaries(layer, x0 .. y1)``, ``members(layer,
    id, x0 .. y1, details)``. A member that opens a layer itself is the host of it where it has been put, to any depth; a layer
    that opens itself again, by way of others or not, is an error."""
    c = F.col
    edge = boundaries.select("layer", *[c(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")])
    inner = members.select("layer", "id", "details", *[c(k).alias(f"m_{k}") for k in ("x0", "y0", "x1", "y1")])
    level, out = hosts.select("host", F.lit("").alias("path"), "layer", F.array("layer").alias("opened"), "x0", "y0", "x1", "y1"), []
    while True:
        at = level.join(edge, "layer").join(inner, "layer")
        fit = lambda k, d: (c(f"{d}0") + (c(f"m_{d}{k}") - c(f"b_{d}0")) * (c(f"{d}1") - c(f"{d}0")) / (c(f"b_{d}1") - c(f"b_{d}0"))).alias(f"{d}{k}")
        placed = graph.cut(at.select("host", F.concat_ws("/", "path", c("id").cast("string")).alias("path"), "id", "details", "opened", fit(0, "x"), fit(0, "y"), fit(1, "x"), fit(1, "y")))
        out.append(placed.select("host", "path", "id", "x0", "y0", "x1", "y1"))
        level = placed.where("details is not null").select("host", "path", c("details").alias("layer"), "opened", "x0", "y0", "x1", "y1")
        deeper, circles = level.agg(F.count("*"), F.count_if(F.array_contains("opened", c("layer")))).first()
        if circles:
            raise ValueError("detail layers open each other in a circle")
        if not deeper:
            return functools.reduce(DataFrame.union, out)
        level = level.withColumn("opened", F.array_append("opened", c("layer")))


def layer_offsets(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """JN-37: how far each layer is moved: from the centre of its paired features' common bounds to that
    of the features they are paired with: ``pairs(layer, feature, base)``."""
    box = boxes.select("id", "x0", "y0", "x1", "y1")
    side = lambda c, p: box.toDF(c, *[f"{p}{k}" for k in ("x0", "y0", "x1", "y1")])
    rows = pairs.join(side("feature", "f_"), "feature").join(side("base", "b_"), "base")
    middle = lambda p, c: (F.min(f"{p}{c}0") + F.max(f"{p}{c}1")) / 2
    return rows.groupBy("layer").agg((middle("b_", "x") - middle("f_", "x")).alias("dx"), (middle("b_", "y") - middle("f_", "y")).alias("dy"))


def organ_systems(rows: DataFrame) -> DataFrame:
    """AG-19: each organ's systems, sorted."""
    return rows.groupBy("organ").agg(F.concat_ws(", ", F.array_sort(F.collect_set("system"))).alias("systems"))


def merged_groups(shapes: DataFrame) -> DataFrame:
    """AG-22: groups whose members are all components of one colour with at most one name between them
    become one shape: ``shapes(id, group, kind, colour, name, x0, y0, x1, y1)``."""
    name = F.nullif(F.col("name"), F.lit(""))
    rolled = shapes.groupBy("group").agg(
        F.bool_and(F.col("kind") == "component").alias("all_components"), F.countDistinct("colour").alias("colours"), F.countDistinct(name).alias("names"), F.min(name).alias("name"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("members"),
    )
    return rolled.where("all_components and colours = 1 and names <= 1").select("group", "name", "members", "x0", "y0", "x1", "y1")


def phenotype_labels(phenotypes: DataFrame, labels: DataFrame) -> DataFrame:
    """AG-26: each neuron's combination of phenotypes, and its label; a combination without one is its
    own label, as JSON: ``labels(key, label)`` by the sorted phenotypes joined with ``|``."""
    sets = phenotypes.groupBy("neuron").agg(F.array_sort(F.collect_set("phenotype")).alias("p")).withColumn("key", F.array_join("p", "|"))
    return sets.join(labels, "key", "left").select("neuron", F.coalesce("label", F.to_json("p")).alias("label"))


def group_outlines(members: DataFrame, defaults: DataFrame) -> DataFrame:
    """AG-27: per group its members by type of geometry, its bounds, and its class, by default that of
    its children: ``members(group, geometry, x0, y0, x1, y1, class)``, ``defaults(group, class)``."""
    rolled = members.groupBy("group").agg(
        F.count("*").alias("members"), F.count_if(F.col("geometry") == "line").alias("lines"), F.count_if(F.col("geometry") == "polygon").alias("polygons"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("class").alias("child_class"),
    )
    return rolled.join(defaults.select("group", "class"), "group", "left").withColumn("class", F.coalesce("class", "child_class")).drop("child_class")


def label_text(parts: DataFrame, tall: float) -> DataFrame:
    """WN-9: ``(label, text)`` of ``parts(label, seq, text, baseline)`` in order: a part more than ``tall`` above
    the first one's baseline is raised, as ``^{...}``, one as far below lowered, as ``_{...}``."""
    w = Window.partitionBy("label").orderBy("seq")
    rise = F.col("baseline") - F.first("baseline").over(w)
    piece = F.when(rise > tall, F.concat(F.lit("^{"), "text", F.lit("}"))).when(rise < -tall, F.concat(F.lit("_{"), "text", F.lit("}"))).otherwise(F.col("text"))
    return parts.select("label", "seq", piece.alias("piece")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p")).select("label", F.array_join("p.piece", "").alias("text"))


def functional_class(shapes: DataFrame, inside: DataFrame) -> DataFrame:
    """SC-22: the class of each component, the first that holds: a system (by its colour, outermost); a port (a neural
    connector); a unit (holds a port); an organ (by its colour, or holds a unit); a region (vascular, in an organ); a
    nerve or vessel (by its colour); else a conduit. ``shapes(id, paint, connector)``, ``inside(id, parent)``."""
    of = lambda kinds, name: inside.join(kinds.select("id"), "id", "left_semi").select(F.col("parent").alias("id"), F.lit(True).alias(name)).distinct()
    port = (F.col("connector") == "neural") & F.col("connector").isNotNull()
    held = shapes.join(of(shapes.where(port), "has_port"), "id", "left")
    unit = F.coalesce("has_port", F.lit(False)) & (F.col("paint") != "system")
    held = held.join(of(held.where(unit), "has_unit"), "id", "left")
    organ = (F.col("paint") == "organ") | (F.coalesce("has_unit", F.lit(False)) & (F.col("paint") != "system"))
    in_organ = inside.join(held.where(organ & ~unit & ~port).select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.lit(True).alias("in_organ")).distinct()
    known = held.join(in_organ, "id", "left")
    kind = F.when(F.col("paint") == "system", "system").when(port, "port").when(unit, "unit").when(organ, "organ").when((F.col("paint") == "vascular") & F.coalesce("in_organ", F.lit(False)), "region")
    return known.select("id", kind.when(F.col("paint").isin("nerve", "vessel"), F.col("paint")).otherwise("conduit").alias("class"))


def line_tests(pairs: DataFrame) -> DataFrame:
    """SC-23: of pairs of segments ``(a, b, ax0 .. ay1, bx0 .. by1)`` whether they cross, are parallel (skew below
    a thousandth), how much of the first the second covers along it, and how far apart they are."""
    c = F.col
    dx, dy, ex, ey = c("ax1") - c("ax0"), c("ay1") - c("ay0"), c("bx1") - c("bx0"), c("by1") - c("by0")
    la, lb, cross = F.hypot(dx, dy), F.hypot(ex, ey), dx * ey - dy * ex
    side = lambda ox, oy, ux, uy, px, py: F.signum(ux * (c(py) - c(oy)) - uy * (c(px) - c(ox)))
    meets = (side("ax0", "ay0", dx, dy, "bx0", "by0") * side("ax0", "ay0", dx, dy, "bx1", "by1") <= 0) & (side("bx0", "by0", ex, ey, "ax0", "ay0") * side("bx0", "by0", ex, ey, "ax1", "ay1") <= 0) & (cross != 0)
    along = lambda px, py: ((c(px) - c("ax0")) * dx + (c(py) - c("ay0")) * dy) / la
    lo, hi = F.least(along("bx0", "by0"), along("bx1", "by1")), F.greatest(along("bx0", "by0"), along("bx1", "by1"))
    parallel = F.abs(cross) < 1e-3 * la * lb
    apart = F.abs((c("bx0") - c("ax0")) * dy - (c("by0") - c("ay0")) * dx) / la
    return pairs.where((la > 0) & (lb > 0)).select("a", "b", meets.alias("crosses"), parallel.alias("parallel"), F.round(F.greatest(F.least(hi, la) - F.greatest(lo, F.lit(0.0)), F.lit(0.0)), 6).alias("overlap"), F.round(apart, 6).alias("separation"))


#: The longer side of a map in world metres, the pixels that maps are measured by, and what those beyond all count as.
MAP_METRES, PIXEL_STEPS, PIXELS_BEYOND = 5_000_000, (50, 100, 200, 500, 1000, 2000, 5000, 10_000), 20_000
#: Pixels between a detailed map and the edge of its background.
BORDER = 50


def metres_per_pixel(w: Column, h: Column) -> Column:
    """SC-25: world metres of a pixel of a drawing: its map's side over the first step above its longer side in pixels."""
    side = F.greatest(w, h)
    step = F.lit(PIXELS_BEYOND)
    for pixels in reversed(PIXEL_STEPS):
        step = F.when(side < pixels, pixels).otherwise(step)
    return MAP_METRES / step


def fitted_scale(rule: Column, w: Column, h: Column, own_w: Column, own_h: Column) -> Column:
    """SC-25: how much a detail layer is scaled to fit its feature, by rule; by the larger where no rule says otherwise."""
    a, b = w / own_w, h / own_h
    return F.when(rule == "width", a).when(rule == "height", b).when(rule == "mean", F.hypot(a, b)).when(rule == "smallest", F.least(a, b)).otherwise(F.greatest(a, b))


def sampled(curves: DataFrame, samples: int = 100) -> DataFrame:
    """SC-29: points ``(id, k, x, y)`` of cubic curves ``(id, x0 .. y3)`` at even parameters."""
    t = F.col("k") / samples
    at = lambda c: g.cubic(*[F.col(f"{c}{k}").cast("double") for k in range(4)], t)
    return curves.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples)))).select("id", "k", at("x").alias("x"), at("y").alias("y"))


def property_changes(changes: DataFrame) -> DataFrame:
    """SC-33: properties after ``changes(id, seq, op, prop, value)`` in order: ``set`` replaces, ``append`` adds to a list,
    ``pop`` takes away; what is left as JSON lists."""
    last = Window.partitionBy("id", "prop").orderBy("seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = changes.withColumn("over", F.max(F.when(F.col("op").isin("set", "pop"), F.col("seq"))).over(last))
    kept = later.where((F.col("op") != "pop") & (F.col("over").isNull() | (F.col("over") == F.col("seq"))))
    return kept.groupBy("id", "prop").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("v")).select("id", "prop", F.to_json("v.value").alias("value"))


def margin_boxes(layers: DataFrame) -> DataFrame:
    """SC-38: the box behind each functional detail layer ``(layer, kind, metres, x0 .. y1)``: the bounds, drawn in by the border
    (``BORDER`` pixels of ``metres`` each) at all sides but the lower, where they are let out by it, then let out by twice the
    border all round."""
    m = BORDER * F.col("metres")
    rows = layers.where("kind = 'functional'")
    return rows.select("layer", (F.col("x0") - m).alias("x0"), (F.col("y0") - 3 * m).alias("y0"), (F.col("x1") + m).alias("x1"), (F.col("y1") + m).alias("y1"))


def directed(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """SC-40: ``(line, reversed)``: a line runs from its first node to its second; it is reversed where the end nearest
    to any of the two shows that it was drawn the other way: ``lines(line, a, b, x0, y0, x1, y1)``, ``nodes(id, x, y)``."""
    n = nodes.select("id", "x", "y")
    rows = lines.join(n.toDF("a", "ax", "ay"), "a").join(n.toDF("b", "bx", "by"), "b")
    d = lambda x, y, u, v: (F.col(x) - F.col(u)) * (F.col(x) - F.col(u)) + (F.col(y) - F.col(v)) * (F.col(y) - F.col(v))
    straight, crossed = F.least(d("x0", "y0", "ax", "ay"), d("x1", "y1", "bx", "by")), F.least(d("x0", "y0", "bx", "by"), d("x1", "y1", "ax", "ay"))
    return rows.select("line", (crossed < straight).alias("reversed"))
