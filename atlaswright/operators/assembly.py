"""From drawn lines and known paths to routes: containment, joining, traversal, matching
and the properties of what is drawn (GR-6, 20..22, 25, 26, JN-25, 29..31, 40, 42..44, TK-6, AG-15, 23)."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells, graph, spatial


def containing_neighbours(edges: DataFrame, names: DataFrame) -> DataFrame:
    """GR-6: ``(path, node, other, flag)`` of neighbours: ``other`` is a ``container`` of the node, by
    the prefix of its name or up a chain of such neighbours, or ``identical`` to it."""
    at = names.select("node", "name")
    pairs = graph.ends(edges).join(at, "node").join(at.toDF("neighbour", "other_name"), "neighbour")
    same = pairs.where("name = other_name and node < neighbour").select("path", "node", F.col("neighbour").alias("other"), F.lit("identical").alias("flag"))
    key = lambda c: F.concat_ws("/", "path", c)
    inner = graph.cut(pairs.where(F.col("name").startswith(F.concat("other_name", F.lit("/")))).select("path", "node", "neighbour"))
    keys = inner.select(key("node").alias("key"), "path", "node").union(inner.select(key("neighbour"), "path", "neighbour")).distinct()
    up = graph.closure(inner.select(key("node").alias("child"), key("neighbour").alias("parent")))
    up = up.join(keys.withColumnRenamed("key", "child"), "child").join(keys.select(F.col("key").alias("ancestor"), F.col("node").alias("other")), "ancestor")
    up = up.select("path", "node", "other", F.lit("container").alias("flag"))
    return up.union(same)


def merged_lines(lines: DataFrame, degrees: float = 30.0) -> DataFrame:
    """GR-20: ``lines(id, type, joiners, points)``, where ``joiners`` holds the joining connectors at the first and at the last
    point (null: none there), merged at joiners. Of the lines at a joiner the first two by id are one if they have the same type
    and the one goes on from the other within so many degrees. Rows ``(id, members, joiners, points)``: named by its least line, a
    merged line has the points of its members one after the other, those drawn the other way reversed, and the joiners passed
    between them, which become intermediate connectors."""
    near = lambda k, m: F.struct((F.element_at("points", m)["x"] - F.element_at("points", k)["x"]).alias("x"), (F.element_at("points", m)["y"] - F.element_at("points", k)["y"]).alias("y"))
    ends = lines.where(F.size("points") > 1).select("id", "type", F.inline(F.array(F.struct(F.lit(0).alias("end"), F.col("joiners")[0].alias("joiner"), near(1, 2).alias("away")), F.struct(F.lit(1).alias("end"), F.col("joiners")[1].alias("joiner"), near(-1, -2).alias("away")))))
    met = ends.where("joiner is not null").groupBy("joiner").agg(F.min(F.struct("id", "end", "type", "away")).alias("p"))
    others = ends.join(met.select("joiner", "p"), "joiner").where((F.col("id") != F.col("p.id")) | (F.col("end") != F.col("p.end")))
    second = others.groupBy("joiner").agg(F.min(F.struct("id", "end", "type", "away")).alias("q"))
    pairs = met.select("joiner", "p").join(second, "joiner").where("p.id <> q.id and p.type = q.type")
    length = lambda v: F.hypot(v["x"], v["y"])
    p, q = F.col("p.away"), F.col("q.away")
    # what leaves the joiner along one goes on where the other came from
    straight = -(p["x"] * q["x"] + p["y"] * q["y"]) >= math.cos(math.radians(degrees)) * length(p) * length(q)
    one = graph.cut(pairs.where(straight & (length(p) > 0) & (length(q) > 0)).select("joiner", F.col("p.id").alias("id"), F.col("p.end").alias("end"), F.col("q.id").alias("id2"), F.col("q.end").alias("end2")))
    joints = one.select("id", "end", "id2", "end2").union(one.select("id2", "end2", "id", "end"))
    placed = ordered(lines.select("id"), joints).join(lines.select("id", "points"), "id")
    way = F.when(F.col("reversed"), F.reverse("points")).otherwise(F.col("points"))
    rolled = placed.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("place", "id", way.alias("points")))).alias("m"))
    passed = one.join(placed.select("id", "chain"), "id").groupBy("chain").agg(F.array_sort(F.collect_set("joiner")).alias("joiners"))
    empty = F.array().cast(passed.schema["joiners"].dataType)
    return rolled.join(passed, "chain", "left").select(F.col("chain").alias("id"), F.col("m.id").alias("members"), F.coalesce("joiners", empty).alias("joiners"), F.flatten("m.points").alias("points"))


def upstream(edges: DataFrame, starts: DataFrame, used: DataFrame, skipped: DataFrame) -> DataFrame:
    """GR-21: from each ``starts(path, node)`` walk along edges, never onto ``skipped(node)``, to the
    nearest ``used(node)``, the least of equals: ``(path, start, steps, attached)``."""
    pairs = graph.cut(graph.ends(edges).join(skipped.withColumnRenamed("node", "neighbour"), "neighbour", "left_anti"))
    front = starts.select("path", F.col("node").alias("start"), "node").distinct()
    seen, found, k = [front], [], 0
    while True:
        k += 1
        known = functools.reduce(DataFrame.union, seen)
        step = front.join(pairs, ["path", "node"]).select("path", "start", F.col("neighbour").alias("node")).distinct()
        step = graph.cut(step.join(known, ["path", "start", "node"], "left_anti"))
        if step.isEmpty():
            break
        hit = step.join(used.select("node").distinct(), "node", "left_semi").groupBy("path", "start").agg(F.lit(k).alias("steps"), F.min("node").alias("attached"))
        found.append(graph.cut(hit))
        front = step.join(found[-1], ["path", "start"], "left_anti").select("path", "start", "node")
        seen.append(step)
    return functools.reduce(DataFrame.union, found) if found else front.where("false").select("path", "start", F.lit(0).alias("steps"), F.col("node").alias("attached"))


def centreline_list(routes: DataFrame) -> DataFrame:
    """GR-22: ``(path, centrelines)`` of ``routes(path, centreline, model, a, b)``, loops left out; a
    centreline with a model stands with it."""
    named = F.concat_ws("=", F.col("centreline").cast("string"), F.col("model").cast("string"))
    return routes.where("a <> b").groupBy("path").agg(F.array_sort(F.collect_set(named)).alias("centrelines"))


def circuits(edges: DataFrame) -> DataFrame:
    """GR-25: ``(component, a, b, branches)``: the pairs of ends (one neighbour each) in a component,
    and the number of nodes there with more than two."""
    node = lambda c: F.struct("path", F.col(c).alias("node"))
    of = graph.components(edges.select(node("src").alias("a"), node("dst").alias("b"))).select("id.path", "id.node", F.concat_ws("/", "component.path", "component.node").alias("component"))
    d = graph.cut(graph.degrees(edges).join(of, ["path", "node"]))
    branches = d.where("degree > 2").groupBy("component").agg(F.count("*").alias("branches"))
    ends = d.where("degree = 1").select("component", "node")
    pairs = ends.join(ends.withColumnRenamed("node", "b"), "component").where("node < b")
    return pairs.join(branches, "component", "left").select("component", F.col("node").alias("a"), "b", F.coalesce("branches", F.lit(0)).alias("branches"))


def end_chains(segments: DataFrame, reach: int = 500) -> DataFrame:
    """GR-26: ``(id, chain, place, reversed, closed)`` of ``segments(id, x0, y0, x1, y1)``. Ends of two segments that lie within
    ``reach`` are joined where each is the other's nearest, the least id of equals. A chain is named by its least segment;
    ``place`` counts along it from 0, and a ``reversed`` segment is passed from its second end to its first. An open chain begins
    at that of its two end segments with the lesser id, a lone segment at its first end, a closed one with its least segment the
    right way round."""
    at = lambda c: F.floor(F.col(c) / reach)
    near = F.array(*map(F.lit, (-1, 0, 1)))
    ends = segments.select("id", F.inline(F.array(F.struct(F.lit(0).alias("end"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")))))
    index = ends.select(F.col("id").alias("id2"), F.col("end").alias("end2"), F.col("x").alias("u"), F.col("y").alias("v"), at("x").alias("gx"), at("y").alias("gy"))
    probe = ends.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("id", "end", "x", "y", (at("x") + F.col("dx")).alias("gx"), (at("y") + F.col("dy")).alias("gy"))
    square = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))
    met = probe.join(index, ["gx", "gy"]).where((F.col("id") != F.col("id2")) & (square <= reach * reach))
    best = met.groupBy("id", "end").agg(F.min(F.struct(square.alias("d2"), "id2", "end2")).alias("m")).select("id", "end", "m.id2", "m.end2")
    best = graph.cut(best)
    joints = graph.cut(best.join(best.toDF("id2", "end2", "id", "end"), ["id", "end", "id2", "end2"]))
    return ordered(segments.select("id"), joints)


def ordered(segments: DataFrame, joints: DataFrame) -> DataFrame:
    """``(id, chain, place, reversed, closed)`` of segments ``(id)`` whose ends are joined two by two: ``joints(id, end, id2,
    end2)``, both ways."""
    chain = segments.join(graph.components(joints.select(F.col("id").alias("a"), F.col("id2").alias("b"))), "id", "left").select("id", F.coalesce("component", "id").alias("chain"))
    free = chain.join(joints.groupBy("id").agg(F.count("*").alias("n")), "id", "left").groupBy("chain").agg(F.count_if(F.coalesce("n", F.lit(0)) < 2).alias("free"))
    chain = graph.cut(chain.join(free, "chain").select("id", "chain", (F.col("free") == 0).alias("closed")))
    # a closed chain is cut before its least segment
    heads = chain.where("closed and id = chain").select("id", F.lit(0).alias("end"))
    open_ = joints.join(heads, ["id", "end"], "left_anti").join(heads.toDF("id2", "end2"), ["id2", "end2"], "left_anti")
    # a segment passed one way or the other leads on to the one at the end it is left by
    ways = chain.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"))
    leads = open_.select("id", (1 - F.col("end")).alias("way"), F.struct(F.col("id2").alias("id"), F.col("end2").alias("way")).alias("next"))
    ranks = graph.to_ends(ways.join(leads, ["id", "way"], "left").select(F.struct("id", "way").alias("key"), "next"))
    ranks = graph.cut(ranks.select("key.id", "key.way", F.col("last.id").alias("last"), "steps").join(chain, "id"))
    # of a chain's two lists that which does not end at the lesser of its two end segments begins there
    whole = ranks.groupBy("chain").agg(F.max("steps").alias("n"), F.max("last").alias("tail"))
    every = ranks.join(whole, "chain").where("last = tail and (n > 0 or way = 0)")
    return every.select("id", "chain", (F.col("n") - F.col("steps")).alias("place"), (F.col("way") == 1).alias("reversed"), "closed")


def container_segments(containers: DataFrame, segments: DataFrame, buffer: int = 20) -> DataFrame:
    """JN-25: for each container the segment of its centreline of which most lies in it, the least of equals; one that only comes
    within ``buffer`` of its box counts for nothing, but is taken where there is no other. ``containers(id, centreline, x0 ..
    y1)`` with a ``ring`` or without, ``segments(id, centreline, points)``."""
    wide = spatial.boxed(segments)
    wide = wide.select("id", "centreline", "points", *[(F.col(c) - buffer).alias(c) for c in ("x0", "y0")], *[(F.col(c) + buffer).alias(c) for c in ("x1", "y1")])

    def answer(a: cells.Shapes, b: cells.Shapes) -> Iterator[pa.RecordBatch]:
        b = b.sorted_by("id")
        steps = cells.Edges.of(b.columns["points"], closed=False)
        known = pa.chunked_array([a.columns["centreline"], b.columns["centreline"].cast(a.columns["centreline"].type)]).combine_chunks().dictionary_encode().indices
        codes = pc.fill_null(known, -1).to_numpy(zero_copy_only=False)
        mine, theirs = codes[: a.n], codes[a.n :]
        for i, j in cells.pairs(a, b, lambda i, j, x, y: cells.box_meet(x, y) & (mine[i] == theirs[j]) & (mine[i] >= 0)):
            i, j, common = _most(i, j, cells.clipped(steps, j, a.box, i) * (1 + 1e-9), lambda i, j: cells.length(steps, j, a.edges(), i))
            yield pa.RecordBatch.from_pydict({"id": a.columns["id"].take(pa.array(i)), "segment": b.columns["id"].take(pa.array(j)), "common": pa.array(common)})

    kind = lambda df: df.schema["id"].dataType.simpleString()
    found, _ = cells.answered(containers, wide, answer, f"id {kind(containers)}, segment {kind(segments)}, common double")
    best = F.min(F.struct((-F.round("common", 6)).alias("less"), "segment"))
    return found.groupBy("id").agg(best.alias("m")).select("id", "m.segment", (-F.col("m.less")).alias("common"))


def _most(i: np.ndarray, j: np.ndarray, most: np.ndarray, length: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs in runs of equal ``i`` those of the greatest length, and those less by no more than rounding to six digits, the
    first of equals. Of each run those that may be longest (``most``) are measured first, a few more at a time, until no other
    can come near."""
    order = np.lexsort((j, -most, i))
    i, j, most = i[order], j[order], most[order]
    start = cells.firsts(i)
    run, end = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(i)))), np.append(start[1:], len(i))
    common, done, best, at, step = np.where(most > 0, -1.0, 0.0), most <= 0, np.zeros(len(start)), start.copy(), 4
    open_ = np.arange(len(start))
    while len(open_):
        n = np.minimum(step, end[open_] - at[open_])
        rows = np.repeat(at[open_] - np.cumsum(n) + n, n) + np.arange(n.sum())
        todo = rows[~done[rows]]
        common[todo] = length(i[todo], j[todo])
        np.maximum.at(best, run[rows], common[rows])
        at[open_] += n
        open_ = open_[at[open_] < end[open_]]
        open_ = open_[most[at[open_]] >= best[open_] - 2e-6]
        step *= 4
    near = np.flatnonzero(common >= np.maximum(best - 2e-6, 0)[run])
    near = near[np.lexsort((j[near], common[near], i[near]))]
    first = np.ones(len(near), bool)
    first[1:] = (i[near][1:] != i[near][:-1]) | (common[near][1:] != common[near][:-1])
    near = near[first]
    return i[near], j[near], common[near]


def validated(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN-29: ``(line, path, tier)``: paths of a line's type of which both of its ends are end nodes
    (1), or, where there is none, both are nodes (2): ``lines(line, type, a, b)``, ``nodes(path, type, node, is_end)``."""

    asked, meant = _asked(lines, ["type", "a", "b"])

    def both(of: DataFrame, tier: int) -> DataFrame:
        at = of.select("type", "path", "node").distinct()
        left = asked.join(at.withColumnRenamed("node", "a"), ["type", "a"])
        return left.join(at.withColumnRenamed("node", "b"), ["type", "b", "path"]).select("asked", "path", F.lit(tier).alias("tier")).distinct()

    return _tiers(both(nodes.where("is_end"), 1), both(nodes, 2), meant)


def _asked(lines: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """What lines ask for, each once under a number, and the lists of lines that ask for it: ``(asked, lines)``."""
    each = graph.cut(lines.groupBy(*columns).agg(F.collect_set("line").alias("lines")).withColumn("asked", F.monotonically_increasing_id()))
    return each.select("asked", *columns), each.select("asked", "lines")


def _tiers(first: DataFrame, second: DataFrame, meant: DataFrame) -> DataFrame:
    """``(line, path, tier)``: the answers of the second tier count where there is none of the first."""
    first = graph.cut(first)
    known = first.union(second.join(first.select("asked").distinct(), "asked", "left_anti"))
    return known.join(meant, "asked").select(F.explode("lines").alias("line"), "path", "tier")


def validated_by_terms(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN-29 whole: like ``validated`` with ends of ``lines(line, type, a, a_organ, b, b_organ)`` that are terms, in an organ or
    none, against ``nodes(path, type, terms, is_end)``, whose terms are each followed by the layers it is in. An end is met by a
    term of the path if there is no organ, or the term is somewhere the last of a node, or the organ is among the layers behind
    it; or by the organ itself as a term."""
    parts = nodes.select("type", "path", "is_end", F.explode(F.transform(F.sequence(F.lit(1), F.size("terms")), lambda k: F.slice("terms", k, F.size("terms")))).alias("t"))
    parts = graph.cut(parts.select("type", "path", "is_end", F.col("t")[0].alias("term"), F.slice("t", 2, F.size("t")).alias("layers")).distinct())

    lines, meant = _asked(lines, ["type", "a", "a_organ", "b", "b_organ"])

    def met(of: DataFrame, end: str) -> DataFrame:
        asked = lines.select("asked", "type", F.col(end).alias("term"), F.col(f"{end}_organ").alias("organ"))
        by_term = asked.join(of, ["type", "term"]).where((F.size("layers") == 0) | F.col("organ").isNull() | F.array_contains("layers", F.col("organ")))
        by_organ = asked.where("organ is not null").select("asked", "type", F.col("organ").alias("term")).join(of, ["type", "term"])
        return by_term.select("asked", "path").union(by_organ.select("asked", "path")).distinct()

    def both(of: DataFrame, tier: int) -> DataFrame:
        return met(of, "a").join(met(of, "b"), ["asked", "path"]).select("asked", "path", F.lit(tier).alias("tier"))

    return _tiers(both(parts.where("is_end"), 1), both(parts, 2), meant)


def extra_lines(matches: DataFrame) -> DataFrame:
    """JN-30: ``(line, number, path)``: one more line for each match of a line after its first."""
    listed = matches.groupBy("line").agg(F.array_sort(F.collect_set("path")).alias("paths")).where("size(paths) > 1")
    return listed.select("line", F.posexplode(F.slice("paths", 2, F.size("paths"))).alias("number", "path"))


def connection_terms(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """JN-31: ``(path, terms)``: the terms along a connection in order; nodes without one are passed
    over, connections with one term or none are left out: ``nodes(path, pos, node)``, ``terms(node, term)``."""
    along = nodes.join(terms, "node").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return along.where("size(t) > 1").select("path", F.col("t.term").alias("terms"))


def remapped(routes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-40: ``routes(route, pos, name)`` with class names replaced by their only element, in order;
    and the names of classes with several (``classes(name, element)``), which is an error."""
    one = classes.groupBy("name").agg(F.min("element").alias("element"), F.countDistinct("element").alias("n"))
    named = routes.join(one, "name", "left").select("route", F.struct("pos", F.coalesce("element", "name").alias("element")).alias("e"))
    whole = named.groupBy("route").agg(F.array_sort(F.collect_list("e")).alias("e")).select("route", F.col("e.element").alias("elements"))
    return whole, one.where("n > 1").select("name", "n")


def path_properties(drawn: DataFrame, paths: DataFrame, missing: DataFrame, nerves: DataFrame) -> DataFrame:
    """JN-42: properties of drawn path features ``(feature, path, role)``: a line's kind, completeness,
    missing nodes, sex, alert, nerves and label; junctions and arrows have their kind and the taxon."""
    gone = missing.groupBy("path").agg(F.array_sort(F.collect_set("node")).alias("missing"))
    held = nerves.groupBy("path").agg(F.array_sort(F.collect_set("nerve")).alias("nerves"))
    rows = drawn.join(paths, "path").join(gone, "path", "left").join(held, "path", "left")
    line = lambda c: F.when(F.col("role") == "line", c)
    return rows.select(
        "feature", "path", F.when(F.col("role") == "line", F.coalesce("kind", F.lit("other"))).otherwise(F.col("role")).alias("kind"),
        line(F.col("missing").isNull()).alias("complete"), line(F.array_join(F.transform("missing", lambda n: n.cast("string")), ",")).alias("missing"),
        line(F.col("sex")).alias("sex"), line(F.col("alert")).alias("alert"), line(F.array_join(F.transform("nerves", lambda n: n.cast("string")), ",")).alias("nerves"),
        line(F.col("label")).alias("label"), "taxon",
    )


def centreline_models(centrelines: DataFrame, nerves: DataFrame, rules: DataFrame) -> DataFrame:
    """JN-43: ``(id, model, source)``: a centreline's own model, else the model of the nerve that
    contains it, else that of a rule, else none: ``centrelines(id, model, container)``."""
    known = centrelines.join(nerves.toDF("container", "nerve_model"), "container", "left").join(rules.toDF("id", "rule_model"), "id", "left")
    source = F.when(F.col("model").isNotNull(), "own").when(F.col("nerve_model").isNotNull(), "nerve").when(F.col("rule_model").isNotNull(), "rule").otherwise("label")
    return known.select("id", F.coalesce("model", "nerve_model", "rule_model").alias("model"), source.alias("source"))


def model_segments(models: DataFrame, segments: DataFrame, cuffs: DataFrame) -> DataFrame:
    """JN-44: a row ``(model, segment)`` for each segment of a model's centrelines, and each of its cuffs."""
    return models.join(segments.toDF("centreline", "segment"), F.col("id") == F.col("centreline")).select("model", "segment").union(cuffs.select("model", F.col("cuff").alias("segment"))).where("model is not null").distinct()


def centreline_index(centrelines: DataFrame) -> DataFrame:
    """AG-15: rows ``(index, key, id)`` by model, end and container of ``centrelines(id, model, start, stop,
    containers)``; a container that is also an end of the same one is left out."""
    ends = centrelines.select(F.explode(F.array("start", "stop")).alias("key"), "id").distinct()
    inside = centrelines.select(F.explode("containers").alias("key"), "id").distinct().join(ends, ["key", "id"], "left_anti")
    by_model = centrelines.where("model is not null").select(F.col("model").alias("key"), "id")
    parts = [df.select(F.lit(name).alias("index"), F.col("key").cast("long").alias("key"), "id") for name, df in (("model", by_model), ("end", ends), ("container", inside))]
    return functools.reduce(DataFrame.union, parts)


def unit_index(nodes: DataFrame) -> DataFrame:
    """AG-15: ``(unit, nodes)`` of network nodes ``nodes(node, unit, feature)``: those named as parts of a unit, and those that
    are the unit itself."""
    own = nodes.where("unit is not null").select("unit", "node")
    whole = nodes.where("unit is null").select(F.col("feature").alias("unit"), "node").join(own.select("unit").distinct(), "unit", "left_semi")
    return own.union(whole).groupBy("unit").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def network_properties(centrelines: DataFrame, cuffs: DataFrame, known: DataFrame) -> DataFrame:
    """JN-43: what centrelines ``(id, model, nodes)`` say of features: ``(feature, prop, value)`` with the ``nerve`` cuff of a
    centreline's model (``cuffs(model, cuff)``, of several the least), that it is a ``centreline``, and that a node without model
    and label (``known(feature, model, label)``) is a ``node``."""
    nerve = centrelines.join(cuffs.groupBy("model").agg(F.min("cuff").alias("cuff")), "model").select(F.col("id").alias("feature"), F.lit("nerve").alias("prop"), F.col("cuff").cast("string").alias("value"))
    drawn = centrelines.select(F.col("id").alias("feature"), F.lit("centreline"), F.lit("true"))
    nodes = centrelines.select(F.explode("nodes").alias("feature")).distinct()
    plain = nodes.join(known.where("model is not null or label is not null").select("feature"), "feature", "left_anti").select("feature", F.lit("node"), F.lit("true"))
    return nerve.union(drawn).union(plain).distinct()


def repeated_intermediates(nodes: DataFrame) -> DataFrame:
    """AG-23: inner nodes that a path passes more than once."""
    inner = nodes.join(nodes.groupBy("path").agg(F.max("pos").alias("last")), "path").where("pos > 0 and pos < last")
    return inner.groupBy("path", "node").agg(F.count("*").alias("times")).where("times > 1")


def terminal_order(terminals: DataFrame) -> DataFrame:
    """TK-6: the turn of each terminal ``(path, node, features, distance)``: those with two features
    first, then those with one by distance, then the rest."""
    rank = F.when(F.col("features") == 2, 0).when(F.col("features") == 1, 1).otherwise(2)
    turn = F.struct(rank.alias("k"), F.when(rank == 1, F.col("distance")).otherwise(F.lit(0.0)).alias("d"), "node")
    ordered = terminals.groupBy("path").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return ordered.select("path", F.posexplode("t").alias("turn", "t")).select("path", "turn", "t.node")


def assembled_routes(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """GR-17: ``(path, a, b, type, source)`` of the edges ``(path, src, dst, source)`` found in turn: an edge
    that several turns found has the type and source of the first; loops are left out."""
    rows = [df.select("path", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(k).alias("turn"), F.lit(name).alias("type"), "source") for k, (name, df) in enumerate(parts)]
    every = functools.reduce(DataFrame.union, rows).where("a <> b")
    return every.groupBy("path", "a", "b").agg(F.min(F.struct("turn", "source", "type")).alias("m")).select("path", "a", "b", "m.type", "m.source")


def rendered(edges: DataFrame, ends: DataFrame, nerves: DataFrame) -> DataFrame:
    """GR-27: per path what is drawn of it: its edges (GR-4), their nodes, and those of its ends and nerves that are among them."""
    nodes = edges.select("path", F.col("src").alias("node")).union(edges.select("path", "dst")).distinct()
    held = lambda df, c: df.join(nodes.withColumnRenamed("node", c), ["path", c], "left_semi").groupBy("path").agg(F.array_sort(F.collect_set(c)).alias(f"{c}s"))
    counts = edges.groupBy("path").agg(F.count("*").alias("n_edges")).join(nodes.groupBy("path").agg(F.count("*").alias("n_nodes")), "path")
    return counts.join(held(ends, "node").withColumnRenamed("nodes", "ends"), "path", "left").join(held(nerves, "nerve"), "path", "left")
