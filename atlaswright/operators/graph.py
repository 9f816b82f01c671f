"""Many small connectivity graphs at once (GR-1..15, 18, 19, 22..24, AG-9, 16, SO-4).

Edges are rows ``(path, src, dst)``; all loops run over every path together, and stop when a
round changes nothing.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where a session on one machine
    names none, a new temporary one. A cluster has no such default: an executor's own folder
    would hide data from the others."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-atlaswright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a table in the folder that executors share."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/atlaswright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    """GR-1: one row per pair of neighbours, with the direction of the least edge."""
    return edges.where("src <> dst").groupBy("path", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.struct("src", "dst")).alias("e")).select("path", "a", "b", F.col("e.src").alias("predecessor"), F.col("e.dst").alias("successor"))


def ends(edges: DataFrame) -> DataFrame:
    """Distinct ``(path, node, neighbour)``, both ways."""
    return edges.select("path", F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(edges.select("path", "dst", "src")).where("node <> neighbour").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """GR-2."""
    return ends(edges).groupBy("path", "node").agg(F.count("*").alias("degree"))


def terminals(edges: DataFrame) -> DataFrame:
    """AG-9: the nodes whose degree is the least of their path."""
    d = degrees(edges)
    least = d.groupBy("path").agg(F.min("degree").alias("degree"))
    return d.join(least, ["path", "degree"]).select("path", "node", "degree")


#: Rounds that take single nodes before runs of nodes are taken out together.
PLAIN = 8


def _runs(pairs: DataFrame) -> DataFrame:
    """``(path, node, run)`` of ``pairs(path, node, neighbour)``: connected nodes share a run."""
    named = components(pairs.select(F.struct("path", "node").alias("a"), F.struct("path", F.col("neighbour").alias("node")).alias("b")))
    return named.select("id.path", "id.node", F.col("component.node").alias("run"))


def pruned(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """GR-3: leaves that are not in ``keep(node)`` go, again and again. After ``PLAIN`` rounds
    a leaf takes the whole run of such nodes of two neighbours with it, so that the rounds
    do not grow with the length of runs. A round writes one table; it was the last if no row is gone."""
    kept = keep.select("node").distinct()
    pairs, k = cut(ends(edges)), 0
    left = pairs.count()
    while left:
        free = pairs.groupBy("path", "node").agg(F.count("*").alias("n")).where("n <= 2").join(kept, "node", "left_anti").select("path", "node", "n")
        if k < PLAIN:
            loose = free.where("n <= 1").select("path", "node")
        else:
            free = cut(free)
            leaves = free.where("n <= 1").select("path", "node")
            inside = pairs.join(free.select("path", "node"), ["path", "node"], "left_semi").join(free.select("path", F.col("node").alias("neighbour")), ["path", "neighbour"], "left_semi")
            runs = cut(_runs(inside))
            ended = runs.join(leaves, ["path", "node"], "left_semi").select("path", "run").distinct()
            loose = cut(leaves.union(runs.join(ended, ["path", "run"], "left_semi").select("path", "node")).distinct())
        after = pairs.join(loose, ["path", "node"], "left_anti").join(loose.withColumnRenamed("node", "neighbour"), ["path", "neighbour"], "left_anti")
        pairs, before, k = cut(after.select("path", "node", "neighbour")), left, k + 1
        left = pairs.count()
        if left == before:
            break
    return pairs.where("node < neighbour").select("path", F.col("node").alias("a"), F.col("neighbour").alias("b"))


def bypassed(edges: DataFrame, missing: DataFrame) -> DataFrame:
    """GR-4: edges around missing nodes: what comes before one is joined to what comes after,
    or all its neighbours to each other where nothing comes before or after; edges so made
    are not complete. The result is that of taking the least missing node of each path out,
    one after the other: a round takes those out together that are less than all missing
    neighbours, whose edges nothing taken out before them in that order can change. After
    ``PLAIN`` rounds, hashes order the nodes of runs in which each has one edge in and one
    out, since any order makes the same edges there. An edge says which missing nodes (``missing``) it passes over, all of them where several edges fall together."""
    now = cut(edges.where("src <> dst").groupBy("path", "src", "dst").agg(F.lit(True).alias("complete")).withColumn("missing", F.array().cast("array<long>")))
    gone, free, k = missing.select("node").distinct(), None, 0
    while True:
        at = now.select("path", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(now.select("path", "dst", F.lit(1), F.lit(0))).groupBy("path", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).join(gone, "node", "left_semi")
        at = cut(at.select("path", "node", ((F.col("i") == 1) & (F.col("o") == 1)).alias("plain"), F.lit(0).cast("long").alias("rank")))
        if at.isEmpty():
            break
        inside = ends(now).join(at.select("path", "node"), ["path", "node"], "left_semi").join(at.select("path", F.col("node").alias("neighbour")), ["path", "neighbour"], "left_semi").select("path", "node", "neighbour")
        if k == PLAIN:
            runs = cut(_runs(cut(inside)).join(at.select("path", "node", "plain"), ["path", "node"]))
            free = cut(runs.groupBy("path", "run").agg(F.min("plain").alias("plain")).where("plain").join(runs.drop("plain"), ["path", "run"]).select("path", "node", F.lit(True).alias("free")))
        if free is not None:  # what is left of such a run stays one
            at = cut(at.join(free, ["path", "node"], "left").select("path", "node", F.when(F.col("free"), F.xxhash64("node")).otherwise(F.lit(0)).alias("rank")))
        rank = at.select("path", "node", "rank")
        later = inside.join(rank, ["path", "node"]).join(rank.toDF("path", "neighbour", "other"), ["path", "neighbour"]).where("other < rank or (other = rank and neighbour < node)").select("path", "node").distinct()
        pick = cut(rank.join(later, ["path", "node"], "left_anti").select("path", "node"))
        before = now.join(pick.withColumnRenamed("node", "dst"), ["path", "dst"]).select("path", F.col("dst").alias("node"), F.col("src").alias("n"), F.lit(-1).alias("side"), "missing")
        after = now.join(pick.withColumnRenamed("node", "src"), ["path", "src"]).select("path", F.col("src").alias("node"), F.col("dst").alias("n"), F.lit(1).alias("side"), "missing")
        around = before.union(after).distinct()
        both = around.groupBy("path", "node").agg((F.countDistinct("side") == 2).alias("through"))
        left, right = around.join(both, ["path", "node"]).toDF("path", "node", "src", "s", "over", "through"), around.toDF("path", "node", "dst", "t", "too")
        made = left.join(right, ["path", "node"]).where("src <> dst and (through and s = -1 and t = 1 or not through and src < dst)").select("path", "src", "dst", F.lit(False).alias("complete"), F.concat("over", "too", F.array(F.col("node").cast("long"))).alias("missing"))
        kept = now.join(pick.withColumnRenamed("node", "src"), ["path", "src"], "left_anti").join(pick.withColumnRenamed("node", "dst"), ["path", "dst"], "left_anti").select("path", "src", "dst", "complete", "missing")
        now, k = cut(kept.union(made).groupBy("path", "src", "dst").agg(F.max("complete").alias("complete"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("missing"))), k + 1
    return now


def contracted(edges: DataFrame, same: DataFrame) -> DataFrame:
    """GR-5: nodes of ``same(node, into)`` become their representative; no self loops; with
    the nodes that each end stands for."""
    a, b = same.toDF("src", "a"), same.toDF("dst", "b")
    named = edges.join(a, "src", "left").join(b, "dst", "left").select("path", F.coalesce("a", "src").alias("src2"), F.coalesce("b", "dst").alias("dst2"), "src", "dst")
    return named.where("src2 <> dst2").groupBy("path", F.col("src2").alias("src"), F.col("dst2").alias("dst")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst"))))).alias("contracted"))


def components(edges: DataFrame) -> DataFrame:
    """GR-10: ``(id, component)`` of ``edges(a, b)``, by alternating large and small stars."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes, before = now.select(F.col("a").alias("id")).union(now.select("b")).distinct(), None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut(large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(now.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def closure(subclass: DataFrame) -> DataFrame:
    """GR-12: ``(child, ancestor, level)`` of ``subclass(child, parent)``, the least level of each
    pair; paths double in length every round, which joins only the pairs new in the last."""
    new = cut(subclass.select("child", F.col("parent").alias("ancestor")).distinct().withColumn("level", F.lit(1)))
    all_ = new
    while not new.isEmpty():
        longer = new.alias("p").join(all_.alias("q"), F.col("p.ancestor") == F.col("q.child")).select("p.child", "q.ancestor", (F.col("p.level") + F.col("q.level")).alias("level"))
        new = cut(longer.groupBy("child", "ancestor").agg(F.min("level").alias("level")).join(all_, ["child", "ancestor"], "left_anti"))
        all_ = all_.union(new)
    return all_


def two_levels(direct: DataFrame) -> DataFrame:
    """GR-13: ancestors one and two steps up; level 2 overrides 1."""
    up = direct.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("level"))
    more = direct.alias("p").join(direct.alias("q"), F.col("p.parent") == F.col("q.child")).select("p.child", F.col("q.parent").alias("ancestor"), F.lit(2).alias("level"))
    return up.union(more).groupBy("child", "ancestor").agg(F.max("level").alias("level"))


def hierarchy(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR-14: of ``nodes(term, layers)`` all nodes up the chain that drops the first layer,
    and the links between them, as ``/`` texts with the outermost first."""
    chain = nodes.select(F.concat(F.array("term"), "layers").alias("parts"))
    up = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.reverse(F.slice("parts", k, F.size("parts"))), "/"))
    pairs = chain.select(up.alias("chain")).select(F.explode(F.arrays_zip(F.col("chain").alias("node"), F.slice("chain", 2, F.size("chain")).alias("parent"))).alias("p")).select("p.node", "p.parent").distinct()
    return pairs.select("node").distinct(), pairs.where("parent is not null")


def to_ends(links: DataFrame) -> DataFrame:
    """List ranking: ``(key, last, steps)`` of ``links(key, next)``, where ``next`` is null at the end of a list: the end that
    each key leads to, and how far it is. Pointers double every round, so the rounds grow with
    the logarithm of the longest list. Keys on a circle lead to no end and are left out."""
    state = cut(links.select("key", F.coalesce("next", "key").alias("at"), F.col("next").isNotNull().cast("long").alias("steps"), F.col("next").isNull().alias("done")))
    open_ = state.where("not done").count()
    while open_:
        on = state.select(F.col("key").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
        # only those still on their way are joined: ends, to which many lead, are not asked again
        moved = state.where("not done").join(on, "at").select("key", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("done2").alias("done"))
        state = cut(state.where("done").unionByName(moved))
        left = state.where("not done").count()
        if left == open_:  # within twice the reach of the last round nobody has met an end: circles
            break
        open_ = left
    return state.where("done").select("key", F.col("at").alias("last"), "steps")


def chains(edges: DataFrame) -> DataFrame:
    """GR-8: runs of nodes with two neighbours become one edge ``(path, a, b, inner)``, several between the same ends apart; ends
    are nodes of any other number of neighbours, circles without one are left out. Every edge in either direction leads on to the
    next of its run, so a run is a list; its ends and the places in it come by list ranking."""
    pairs = cut(ends(edges))
    inner = pairs.groupBy("path", "node").agg(F.count("*").alias("n"), F.min("neighbour").alias("lo"), F.max("neighbour").alias("hi")).where("n = 2")
    on = pairs.join(inner.select("path", F.col("node").alias("neighbour"), "lo", "hi"), ["path", "neighbour"], "left")
    following = F.when(F.col("lo").isNotNull(), F.struct("path", F.col("neighbour").alias("node"), F.when(F.col("lo") == F.col("node"), F.col("hi")).otherwise(F.col("lo")).alias("neighbour")))
    ranks = cut(to_ends(on.select(F.struct("path", "node", "neighbour").alias("key"), following.alias("next"))))
    # with what the edge back leads to, both ends of the run are known, and the place in it
    back = ranks.select(F.struct(F.col("key.path").alias("path"), F.col("key.neighbour").alias("node"), F.col("key.node").alias("neighbour")).alias("key"), F.col("last").alias("first"), F.col("steps").alias("place"))
    both = ranks.join(back, "key").select("key.path", F.col("first.neighbour").alias("a"), F.col("first.node").alias("via"), F.col("last.node").alias("from"), F.col("last.neighbour").alias("b"), "place", "steps", F.col("key.neighbour").alias("at"))
    one_way = both.where("a < b or (a = b and via <= from)")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("steps") > 0, F.struct("place", "at")))), lambda x: x["at"])
    return one_way.groupBy("path", "a", "via", "from", "b").agg(listed.alias("inner")).select("path", "a", "b", "inner")


def simple_paths(edges: DataFrame, pairs: DataFrame, bound: int = 64, most: int = 100_000) -> DataFrame:
    """All paths without a repeated node between the ends of ``pairs(path, a, b)``: ``(path, a, b, nodes)``. Walks take a
    step a round, each with the nodes it has visited. More than ``bound`` steps, or more than ``most`` walks of a pair at
    a time, are an error: such a graph is no route."""
    both = cut(ends(edges))
    walks = pairs.select("path", "a", "b", F.array("a").alias("nodes"), F.col("a").alias("node")).distinct()
    found = [walks.where("a = b").drop("node")]
    walks = walks.where("a <> b")
    for _ in range(bound):
        step = walks.join(both, ["path", "node"]).where(~F.array_contains("nodes", F.col("neighbour")))
        step = cut(step.select("path", "a", "b", F.array_append("nodes", F.col("neighbour")).alias("nodes"), F.col("neighbour").alias("node")))
        found.append(step.where("node = b").drop("node"))
        walks = step.where("node <> b")
        crowd = walks.groupBy("path", "a", "b").count().agg(F.max("count")).first()[0]
        if crowd is None:
            return functools.reduce(DataFrame.union, found)
        if crowd > most:
            raise ValueError(f"over {most} walks between two nodes of a route")
    raise ValueError(f"a route with walks of over {bound} steps")


def loop_edges(route: DataFrame, completing: DataFrame, connectivity: DataFrame, features: DataFrame) -> DataFrame:
    """GR-18: the edges ``(path, a, b)`` of ``route`` to leave out where centrelines that were added to complete it
    (``completing(path, a, b)``) have closed more loops than the connectivity has. Where exactly two connectivity nodes
    (``features(path, node, feature)``) lie on the simple paths between the ends of such an edge, and these are more than the
    simple paths between the two nodes, the shortest go, of equals the last."""
    pairs = completing.select("path", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    every = cut(simple_paths(route, pairs))
    looped = every.join(every.groupBy("path", "a", "b").agg(F.count("*").alias("have")).where("have > 1"), ["path", "a", "b"])
    on = looped.select("path", "a", "b", F.explode("nodes").alias("feature")).distinct().join(features, ["path", "feature"])
    held = cut(on.groupBy("path", "a", "b").agg(F.array_sort(F.collect_set("node")).alias("held")).where("size(held) = 2").select("path", "a", "b", F.col("held")[0].alias("m"), F.col("held")[1].alias("n")))
    needed = simple_paths(connectivity, held.select("path", F.col("m").alias("a"), F.col("n").alias("b"))).groupBy("path", F.col("a").alias("m"), F.col("b").alias("n")).agg(F.count("*").alias("need"))
    wanted = held.join(needed, ["path", "m", "n"], "left").select("path", "a", "b", F.coalesce("need", F.lit(0)).alias("need"))
    place = F.row_number().over(Window.partitionBy("path", "a", "b").orderBy(F.desc(F.size("nodes")), "nodes"))
    extra = looped.join(wanted, ["path", "a", "b"]).withColumn("place", place).where("place > need").select("path", "nodes")
    steps = F.explode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("x"), F.slice("nodes", 2, F.size("nodes")).alias("y")))
    return extra.select("path", steps.alias("s")).select("path", F.least("s.x", "s.y").alias("a"), F.greatest("s.x", "s.y").alias("b")).distinct()


def between(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """GR-9: the edges on any shortest path between chosen nodes ``(path, node)`` of a path:
    breadth-first from all of them, level by level, then back from the chosen nodes met, by
    the edges that led to them."""
    pairs, ends_ = cut(ends(edges)), cut(chosen.select("path", "node").distinct())
    front = ends_.select("path", F.col("node").alias("from"), "node")
    last, levels = front, []
    while True:
        known = front if not levels else front.union(last)  # a neighbour of a level lies in it, before it or behind it
        step = front.join(pairs, ["path", "node"]).select("path", "from", F.col("neighbour").alias("node"), F.col("node").alias("parent"))
        level = cut(step.join(known, ["path", "from", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        last, front = front, level.select("path", "from", "node").distinct()
    found, wanted = [], None
    for level in reversed(levels):
        here = level.join(ends_, ["path", "node"], "left_semi").select("path", "from", "node")
        wanted = here if wanted is None else here.union(wanted)
        led = cut(level.join(wanted.distinct(), ["path", "from", "node"], "left_semi").select("path", "from", "node", "parent"))
        found.append(led.select("path", F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b")))
        wanted = led.select("path", "from", F.col("parent").alias("node"))
    return functools.reduce(DataFrame.union, found).distinct() if found else pairs.where("false").select("path", F.col("node").alias("a"), F.col("neighbour").alias("b"))


def occupancy(edges: DataFrame) -> DataFrame:
    """AG-16: the paths that use each edge."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def occupancy_apart(edges: DataFrame) -> DataFrame:
    """AG-16 whole: ``(a, b, terminal, paths)`` of ``edges(path, src, dst, type)``: the paths on each edge, those that only end
    along it (edges of type ``terminal`` or ``upstream``) kept apart from those that run along it."""
    ends_here = F.col("type").isin("terminal", "upstream").alias("terminal")
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), ends_here).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def suppressed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-19, SO-4: paths of ``nodes(path, node, role)`` with a source or destination that no edge covers."""
    need = nodes.where(F.col("role").isin("source", "destination")).select("path", "node")
    have = edges.select("path", F.col("src").alias("node")).union(edges.select("path", "dst"))
    return need.join(have, ["path", "node"], "left_anti").groupBy("path").agg(F.array_sort(F.collect_set("node")).alias("uncovered"))


def suffixes(nodes: DataFrame) -> DataFrame:
    """GR-24: each node of ``nodes(path, node, parts)`` under every suffix of its parts."""
    return nodes.select("path", "node", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", k, F.size("parts")), "/"))).alias("dropped", "suffix"))


def flattened(tree: DataFrame, parent_path: str = "at") -> DataFrame:
    """GR-23: rows ``(id, parent, ord)`` with the path of ordinals from the root, by which they sort depth first."""
    level = tree.where("parent is null").select("id", F.array("ord").alias(parent_path))
    out = level
    while True:
        level = cut(tree.join(level.withColumnRenamed("id", "parent"), "parent").select("id", F.array_append(parent_path, F.col("ord")).alias(parent_path)))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


