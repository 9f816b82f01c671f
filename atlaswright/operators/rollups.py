"""Roll-ups of paths, nodes and nerves, and reports (AG-*, SO-*, WN-*, TK-*, SNK-6, 8, 10, 11)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pathtype
from . import graph


def since_last_marker(log: DataFrame, marker: str = "Using knowledge source") -> DataFrame:
    """SRC-16, WN-16: each map's log rows after its last marker; without one, all."""
    last = log.where(F.col("msg") == marker).groupBy("map_id").agg(F.max("seq").alias("last"))
    return log.join(last, "map_id", "left").where("last is null or seq > last").drop("last")


def missing_nodes(log: DataFrame) -> DataFrame:
    """AG-11: the nodes that a map's log misses."""
    return log.where(F.col("msg").startswith("Cannot find feature")).groupBy("node").agg(F.array_sort(F.collect_set("map_id")).alias("maps"), F.count("*").alias("times"))


def blockers(needed: DataFrame, missing: DataFrame, suppressed: DataFrame) -> DataFrame:
    """AG-8: of ``needed(path, node)`` terminals, the missing ones with the paths and maps they block."""
    rows = needed.join(missing.select("map_id", "node").distinct(), "node").join(suppressed.select("map_id", "path").distinct(), ["map_id", "path"])
    return rows.groupBy("node").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.array_sort(F.collect_set("map_id")).alias("maps"))


def missing_reports(log: DataFrame, edges: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """AG-8, SNK-9: ``(report, key, nodes, paths, phenotypes, maps)`` of build logs: of each path that was not drawn the terminals
    that are missing (``paths_minimal``), these with the paths, phenotypes and maps that need them (``node_minimal``), and every
    missing node with all paths it is on (``node_complete``): ``edges(path, src, dst)``, ``phenotypes(path, phenotype)``."""
    lost = log.where(F.col("msg").startswith("Cannot find feature")).select("node", "map_id").distinct()
    undrawn = log.where(F.col("msg").startswith("Path suppressed")).select("path").distinct()
    paths = undrawn.join(edges.select("path").distinct(), "path", "left_semi")
    needed = graph.terminals(edges).join(paths, "path", "left_semi").join(lost.select("node").distinct(), "node", "left_semi").select("path", "node")
    kinds = phenotypes.select("path", "phenotype").distinct()
    listed = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    none = F.array().cast("array<long>")
    minimal = paths.join(needed.groupBy("path").agg(listed("node")), "path", "left").join(kinds.groupBy("path").agg(listed("phenotype")), "path", "left")
    minimal = minimal.select(F.lit("paths_minimal").alias("report"), F.col("path").alias("key"), F.coalesce("nodes", none).alias("nodes"), F.array("path").alias("paths"), "phenotypes", none.alias("maps"))

    def by_node(rows: DataFrame, report: str, maps: bool) -> DataFrame:
        rolled = rows.join(kinds, "path", "left").groupBy("node").agg(listed("path"), listed("phenotype"))
        found = rolled.join(lost.groupBy("node").agg(F.array_sort(F.collect_set("map_id")).alias("maps")), "node")
        return found.select(F.lit(report).alias("report"), F.col("node").alias("key"), F.array("node").alias("nodes"), "paths", "phenotypes", (F.col("maps") if maps else none).alias("maps"))

    on = edges.select("path", F.col("src").alias("node")).union(edges.select("path", "dst")).distinct()
    return minimal.unionByName(by_node(needed, "node_minimal", True)).unionByName(by_node(on, "node_complete", False))


def connectivity_document(models: DataFrame, nodes: DataFrame, lines: DataFrame, nerves: DataFrame, kinds: DataFrame, drawn: DataFrame) -> DataFrame:
    """SNK-6 as rows ``(section, key, value)``, values being JSON: ``paths`` with their lines, nodes and nerves, ``node-paths``,
    ``type-paths``, and ``models`` with those of their paths that are rendered; models without any are left out. ``models(model,
    path)``, ``nodes(path, node)``, ``lines(path, line)``, ``nerves(path, nerve)``, ``kinds(path, kind)``; connections that were
    drawn are added, ``drawn(model, path, kind, line, nodes)`` (AG-4)."""
    part = lambda df, what, c: df.select("path", F.lit(what).alias("what"), F.col(c).cast("long").alias("id"))
    parts = part(lines, "lines", "line").union(part(drawn, "lines", "line")).union(part(nodes, "nodes", "node")).union(drawn.select("path", F.lit("nodes"), F.explode("nodes"))).union(part(nerves, "nerves", "nerve"))
    parts = graph.cut(parts.distinct())
    kept = lambda what: F.array_sort(F.collect_set(F.when(F.col("what") == what, F.col("id")))).alias(what)
    paths = parts.groupBy("path").agg(kept("lines"), kept("nodes"), kept("nerves"))
    rendered = paths.select("path")
    text = lambda c: F.to_json(F.array_sort(F.collect_set(c))).alias("value")
    row = lambda section, df, key: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), "value")
    of_kinds = kinds.select("kind", "path").union(drawn.select("kind", "path")).join(rendered, "path", "left_semi")
    of_models = models.select("model", "path").union(drawn.select("model", "path")).join(rendered, "path", "left_semi")
    return (
        row("paths", paths.withColumn("value", F.to_json(F.struct("lines", "nodes", "nerves"))), "path")
        .union(row("node-paths", parts.where("what = 'nodes'").groupBy("id").agg(text("path")), "id"))
        .union(row("type-paths", of_kinds.groupBy("kind").agg(text("path")), "kind"))
        .union(row("models", of_models.groupBy("model").agg(text("path")), "model"))
    )


def rendered_lists(edges: DataFrame, same: DataFrame, phenotypes: DataFrame, forward: DataFrame, nerves: DataFrame, available: DataFrame) -> DataFrame:
    """GR-27, AG-1: per path what is drawn of its knowledge: ``connectivity`` (``edges(path, src, dst)`` after GR-4), the nodes of
    each phenotype that are left, ``forward`` connections to rendered paths, the ``nerves`` among the ``available(node)``, and
    ``mappings`` from the node that each stands for as (drawn, known): ``same(node, into)``, ``phenotypes(path, phenotype,
    node)``, ``forward(path, target)``, ``nerves(path, node)``. Lists that would be empty are null."""
    into = same.select("node", "into")
    nodes = graph.cut(edges.select("path", F.col("src").alias("node")).union(edges.select("path", "dst")).distinct().join(into, "node", "left").select("path", "node", F.coalesce("into", "node").alias("as")))
    named = lambda c: nodes.select("path", F.col("node").alias(c), F.col("as").alias(f"{c}_as"))
    links = edges.join(named("src"), ["path", "src"]).join(named("dst"), ["path", "dst"]).groupBy("path").agg(F.array_sort(F.collect_set(F.struct("src_as", "dst_as"))).alias("connectivity"))
    left = phenotypes.join(nodes, ["path", "node"]).groupBy("path", "phenotype").agg(F.array_sort(F.collect_set("as")).alias("nodes")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("phenotype", "nodes"))).alias("phenotypes"))
    on = forward.join(edges.select(F.col("path").alias("target")).distinct(), "target", "left_semi").groupBy("path").agg(F.array_sort(F.collect_set("target")).alias("forward"))
    held = nerves.join(available.select("node").distinct(), "node", "left_semi").join(into, "node", "left").groupBy("path").agg(F.array_sort(F.collect_set(F.coalesce("into", "node"))).alias("nerves"))
    maps = nodes.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("as", "node"))).alias("mappings"))
    return maps.join(links, "path", "left").join(left, "path", "left").join(on, "path", "left").join(held, "path", "left")


def resolved_paths(nodes: DataFrame, edges: DataFrame, nerves: DataFrame) -> DataFrame:
    """AG-1, SNK-6: per path its nodes, edges and nerves; lists that would be empty are null."""
    n = nodes.groupBy("path").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    e = edges.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("connectivity"))
    v = nerves.groupBy("path").agg(F.array_sort(F.collect_set("nerve")).alias("nerves"))
    return n.join(e, "path", "left").join(v, "path", "left")


def inverted(rows: DataFrame, key: str, value: str) -> DataFrame:
    """AG-2, 3, 14, 20, 21, 25, 28: the sorted distinct values of each key."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(f"{value}s"))


def cuff_radius(through: DataFrame) -> DataFrame:
    """AG-5: distinct paths through each nerve, and the radius drawn for so many."""
    return through.groupBy("nerve").agg(F.countDistinct("path").alias("n_paths")).withColumn("radius", F.round(5000 * (1 + F.log1p("n_paths")), 6))


def completeness(edges: DataFrame, missing: DataFrame) -> DataFrame:
    """AG-10, SO-2, SNK-10: rendered and missing nodes and edges of each path, and how complete that is."""
    gone = missing.select("node").distinct().withColumn("gone", F.lit(1))
    nodes = edges.select("path", F.col("src").alias("node")).union(edges.select("path", "dst")).distinct().join(gone, "node", "left")
    by_node = nodes.groupBy("path").agg(F.count("*").alias("n_nodes"), F.count("gone").alias("missing_nodes"))
    both = edges.select("path", "src", "dst").distinct().join(gone.toDF("src", "a"), "src", "left").join(gone.toDF("dst", "b"), "dst", "left")
    by_edge = both.groupBy("path").agg(F.count("*").alias("n_edges"), F.count_if(F.coalesce("a", "b").isNotNull()).alias("missing_edges"))
    out = by_node.join(by_edge, "path")
    status = F.when(F.col("missing_nodes") == 0, "Complete").when(F.col("missing_edges") < F.col("n_edges"), "Partial").otherwise("None")
    return out.withColumn("status", status)


def common_issues(issues: DataFrame) -> DataFrame:
    """AG-17, SO-3: issues with the number of maps that have them, and whether all have."""
    n = issues.select("map_id").distinct().agg(F.count("*").alias("n_maps"))
    per = issues.groupBy("issue").agg(F.countDistinct("map_id").alias("maps"))
    return per.crossJoin(F.broadcast(n)).select("issue", "maps", (F.col("maps") == F.col("n_maps")).alias("common"))  # one row


def tag_counts(tags: DataFrame) -> DataFrame:
    """AG-12: how often each tag's value occurs, and the category of its first element."""
    return tags.groupBy("tag", "value").agg(F.count("*").alias("n"), F.min_by("category", "seq").alias("category"))


def latest_map(maps: DataFrame) -> DataFrame:
    """WN-5: per taxon and sex the latest map, of equals the largest id."""
    return maps.groupBy("taxon", "sex").agg(F.max(F.struct("created", "map_id")).alias("m")).select("taxon", "sex", "m.map_id", "m.created")


def lanes(edges: DataFrame) -> DataFrame:
    """WN-7: offset of every path on an edge that several share: evenly around the middle."""
    distinct = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "path").distinct()
    w = Window.partitionBy("a", "b")
    i, n = F.row_number().over(w.orderBy("path")) - 1, F.count("*").over(w)
    rows = distinct.select("a", "b", "path", i.alias("i"), n.alias("n")).where("n > 1")
    return rows.select("a", "b", "path", (F.col("i") - (F.floor(F.col("n") / 2) - ((F.col("n") + 1) % 2) / 2)).alias("lane"))


def text_clusters(texts: DataFrame, gap: float) -> DataFrame:
    """WN-8: numbers of text clusters in drawing order: a new one begins where the baseline
    is further than ``gap`` from that of its cluster's first. A task reads a group's rows in
    order and holds none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = head = None
        number = 0
        for batch in batches:
            numbers = []
            for g, baseline in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != group:
                    group, head, number = g, None, 0
                if head is None or abs(baseline - head) > gap:
                    head, number = baseline, number + 1
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int32())], ["group", "seq", "cluster"])

    rows = texts.select(F.col("group").cast("string").alias("group"), F.col("seq").cast("long").alias("seq"), F.col("baseline").cast("double").alias("baseline"))
    return rows.repartition("group").sortWithinPartitions("group", "seq").mapInArrow(run, "group string, seq long, cluster int")


def segments(nodes: DataFrame, branches: DataFrame) -> DataFrame:
    """WN-10, 11: each line's ordered nodes cut at branch nodes: ``(line, segment, nodes)``;
    numbered only where there are several."""
    w = Window.partitionBy("line").orderBy("pos")
    hit = branches.select("node").distinct().withColumn("hit", F.lit(1))
    at = nodes.join(hit, "node", "left").withColumn("first", F.row_number().over(w) == 1).withColumn("last", F.lead("pos").over(w).isNull())
    cutting = F.when((F.col("hit") == 1) & ~F.col("first") & ~F.col("last"), 1).otherwise(0)
    at = at.withColumn("k", F.sum(cutting).over(w)).withColumn("cut", cutting)
    # a branch node ends one segment and begins the next
    rows = at.select("line", "pos", "node", "k").union(at.where("cut = 1").select("line", "pos", "node", F.col("k") - 1))
    out = rows.groupBy("line", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"]).alias("nodes"))
    several = at.groupBy("line").agg(F.max("k").alias("most"))
    return out.join(several, "line").select("line", F.when(F.col("most") > 0, F.concat_ws("/", "line", F.col("k") + 1)).otherwise(F.col("line").cast("string")).alias("segment"), "nodes")


def without_repeats(values: Column) -> Column:
    """WN-12: consecutive equal values once."""
    return F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1)))


def numbered(rows: DataFrame, partition: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``rows`` numbered from 1 in each group, in two levels: all rows are sorted by range over all tasks, numbered within task
    and group, and shifted by what the tasks before hold of the group, so that no group meets in one task."""
    here = graph.cut(rows.orderBy(*partition, *order).select(F.struct(*rows.columns).alias("row"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")))
    keys = [F.col(f"row.{c}").alias(f"key{k}") for k, c in enumerate(partition)]
    names = [f"key{k}" for k in range(len(partition))]
    here = here.select("*", *keys)
    counts = here.groupBy(*names, "task").count()
    before = Window.partitionBy(*names).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    skips = counts.select(*names, "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    inside = F.row_number().over(Window.partitionBy(*names, "task").orderBy("at"))
    return here.withColumn("inside", inside).join(skips, [*names, "task"]).select("row.*", (F.col("skip") + F.col("inside")).alias(name))


def dense_ids(rows: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """WN-4: numbers from 1 in input order."""
    return numbered(rows, partition, order).withColumn("number", F.col("number").cast("int"))


def unique_names(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """WN-14: ``class-n`` for each row of a class in order, skipping names that are taken. The r-th free number is r plus the
    taken ones below it: of the taken numbers, in order, the j-th has ``number - j`` free ones below, so merged with the rows by
    that every row's place is its number."""
    used = taken.select(F.regexp_extract("name", r"^(.*)-(\d+)$", 1).alias("class"), F.regexp_extract("name", r"-(\d+)$", 1).try_cast("long").alias("n")).where("n > 0").distinct()
    used = numbered(used, ["class"], ["n"], "j").select("class", (F.col("n") - F.col("j")).alias("key"), F.lit(1).alias("taken"), F.lit(None).cast("long").alias("id"))
    own = numbered(rows.select("id", "class"), ["class"], ["id"], "key").select("class", "key", F.lit(0).alias("taken"), F.col("id").cast("long").alias("id"))
    placed = numbered(own.unionByName(used), ["class"], ["key", "taken", "id"], "place").where("taken = 0")
    return placed.select("id", "class", F.concat_ws("-", "class", F.col("place").cast("string")).alias("name"))


def path_types(rows: DataFrame) -> DataFrame:
    """WN-13: ``(path, code)`` of ``rows(path, pos, phenotype)``: the first phenotype that names a type, with the bits of the
    first that names an order."""
    known = F.create_map(*[F.lit(x) for kv in pathtype.PHENOTYPES.items() for x in kv])
    coded = rows.select("path", "pos", F.try_element_at(known, F.col("phenotype")).alias("code"))
    first = lambda want: F.min_by(F.when(want, F.col("code")), F.when(want, F.col("pos")))
    kind, order = first(F.col("code") <= pathtype.TYPE_MASK), first(F.col("code") > pathtype.TYPE_MASK)
    return coded.groupBy("path").agg(F.coalesce(kind, F.lit(1)).bitwiseOR(F.coalesce(order, F.lit(0))).alias("code"))


def rendered(mapped: DataFrame, missing: DataFrame, keys: list[str]) -> DataFrame:
    """SO-2, SNK-10: ``mapped`` rows, nodes or edges by ``keys``, with whether they are rendered or among the ``missing``."""
    gone = missing.select(*keys).distinct().withColumn("gone", F.lit(True))
    return mapped.select(*keys).distinct().join(gone, keys, "left").select(*keys, F.coalesce("gone", F.lit(False)).alias("missing"))


def in_all_maps(issues: DataFrame) -> DataFrame:
    """SO-3: the issues ``(map_id, issue)`` that every map has."""
    return common_issues(issues).where("common").select("issue")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Up to so many numbers of query vectors are held against all terms at once.
QUERY_NUMBERS = 4_000_000
#: So many scores at a time.
SCORES = 1 << 20


def top_k(queries: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """TK-1: the ``k`` terms of greatest cosine to each of ``queries(query, vector)``, a stated set, which is held against all of
    ``terms(term, vector)`` in blocks of bounded size, as matrices. A task returns what may be among the ``k`` of its batch,
    with scores worked out anew number by number; a query's ranks are cut to ``k`` before they are shuffled."""
    n = queries.count()
    width = queries.agg(F.max(F.size("vector"))).first()[0] or 1
    blocks = max(1, -(-n * width // QUERY_NUMBERS))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "term")
    schema = f"query {queries.schema['query'].dataType.simpleString()}, term {terms.schema['term'].dataType.simpleString()}, score double"
    out = None
    for b in range(blocks):
        q = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", F.col("vector").cast("array<double>").alias("vector"))
        held = terms.sparkSession.sparkContext.broadcast(q.toArrow())  # QUERY_NUMBERS at most
        near = terms.select("term", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(functools.partial(_near, held=held, k=k), schema)
        best = near.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.union(best)
    return out


def _near(batches: Iterator[pa.RecordBatch], held, k: int) -> Iterator[pa.RecordBatch]:
    """``(query, term, score)``: for each batch of terms what scores no less, but for rounding, than the ``k``-th there; then the
    ``k`` least terms that have no score, as a vector lacks a number."""
    row = lambda query, term, score: pa.RecordBatch.from_pydict({"query": query, "term": term, "score": score})
    queries = _by_width(held.value.column("query"), held.value.column("vector"))
    for batch in batches:
        terms = _by_width(batch.column("term"), batch.column("vector"))
        for width, (ids, q) in queries.items():
            for other, (names, t) in terms.items():
                if other != width or not width:
                    continue
                squares = (q * q).sum(1)[:, None], (t * t).sum(1)[None, :]
                if not (squares[0].all() and squares[1].all()):
                    raise ValueError("a vector of no length has no cosine")
                for at in range(0, len(q), max(1, SCORES // len(t))):
                    part = q[at : at + max(1, SCORES // len(t))]
                    scores = part @ t.T / np.sqrt(squares[0][at : at + len(part)] * squares[1])
                    scores = np.where(np.isnan(scores), np.inf, scores)  # sorts first
                    low = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(part), -np.inf)
                    i, j = np.nonzero(scores >= low[:, None] - 2e-6)
                    exact = np.cumsum(part[i] * t[j], axis=1)[:, -1] / np.sqrt(np.cumsum(part[i] ** 2, axis=1)[:, -1] * np.cumsum(t[j] ** 2, axis=1)[:, -1])
                    yield row(ids.take(pa.array(i + at)), names.take(pa.array(j)), pa.array(exact))
            rest = [names for other, (names, _) in terms.items() if other != width or not width]
            if rest:
                rest = pa.chunked_array(rest).combine_chunks()
                rest = rest.take(pc.sort_indices(rest, null_placement="at_start")[:k])
                i, j = np.repeat(np.arange(len(ids)), len(rest)), np.tile(np.arange(len(rest)), len(ids))
                yield row(ids.take(pa.array(i)), rest.take(pa.array(j)), pa.nulls(len(i), pa.float64()))


def _by_width(ids, vectors) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Ids and their vectors as matrices by width; under 0 those that lack a vector or a number of it."""
    ids, vectors = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (ids, vectors))
    widths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).copy()
    owner = pc.list_parent_indices(vectors).to_numpy()
    widths[owner[pc.is_null(pc.list_flatten(vectors)).to_numpy(zero_copy_only=False)]] = 0
    out = {}
    for width in np.unique(widths):
        at = pa.array(np.flatnonzero(widths == width))
        matrix = pc.list_flatten(vectors.take(at)).to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((0, 0))
        out[int(width)] = ids.take(at), matrix
    return out


def publications(paths: DataFrame, details: DataFrame) -> DataFrame:
    """SNK-11: a row per path and publication, one with nulls for a path without any."""
    return paths.select("path", F.explode_outer("publications").alias("publication")).join(details, "publication", "left")

