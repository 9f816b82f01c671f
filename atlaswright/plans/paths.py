"""Logs, paths and their graphs: what blocks which path, pruning, contraction, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, rollups
from . import frames
from .frames import with_frames

_ENDS = "SELECT DISTINCT path, src AS node, dst AS nb FROM path_edges UNION SELECT path, dst, src FROM path_edges"
_DEGREE = f"e AS ({_ENDS}), d AS (SELECT path, node, count(*) AS degree FROM e GROUP BY ALL)"
_LIST = "array_to_string(list_sort(list(DISTINCT {0})), ',')"


def text(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",")


def blocked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which missing nodes block which paths, on which maps (SRC-16, AG-8, 9, 11)."""
    log = rollups.since_last_marker(frames.log_events(spark, sf_dir))
    missing = log.where("msg like 'Cannot find feature%'").select("map_id", "node")
    stopped = log.where("msg like 'Path suppressed%'").select("map_id", "path")
    out = rollups.blockers(graph.terminals(frames.path_edges(spark, sf_dir)), missing, stopped)
    return out.select("node", text("paths").alias("paths"), text("maps").alias("maps"))


BLOCKED = with_frames("log_events", "path_edges", body=f""", {_DEGREE},
m AS (SELECT map_id, max(seq) AS last FROM log_events WHERE msg = 'Using knowledge source' GROUP BY map_id),
l AS (SELECT l.* FROM log_events l LEFT JOIN m USING (map_id) WHERE last IS NULL OR seq > last),
t AS (SELECT path, node FROM (SELECT *, min(degree) OVER (PARTITION BY path) AS least FROM d) WHERE degree = least)
SELECT t.node, {_LIST.format('t.path')} AS paths, {_LIST.format('x.map_id')} AS maps
FROM t JOIN (SELECT DISTINCT map_id, node FROM l WHERE msg LIKE 'Cannot find feature%') x ON t.node = x.node
JOIN (SELECT DISTINCT map_id, path FROM l WHERE msg LIKE 'Path suppressed%') y ON y.map_id = x.map_id AND y.path = t.path GROUP BY t.node""")


def ag11_missing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollups.missing_nodes(rollups.since_last_marker(frames.log_events(spark, sf_dir)))
    return out.select("node", text("maps").alias("maps"), "times")


AG11 = with_frames("log_events", body=f""", m AS (SELECT map_id, max(seq) AS last FROM log_events WHERE msg = 'Using knowledge source' GROUP BY map_id)
SELECT node, {_LIST.format('map_id')} AS maps, count(*) AS times FROM log_events LEFT JOIN m USING (map_id) WHERE (last IS NULL OR seq > last) AND msg LIKE 'Cannot find feature%' GROUP BY node""")


def gr1_edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected(frames.path_edges(spark, sf_dir))


GR1 = with_frames("path_edges", body=""" SELECT path, least(src, dst) AS a, greatest(src, dst) AS b, (min((src, dst)))[1] AS predecessor, (min((src,
  dst)))[2] AS successor FROM path_edges GROUP BY path, least(src, dst), greatest(src, dst)""")


def gr2_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(frames.path_edges(spark, sf_dir))


GR2 = with_frames("path_edges", body=f", {_DEGREE} SELECT * FROM d")


def ag9_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.terminals(frames.path_edges(spark, sf_dir))


AG9 = with_frames("path_edges", body=f", {_DEGREE} SELECT path, node, degree FROM d QUALIFY degree = min(degree) OVER (PARTITION BY path)")


def gr3_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that are not drawn (a third of the parts are) go, to the fixpoint."""
    keep = frames.table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"))
    return graph.pruned(frames.path_edges(spark, sf_dir), keep)


def _prune_sql(rounds: int) -> str:
    """Rounds enough for the longest path of the tables."""
    out = f", r0 AS ({_ENDS})"
    for k in range(rounds):
        out += f", g{k} AS (SELECT path, node FROM r{k} GROUP BY path, node HAVING count(*) <= 1 AND node % 3 <> 0), r{k + 1} AS (SELECT * FROM r{k} WHERE (path, node) NOT IN (SELECT (path, node) FROM g{k}) AND (path, nb) NOT IN (SELECT (path, node) FROM g{k}))"
    return out + f" SELECT path, node AS a, nb AS b FROM r{rounds} WHERE node < nb"


GR3 = with_frames("path_edges", body=_prune_sql(14))


def gr4_bypassed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bypassed(frames.path_edges(spark, sf_dir), frames.missing_nodes(spark, sf_dir)).withColumn("missing", text("missing"))


def _bypass_sql(rounds: int) -> str:
    out = ", b0 AS (SELECT DISTINCT path, src, dst, true AS complete, []::BIGINT[] AS m FROM path_edges WHERE src <> dst)"
    for k in range(rounds):
        out += f""", p{k} AS (SELECT path, min(node) AS node FROM (SELECT path, src AS node FROM b{k} UNION SELECT path, dst FROM b{k}) WHERE node IN (SELECT node FROM missing_nodes) GROUP BY path),
a{k} AS (SELECT b.path, src AS n, -1 AS side, m, p.node FROM b{k} b JOIN p{k} p ON b.path = p.path AND b.dst = p.node UNION SELECT b.path, dst, 1, m, p.node FROM b{k} b JOIN p{k} p ON b.path = p.path AND b.src = p.node),
t{k} AS (SELECT path, count(DISTINCT side) = 2 AS through FROM a{k} GROUP BY path),
b{k + 1} AS (SELECT path, src, dst, bool_or(complete) AS complete, list_sort(list_distinct(flatten(list(m)))) AS m FROM (
  SELECT b.path, src, dst, complete, m FROM b{k} b LEFT JOIN p{k} p USING (path) WHERE node IS NULL OR (src <> node AND dst <> node)
  UNION ALL SELECT x.path, x.n, y.n, false, x.m || y.m || [x.node] FROM a{k} x JOIN t{k} t USING (path) JOIN a{k} y ON x.path = y.path WHERE x.n <> y.n AND ((through AND x.side = -1
  AND y.side = 1) OR (NOT through AND x.n < y.n))) GROUP BY path, src, dst)"""
    return out + f" SELECT path, src, dst, complete, coalesce(list_aggregate(m, 'string_agg', ','), '') AS missing FROM b{rounds}"


GR4 = with_frames("path_edges", "missing_nodes", body=_bypass_sql(6))


def gr5_contracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = frames.table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") - F.col("p_partkey") % 5).alias("into"))
    return graph.contracted(frames.path_edges(spark, sf_dir), same).withColumn("contracted", text("contracted"))


GR5 = with_frames("path_edges", body=""", c AS (SELECT path, src - src % 5 AS a, dst - dst % 5 AS b, src, dst FROM path_edges),
u AS (SELECT path, a, b, src AS n FROM c UNION SELECT path, a, b, dst FROM c)
SELECT path, a AS src, b AS dst, array_to_string(list_sort(list(DISTINCT n)), ',') AS contracted FROM u WHERE a <> b GROUP BY ALL""")


def gr8_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of each path's graph; parts that differ by a multiple of 12 are one node."""
    return graph.chains(_folded(spark, sf_dir, 12)).withColumn("inner", F.array_join(F.transform("inner", lambda n: n.cast("string")), ","))


def _folded(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return frames.path_edges(spark, sf_dir).select("path", (F.col("src") % n).alias("src"), (F.col("dst") % n).alias("dst"))


GR8 = with_frames("path_edges", recursive=True, body=""", f AS (SELECT path, src % 12 AS s, dst % 12 AS t FROM path_edges WHERE src % 12 <> dst % 12),
e AS (SELECT path, s AS node, t AS nb FROM f UNION SELECT path, t, s FROM f), d AS (SELECT path, node, count(*) AS n FROM e GROUP BY ALL),
w AS (SELECT e.path, e.node AS a, e.node AS last, e.nb AS node, []::BIGINT[] AS via FROM e JOIN d USING (path, node) WHERE d.n <> 2
  UNION ALL SELECT w.path, w.a, w.node, e.nb, list_append(via, w.node) FROM w JOIN d ON d.path = w.path AND d.node = w.node AND d.n = 2 JOIN e ON e.path = w.path
  AND e.node = w.node AND e.nb <> w.last)
SELECT w.path, a, w.node AS b, coalesce(list_aggregate(via, 'string_agg', ','), '') AS "inner" FROM w JOIN d ON d.path = w.path AND d.node = w.node AND d.n <> 2
  WHERE a < w.node OR (a = w.node AND via[1] <= via[-1])""")


def _route(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Routes over seven features; the parts behind three of them are connectivity nodes; edges whose ends add up to a multiple of
    3 are completing ones."""
    route = graph.undirected(_folded(spark, sf_dir, 7)).select("path", "a", "b")
    kept = frames.path_nodes(spark, sf_dir).where("node % 7 < 3")
    following = F.lead("node").over(Window.partitionBy("path").orderBy("pos"))
    connectivity = kept.select("path", F.col("node").alias("src"), following.alias("dst")).where("dst is not null")
    return route, route.where("(a + b) % 3 = 0"), connectivity, kept.select("path", "node", (F.col("node") % 7).alias("feature")).distinct()


def gr18_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    route, completing, connectivity, features = _route(spark, sf_dir)
    gone = graph.loop_edges(route.select("path", F.col("a").alias("src"), F.col("b").alias("dst")), completing, connectivity, features)
    return route.join(gone.withColumn("removed", F.lit(True)), ["path", "a", "b"], "left").select("path", "a", "b", F.coalesce("removed", F.lit(False)).alias("removed"))


GR18 = with_frames("path_edges", "path_nodes", recursive=True, body=""", r AS (SELECT DISTINCT path, least(src % 7, dst % 7) AS a, greatest(src % 7, dst % 7) AS b
  FROM path_edges WHERE src % 7 <> dst % 7),
re AS (SELECT path, a AS node, b AS nb FROM r UNION ALL SELECT path, b, a FROM r), q AS (SELECT * FROM r WHERE (a + b) % 3 = 0),
k AS (SELECT path, pos, node FROM path_nodes WHERE node % 7 < 3), cf AS (SELECT path, node AS s, lead(node) OVER (PARTITION BY path ORDER BY pos) AS t FROM k),
ce AS (SELECT path, s AS node, t AS nb FROM cf WHERE t IS NOT NULL AND s <> t UNION SELECT path, t, s FROM cf WHERE t IS NOT NULL AND s <> t),
w AS (SELECT path, a, b, [a] AS v FROM q UNION ALL SELECT w.path, w.a, w.b, list_append(v, nb) FROM w JOIN re ON re.path = w.path AND re.node = v[-1] WHERE v[-1] <> w.b AND NOT list_contains(v, nb)),
sp AS (SELECT path, a, b, v, count(*) OVER (PARTITION BY path, a, b) AS have FROM w WHERE v[-1] = b),
h AS (SELECT path, a, b, min(k.node) AS m, max(k.node) AS n FROM (SELECT DISTINCT path, a, b, unnest(v) AS f FROM sp WHERE have > 1) JOIN (SELECT DISTINCT path, node
  FROM k) k USING (path) WHERE k.node % 7 = f GROUP BY ALL HAVING count(DISTINCT k.node) = 2),
u AS (SELECT DISTINCT path, m, n, [m] AS v FROM h UNION ALL SELECT u.path, u.m, u.n, list_append(v, nb) FROM u JOIN ce ON ce.path = u.path AND ce.node = v[-1]
  WHERE v[-1] <> u.n AND NOT list_contains(v, nb)),
need AS (SELECT path, m, n, count(*) AS c FROM u WHERE v[-1] = n GROUP BY ALL),
x AS (SELECT path, v FROM (SELECT sp.path, sp.v, row_number() OVER (PARTITION BY sp.path, sp.a, sp.b ORDER BY len(sp.v) DESC, sp.v) AS place, coalesce(c, 0) AS c FROM sp
  JOIN h USING (path, a, b) LEFT JOIN need USING (path, m, n)) WHERE place > c),
g AS (SELECT DISTINCT path, least(v[i], v[i + 1]) AS a, greatest(v[i], v[i + 1]) AS b FROM (SELECT path, v, unnest(range(1, len(v))) AS i FROM x))
SELECT r.path, r.a, r.b, g.path IS NOT NULL AS removed FROM r LEFT JOIN g USING (path, a, b)""")


def gr9_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest-path edges between the terminals of each path."""
    edges = frames.path_edges(spark, sf_dir)
    return graph.between(edges, graph.terminals(edges))


GR9 = with_frames("path_edges", recursive=True, body=f""", {_DEGREE},
t AS (SELECT path, node FROM d QUALIFY degree = min(degree) OVER (PARTITION BY path)),
w AS (SELECT path, node AS f, node, 0 AS k FROM t UNION SELECT w.path, w.f, e.nb, k + 1 FROM w JOIN e ON e.path = w.path AND e.node = w.node WHERE k < 13),
s AS (SELECT path, f, node, min(k) AS k FROM w GROUP BY ALL),
p AS (SELECT s.path, s.f, s.node AS g, s.k FROM s JOIN t ON t.path = s.path AND t.node = s.node WHERE s.f <> s.node)
SELECT DISTINCT p.path, least(e.node, e.nb) AS a, greatest(e.node, e.nb) AS b FROM p
JOIN s x ON x.path = p.path AND x.f = p.f JOIN e ON e.path = p.path AND e.node = x.node JOIN s y ON y.path = p.path AND y.f = p.g AND y.node = e.nb WHERE x.k + 1 + y.k = p.k""")


def gr10_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the orders' parts, told apart by the discount that their lines have."""
    line = frames.table(spark, sf_dir, "lineitem")
    at = lambda c, k: F.concat(F.lit(c), k)
    e = line.select(at("O", F.col("l_orderkey")).alias("a"), at("P", F.concat_ws("/", F.col("l_partkey") % 1000, F.col("l_suppkey"), F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity").cast("int"))).alias("b"))
    return graph.components(e)


GR10 = with_frames("path_edges", recursive=True, body=""", x AS (SELECT 'O' || l_orderkey AS a,
  'P' || l_partkey % 1000 || '/' || l_suppkey || '/' || round(l_discount * 100)::INTEGER || '/' || l_quantity::INTEGER AS b FROM lineitem),
e AS (SELECT a, b FROM x UNION SELECT b, a FROM x), r AS (SELECT DISTINCT a AS id, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id WHERE r.m < e.b)
SELECT id, min(m) AS component FROM r GROUP BY id""")


def gr12_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(frames.subclass(spark, sf_dir))


GR12 = with_frames("subclass", recursive=True, body=""", c AS (SELECT child, parent AS ancestor, 1 AS level FROM subclass UNION SELECT c.child, s.parent, level + 1 FROM c
  JOIN subclass s ON s.child = c.ancestor)
SELECT child, ancestor, min(level)::INTEGER AS level FROM c GROUP BY child, ancestor""")


def gr13_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.two_levels(frames.subclass(spark, sf_dir))


GR13 = with_frames("subclass", body=""" SELECT child, ancestor, max(level)::INTEGER AS level FROM (SELECT child, parent AS ancestor, 1 AS level FROM subclass UNION ALL
  SELECT p.child, q.parent, 2 FROM subclass p JOIN subclass q ON p.parent = q.child) GROUP BY ALL""")


def gr14_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the hierarchy of (customer, nation, region) nodes."""
    c, n = frames.table(spark, sf_dir, "customer"), frames.table(spark, sf_dir, "nation")
    nodes = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("term"), F.array(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")), F.concat(F.lit("R:"), F.col("n_regionkey").cast("string"))).alias("layers"))
    return graph.hierarchy(nodes)[1]


GR14 = """WITH n AS (SELECT 'R:' || n_regionkey AS r, 'R:' || n_regionkey || '/N:' || n_nationkey AS n, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n || '/C:' || c_custkey AS node, n AS parent FROM n UNION SELECT n, r FROM n"""


def gr24_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.path_nodes(spark, sf_dir)
    parts = F.array(F.col("node").cast("string"), F.lit("mid"), F.lit("outer"))
    return graph.suffixes(p.select("path", "node", parts.alias("parts")))


GR24 = with_frames("path_nodes", body=""" SELECT path, node, k::INTEGER AS dropped, [node || '/mid/outer', 'mid/outer', 'outer'][k + 1] AS suffix FROM path_nodes, (SELECT unnest(range(0, 3)) AS k)""")


def ag16_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.occupancy(frames.path_edges(spark, sf_dir)).withColumn("paths", text("paths"))


AG16 = with_frames("path_edges", body=f" SELECT least(src, dst) AS a, greatest(src, dst) AS b, {_LIST.format('path')} AS paths FROM path_edges GROUP BY least(src, dst), greatest(src, dst)")


def gr19_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that an uncovered source or destination suppresses, after pruning by missing nodes."""
    nodes = frames.path_nodes(spark, sf_dir).select("path", "node", F.when(F.col("pos") == 0, "source").when(F.col("pos") == 1, "via").otherwise("destination").alias("role"))
    gone = frames.missing_nodes(spark, sf_dir)
    edges = frames.path_edges(spark, sf_dir).join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
    return graph.suppressed(nodes, edges).withColumn("uncovered", text("uncovered"))


GR19 = with_frames("path_edges", "path_nodes", body=f""", k AS (SELECT * FROM path_edges WHERE src % 11 <> 0 AND dst % 11 <> 0), h AS (SELECT path, src AS node FROM k UNION SELECT path, dst FROM k)
SELECT path, {_LIST.format('node')} AS uncovered FROM path_nodes n WHERE pos <> 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.path = n.path AND h.node = n.node) GROUP BY path""")


def ag10_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.completeness(frames.path_edges(spark, sf_dir), frames.missing_nodes(spark, sf_dir))


AG10 = with_frames("path_edges", body=""", n AS (SELECT path, src AS node FROM path_edges UNION SELECT path, dst FROM path_edges),
a AS (SELECT path, count(*) AS n_nodes, count(*) FILTER (WHERE node % 11 = 0) AS missing_nodes FROM n GROUP BY path),
b AS (SELECT path, count(*) AS n_edges, count(*) FILTER (WHERE src % 11 = 0 OR dst % 11 = 0) AS missing_edges FROM (SELECT DISTINCT path, src, dst FROM path_edges) GROUP BY path)
SELECT path, n_nodes, missing_nodes, n_edges, missing_edges, CASE WHEN missing_nodes = 0 THEN 'Complete' WHEN missing_edges < n_edges THEN 'Partial'
  ELSE 'None' END AS status FROM a JOIN b USING (path)""")


def ag1_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of nodes, edges and nerves (parts over a size) per path."""
    nodes = frames.path_nodes(spark, sf_dir)
    nerves = nodes.join(frames.table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("node")), "node").select("path", F.col("node").alias("nerve"))
    out = rollups.resolved_paths(nodes, frames.path_edges(spark, sf_dir), nerves)
    return out.select("path", text("nodes").alias("nodes"), F.array_join(F.transform("connectivity", lambda e: F.concat_ws(">", e["src"], e["dst"])), ",").alias("connectivity"), text("nerves").alias("nerves"))


AG1 = with_frames("path_edges", "path_nodes", body=f""", e AS (SELECT path, string_agg(src || '>' || dst, ',' ORDER BY src, dst) AS connectivity FROM (SELECT DISTINCT *
  FROM path_edges) GROUP BY path),
v AS (SELECT path, {_LIST.format('node')} AS nerves FROM path_nodes JOIN part ON p_partkey = node WHERE p_size > 45 GROUP BY path)
SELECT path, {_LIST.format('node')} AS nodes, any_value(connectivity) AS connectivity, any_value(nerves) AS nerves FROM path_nodes LEFT JOIN e USING (path) LEFT JOIN v USING (path) GROUP BY path""")


def ag2_node_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.inverted(frames.path_nodes(spark, sf_dir), "node", "path").withColumn("paths", text("paths"))


AG2 = with_frames("path_nodes", body=f" SELECT node, {_LIST.format('path')} AS paths FROM path_nodes GROUP BY node")


def ag5_cuffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.cuff_radius(frames.path_nodes(spark, sf_dir).select("path", F.col("node").alias("nerve")))


AG5 = with_frames("path_nodes", body=" SELECT node AS nerve, count(DISTINCT path) AS n_paths, round(5000 * (1 + ln(count(DISTINCT path) + 1)), 6) AS radius FROM path_nodes GROUP BY node")


def wn7_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = frames.path_edges(spark, sf_dir).select("path", (F.col("src") % 50).alias("src"), (F.col("dst") % 50).alias("dst")).where("src <> dst")
    return rollups.lanes(edges)


WN7 = with_frames("path_edges", body=""", d AS (SELECT DISTINCT least(src % 50, dst % 50) AS a, greatest(src % 50, dst % 50) AS b, path FROM path_edges WHERE src % 50 <> dst % 50),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY a, b) AS n FROM d)
SELECT a, b, path, (i - (n // 2 - ((n + 1) % 2) / 2.0::DOUBLE))::DOUBLE AS lane FROM r WHERE n > 1""")


def wn10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut at branch nodes (parts divisible by 4)."""
    nodes = frames.path_nodes(spark, sf_dir).withColumnRenamed("path", "line")
    out = rollups.segments(nodes, nodes.where("node % 4 = 0").select("node"))
    return out.withColumn("nodes", text("nodes"))


WN10 = with_frames("path_nodes", body=""", a AS (SELECT *, node % 4 = 0 AND pos > 0 AND pos < max(pos) OVER (PARTITION BY path) AS c FROM path_nodes),
k AS (SELECT *, sum(c::INTEGER) OVER (PARTITION BY path ORDER BY pos) AS k FROM a), r AS (SELECT path, pos, node, k FROM k UNION ALL SELECT path, pos, node, k - 1 FROM k WHERE c)
SELECT path AS line, CASE WHEN (SELECT max(k) FROM k z WHERE z.path = r.path) > 0 THEN path || '/' || (k + 1)::BIGINT ELSE path::VARCHAR END AS segment,
  string_agg(node::VARCHAR, ',' ORDER BY pos) AS nodes FROM r GROUP BY path, k""")


def wn12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of consecutive equal nodes once (node numbers in tens)."""
    n = frames.path_nodes(spark, sf_dir).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: F.floor(s["node"] / 1000)).alias("v"))
    return n.select("path", F.array_join(rollups.without_repeats(F.col("v")).cast("array<string>"), ",").alias("v"))


WN12 = with_frames("path_nodes", body=""", l AS (SELECT path, pos, node // 1000 AS v, lag(node // 1000) OVER (PARTITION BY path ORDER BY pos) AS b FROM path_nodes)
SELECT path, string_agg(v::VARCHAR, ',' ORDER BY pos) AS v FROM l WHERE b IS NULL OR b <> v GROUP BY path""")

_ALL = {
    blocked_paths: BLOCKED, ag11_missing_nodes: AG11, gr1_edge_table: GR1, gr2_degrees: GR2, ag9_terminals: AG9, gr3_pruned: GR3, gr4_bypassed: GR4, gr5_contracted: GR5, gr8_chains: GR8, gr18_loops: GR18, gr9_between: GR9,
    gr10_components: GR10, gr12_closure: GR12, gr13_two_levels: GR13, gr14_hierarchy: GR14, gr24_suffixes: GR24, ag16_occupancy: AG16, gr19_suppressed: GR19, ag10_completeness: AG10, ag1_resolved: AG1,
    ag2_node_paths: AG2, ag5_cuffs: AG5, wn7_lanes: WN7, wn10_segments: WN10, wn12_runs: WN12,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items() if sql}
