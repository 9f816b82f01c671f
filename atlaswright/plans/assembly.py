"""Routes assembled from drawn lines and known paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, graph
from . import frames
from .frames import part_names, table, with_frames


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_ENDS = "ends AS (SELECT path, src AS node, dst AS nb FROM path_edges UNION SELECT path, dst, src FROM path_edges)"
_NAME = "CASE node % 3 WHEN 0 THEN 'R' || node % 2 WHEN 1 THEN 'R' || node % 2 || '/N' || node % 4 ELSE 'R' || node % 2 || '/N' || node % 4 || '/C' || node % 12 END"


def gr6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.containing_neighbours(frames.path_edges(spark, sf_dir), part_names(spark, sf_dir))


GR6 = with_frames("path_edges", recursive=True, body=f""", {_ENDS}, nm AS (SELECT p_partkey AS node, {_NAME.replace('node', 'p_partkey')} AS name FROM part),
p AS (SELECT e.path, e.node, e.nb, a.name AS x, b.name AS y FROM ends e JOIN nm a ON a.node = e.node JOIN nm b ON b.node = e.nb),
c AS (SELECT path, node, nb FROM p WHERE starts_with(x, y || '/') UNION SELECT c.path, c.node, p.nb FROM c JOIN p ON p.path = c.path AND p.node = c.nb AND starts_with(p.x, p.y || '/'))
SELECT path, node, nb AS other, 'container' AS flag FROM c UNION ALL SELECT path, node, nb, 'identical' FROM p WHERE x = y AND node < nb""")


def gr21_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first part of each order to the nearest in use; some parts are containers."""
    e, n = frames.path_edges(spark, sf_dir), frames.path_nodes(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return assembly.upstream(e, n.where("pos = 0"), p.where("node % 5 = 0"), p.where("node % 13 = 1"))


GR21 = with_frames("path_edges", "path_nodes", recursive=True, body=f""", {_ENDS},
w AS (SELECT DISTINCT path, node AS start, node, 0 AS k FROM path_nodes WHERE pos = 0
  UNION SELECT w.path, w.start, e.nb, k + 1 FROM w JOIN ends e ON e.path = w.path AND e.node = w.node WHERE e.nb % 13 <> 1 AND (k = 0 OR w.node % 5 <> 0) AND k < 13),
h AS (SELECT path, start, node, min(k) AS k FROM w WHERE k > 0 AND node % 5 = 0 AND node <> start GROUP BY ALL)
SELECT path, start, k::INTEGER AS steps, node AS attached FROM h QUALIFY row_number() OVER (PARTITION BY path, start ORDER BY k, node) = 1""")


def gr22_centrelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem")
    r = n.select(F.col("l_orderkey").alias("path"), (F.col("l_suppkey") % 40).alias("centreline"), F.when(F.col("l_suppkey") % 4 == 0, F.col("l_suppkey") % 8).alias("model"), (F.col("l_partkey") % 6).alias("a"), (F.col("l_suppkey") % 6).alias("b"))
    return assembly.centreline_list(r).withColumn("centrelines", F.array_join("centrelines", ","))


GR22 = """WITH r AS (SELECT DISTINCT l_orderkey AS path, (l_suppkey % 40) || CASE WHEN l_suppkey % 4 = 0 THEN '=' || l_suppkey % 8 ELSE '' END AS c FROM lineitem WHERE l_partkey % 6 <> l_suppkey % 6)
SELECT path, string_agg(c, ',' ORDER BY c) AS centrelines FROM r GROUP BY path"""


def gr25_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is one component, named by its least part."""
    return assembly.circuits(frames.path_edges(spark, sf_dir))


GR25 = with_frames("path_edges", body=f""", {_ENDS}, d AS (SELECT path, node, count(*) AS n FROM ends GROUP BY ALL), m AS (SELECT path,
  path || '/' || min(node) AS component, count(*) FILTER (WHERE n > 2) AS branches FROM d GROUP BY path)
SELECT component, x.node AS a, y.node AS b, branches FROM d x JOIN d y ON x.path = y.path AND x.n = 1 AND y.n = 1 AND x.node < y.node JOIN m ON m.path = x.path""")


def gr26_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' diagonals as segments whose ends may lie near each other."""
    return assembly.end_chains(frames.containers(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), 60)


GR26 = with_frames("containers", recursive=True, body=""", e AS (SELECT id, 0 AS k, x0 AS x, y0 AS y FROM containers UNION ALL SELECT id, 1, x1, y1 FROM containers),
best AS (SELECT a.id, a.k, b.id AS id2, b.k AS k2 FROM e a JOIN e b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 3600
  QUALIFY row_number() OVER (PARTITION BY a.id, a.k ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id, b.k) = 1),
j AS (SELECT p.* FROM best p JOIN best q ON q.id = p.id2 AND q.k = p.k2 AND q.id2 = p.id AND q.k2 = p.k),
r AS (SELECT id, id AS m FROM containers UNION SELECT j.id2, r.m FROM r JOIN j ON j.id = r.id WHERE r.m < j.id2), c AS (SELECT id, min(m) AS chain FROM r GROUP BY id),
z AS (SELECT chain, bool_and((SELECT count(*) FROM j WHERE j.id = c.id) = 2) AS closed FROM c GROUP BY chain),
starts AS (SELECT chain, true AS closed, chain AS id, 0 AS way FROM z WHERE closed
  UNION ALL SELECT * FROM (SELECT c.chain, false, c.id, CASE WHEN EXISTS (SELECT 1 FROM j WHERE j.id = c.id AND j.k = 0) THEN 1 ELSE 0 END AS way FROM c JOIN z ON z.chain = c.chain AND NOT z.closed
    WHERE (SELECT count(*) FROM j WHERE j.id = c.id) < 2 QUALIFY row_number() OVER (PARTITION BY c.chain ORDER BY c.id) = 1)),
w AS (SELECT chain, closed, id, way, 0 AS place FROM starts UNION ALL SELECT w.chain, w.closed, j.id2, j.k2, place + 1 FROM w JOIN j ON j.id = w.id AND j.k = 1 - w.way
  WHERE j.id2 <> w.chain OR NOT w.closed)
SELECT id, chain, place::BIGINT AS place, way = 1 AS reversed, closed FROM w""")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' lines against orders of their type."""
    n = frames.path_nodes(spark, sf_dir)
    last = n.groupBy("path").agg(F.max("pos").alias("last"))
    nodes = n.join(last, "path").select("path", (F.col("path") % 3).alias("type"), (F.col("node") % 300).alias("node"), ((F.col("pos") == 0) | (F.col("pos") == F.col("last"))).alias("is_end"))
    k = F.col("s_suppkey")
    return assembly.validated(table(spark, sf_dir, "supplier").select(k.alias("line"), (k % 3).alias("type"), (k * 7 % 300).alias("a"), (k * 11 % 300).alias("b")), nodes)


_MATCHES = """n AS (SELECT path, path % 3 AS type, node % 300 AS node, pos = 0 OR pos = max(pos) OVER (PARTITION BY path) AS is_end FROM path_nodes),
l AS (SELECT s_suppkey AS line, s_suppkey % 3 AS type, s_suppkey * 7 % 300 AS a, s_suppkey * 11 % 300 AS b FROM supplier),
one AS (SELECT DISTINCT line, x.path FROM l JOIN n x ON x.type = l.type AND x.node = l.a AND x.is_end JOIN n y ON y.path = x.path AND y.node = l.b AND y.is_end),
m AS (SELECT line, path, 1 AS tier FROM one UNION ALL SELECT DISTINCT line, x.path, 2 FROM l JOIN n x ON x.type = l.type AND x.node = l.a JOIN n y ON y.path = x.path
  AND y.node = l.b WHERE line NOT IN (SELECT line FROM one))"""


def jn29_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


JN29 = with_frames("path_nodes", body=f", {_MATCHES} SELECT * FROM m")


def jn30_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.extra_lines(_matches(spark, sf_dir))


JN30 = with_frames("path_nodes", body=f""", {_MATCHES}
SELECT line, number - 2 AS number, path FROM (SELECT line, path, row_number() OVER (PARTITION BY line ORDER BY path)::INTEGER AS number FROM m) WHERE number > 1""")


def jn31_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts divisible by 3 are joiners without a term."""
    k = F.col("p_partkey")
    terms = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(k.alias("node"), (k % 30).alias("term"))
    return assembly.connection_terms(frames.path_nodes(spark, sf_dir), terms).withColumn("terms", _text("terms"))


JN31 = with_frames("path_nodes", body=" SELECT path, string_agg((node % 30)::VARCHAR, ',' ORDER BY pos) AS terms FROM path_nodes WHERE node % 3 <> 0 GROUP BY path HAVING count(*) > 1")


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts of routes named by number; some numbers are classes of one part or two."""
    routes = frames.path_nodes(spark, sf_dir).select(F.col("path").alias("route"), "pos", F.concat(F.lit("c"), F.floor(F.col("node") / 2)).alias("name"))
    k = F.col("p_partkey")
    return routes, table(spark, sf_dir, "part").where("p_partkey % 5 < 2").select(F.concat(F.lit("c"), F.floor(k / 2)).alias("name"), F.concat(F.lit("e"), k).alias("element"))


_CLASSES = "c AS (SELECT 'c' || p_partkey // 2 AS name, min('e' || p_partkey) AS element, count(*) AS n FROM part WHERE p_partkey % 5 < 2 GROUP BY 1)"


def jn40_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.remapped(*_classes(spark, sf_dir))[0].withColumn("elements", F.array_join("elements", ","))


JN40 = with_frames("path_nodes", body=f", {_CLASSES} SELECT path AS route, string_agg(coalesce(element, 'c' || node // 2), ',' ORDER BY pos) AS elements FROM path_nodes LEFT JOIN c ON name = 'c' || node // 2 GROUP BY path")


def jn40_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.remapped(*_classes(spark, sf_dir))[1]


JN40E = f"WITH {_CLASSES} SELECT name, n FROM c WHERE n > 1"


def jn42_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paths, drawn as a line, a junction and an arrow each."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    paths = o.select(k.alias("path"), F.when(F.col("o_orderstatus") == "F", "sensory").when(F.col("o_orderstatus") == "O", "somatic").alias("kind"), F.when(k % 2 == 0, "female").alias("sex"), F.when(k % 10 == 0, "alert").alias("alert"), F.concat(F.lit("Path "), k).alias("label"), F.col("o_orderpriority").alias("taxon"))
    roles = F.array(*map(F.lit, ("line", "junction", "arrow")))
    drawn = o.select(k.alias("path"), F.posexplode(roles).alias("n", "role")).select((F.col("path") * 3 + F.col("n")).alias("feature"), "path", "role")
    n = frames.path_nodes(spark, sf_dir)
    rows = assembly.path_properties(drawn, paths, n.where("node % 11 = 0"), n.where("node % 5 = 0").select("path", (F.col("node") % 20).alias("nerve")))
    return rows.withColumn("complete", F.col("complete").cast("string"))


JN42 = with_frames("path_nodes", body=""", m AS (SELECT path, string_agg(node::VARCHAR, ',' ORDER BY node) AS missing FROM (SELECT DISTINCT path, node FROM path_nodes
  WHERE node % 11 = 0) GROUP BY path),
v AS (SELECT path, string_agg(nerve::VARCHAR, ',' ORDER BY nerve) AS nerves FROM (SELECT DISTINCT path, node % 20 AS nerve FROM path_nodes WHERE node % 5 = 0) GROUP BY path),
d AS (SELECT o_orderkey AS path, o_orderkey * 3 + n AS feature, ['line', 'junction', 'arrow'][n + 1] AS role, o_orderstatus AS s, o_orderpriority AS taxon FROM orders, range(0, 3) t(n))
SELECT feature, path, CASE role WHEN 'line' THEN CASE s WHEN 'F' THEN 'sensory' WHEN 'O' THEN 'somatic' ELSE 'other' END ELSE role END AS kind, CASE
  WHEN role = 'line' THEN (missing IS NULL)::VARCHAR END AS complete,
CASE WHEN role = 'line' THEN missing END AS missing, CASE WHEN role = 'line' AND path % 2 = 0 THEN 'female' END AS sex, CASE WHEN role = 'line' AND path % 10 = 0 THEN 'alert' END AS alert,
CASE WHEN role = 'line' THEN nerves END AS nerves, CASE WHEN role = 'line' THEN 'Path ' || path END AS label, taxon FROM d LEFT JOIN m USING (path) LEFT JOIN v USING (path)""")


def _centrelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as centrelines; one in four has a model."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 4 == 0, k % 50).alias("model"), F.floor(k / 3).alias("container"))


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    nerves = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(k.alias("container"), (k + 1000).alias("model"))
    rules = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(k.alias("id"), (k + 2000).alias("model"))
    return assembly.centreline_models(_centrelines(spark, sf_dir), nerves, rules)


_MODELS = """m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 50 WHEN n.k IS NOT NULL THEN n.k + 1000 WHEN p_partkey % 7 = 0 THEN p_partkey + 2000 END AS model,
CASE WHEN p_partkey % 4 = 0 THEN 'own' WHEN n.k IS NOT NULL THEN 'nerve' WHEN p_partkey % 7 = 0 THEN 'rule' ELSE 'label' END AS source
FROM part LEFT JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 = 0) n ON n.k = p_partkey // 3)"""


def jn43_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir).withColumn("model", F.col("model").cast("string"))


JN43 = f"WITH {_MODELS} SELECT id, model::VARCHAR AS model, source FROM m"


def jn44_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("centreline"), (F.col("l_suppkey") + 100_000).alias("segment")).distinct()
    cuffs = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("model"), (F.col("s_suppkey") + 900_000).alias("cuff"))
    return assembly.model_segments(_models(spark, sf_dir), segments, cuffs)


JN44 = f"""WITH {_MODELS} SELECT DISTINCT model, l_suppkey + 100000 AS segment FROM m JOIN lineitem ON l_partkey = id WHERE model IS NOT NULL
UNION SELECT s_suppkey % 50, s_suppkey + 900000 FROM supplier"""


def ag15_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    c = _centrelines(spark, sf_dir).select("id", "model", (k % 80).alias("start"), (k * 3 % 80).alias("stop"), F.array(k % 80, k * 5 % 80, k % 60).alias("containers"))
    return assembly.centreline_index(c)


AG15 = """WITH c AS (SELECT p_partkey AS k FROM part) SELECT 'model' AS "index", k % 50 AS key, k AS id FROM c WHERE k % 4 = 0 UNION ALL SELECT DISTINCT 'end', unnest([k % 80, k * 3 % 80]), k FROM c
UNION ALL SELECT DISTINCT 'container', x, k FROM (SELECT k, unnest([k % 80, k * 5 % 80, k % 60]) AS x FROM c) WHERE x NOT IN (k % 80, k * 3 % 80)"""


def ag23_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.repeated_intermediates(frames.path_nodes(spark, sf_dir).withColumn("node", F.col("node") % 20))


AG23 = with_frames("path_nodes", body=""" SELECT path, node % 20 AS node, count(*) AS times FROM (SELECT *, max(pos) OVER (PARTITION BY path) AS last FROM path_nodes) WHERE pos > 0 AND pos < last
GROUP BY ALL HAVING count(*) > 1""")


def tk6_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degrees(frames.path_edges(spark, sf_dir))
    return assembly.terminal_order(d.select("path", "node", (F.col("node") % 4).alias("features"), (F.col("node") % 17).cast("double").alias("distance")))


TK6 = with_frames("path_edges", body=f""", {_ENDS}, n AS (SELECT DISTINCT path, node FROM ends)
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY CASE node % 4 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE WHEN node % 4 = 1 THEN node % 17 ELSE 0 END,
  node) - 1)::INTEGER AS turn, node FROM n""")

_ALL = {
    gr6_containers: GR6, gr21_upstream: GR21, gr22_centrelines: GR22, gr25_circuits: GR25, gr26_chains: GR26, jn29_validated: JN29, jn30_extra: JN30, jn31_terms: JN31,
    jn40_remapped: JN40, jn40_errors: JN40E, jn42_properties: JN42, jn43_models: JN43, jn44_segments: JN44, ag15_indexes: AG15, ag23_repeated: AG23, tk6_terminals: TK6,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items()}
