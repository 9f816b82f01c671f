"""Documents and reports put together from paths, logs and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pathtype
from ..operators import align, assembly, details, graph, quality, rollups, terms
from ..sources import documents, scans, sinks
from ..sources.scans import staged
from . import frames, paths
from .frames import table, with_frames


def _text(c: str):
    return F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))


def _phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("phenotype"))


def ag8_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing nodes of build logs against the orders as paths."""
    rows = rollups.missing_reports(frames.log_events(spark, sf_dir), frames.path_edges(spark, sf_dir), _phenotypes(spark, sf_dir))
    return rows.select("report", "key", *[_text(c).alias(c) for c in ("nodes", "paths", "phenotypes", "maps")])


AG8 = with_frames("log_events", "path_edges", body=""", e AS (SELECT path, src AS node, dst AS nb FROM path_edges UNION SELECT path, dst, src FROM path_edges),
  d AS (SELECT path, node, count(*) AS n FROM e GROUP BY ALL),
t AS (SELECT path, node FROM d QUALIFY n = min(n) OVER (PARTITION BY path)), l AS (SELECT DISTINCT node, map_id FROM log_events WHERE type = 'error'),
  u AS (SELECT DISTINCT path FROM log_events WHERE type = 'purchase' AND path IN (SELECT path FROM d)),
k AS (SELECT path, node FROM t WHERE path IN (SELECT path FROM u) AND node IN (SELECT node FROM l)), h AS (SELECT o_orderkey AS path, o_orderpriority AS p FROM orders),
  m AS (SELECT node, string_agg(map_id::VARCHAR, ',' ORDER BY map_id) AS maps FROM l GROUP BY node)
SELECT 'paths_minimal' AS report, u.path AS key, coalesce((SELECT string_agg(node::VARCHAR, ',' ORDER BY node) FROM k WHERE k.path = u.path), '') AS nodes,
  u.path::VARCHAR AS paths, p AS phenotypes, '' AS maps FROM u JOIN h USING (path)
UNION ALL SELECT 'node_minimal', node, node::VARCHAR, string_agg(path::VARCHAR, ',' ORDER BY path), string_agg(DISTINCT p, ',' ORDER BY p), any_value(maps) FROM k
  JOIN h USING (path) JOIN m USING (node) GROUP BY node
UNION ALL SELECT 'node_complete', node, node::VARCHAR, string_agg(path::VARCHAR, ',' ORDER BY path), string_agg(DISTINCT p, ',' ORDER BY p), '' FROM d JOIN h USING (path)
  JOIN m USING (node) GROUP BY node""")


def snk6_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two in three orders are rendered; every seventh was drawn as a connection too."""
    n = frames.path_nodes(spark, sf_dir)
    nodes = n.where("path % 3 > 0").select("path", "node")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), "o_orderpriority", "o_orderstatus")
    models = o.select(F.concat(F.lit("m"), F.col("path") % 50).alias("model"), "path")
    ends = n.where("path % 7 = 0").groupBy("path").agg(F.min("node").alias("a"), F.max("node").alias("b")).join(o, "path")
    drawn = ends.select(F.concat(F.lit("drawn"), F.col("path") % 2).alias("model"), (F.col("path") + 10**9).alias("path"), F.col("o_orderstatus").alias("kind"), F.col("path").alias("line"), F.array("a", "b").alias("nodes"))
    return rollups.connectivity_document(models, nodes, nodes.select("path", (F.col("node") + 10**6).alias("line")), nodes.where("node % 5 = 0").select("path", (F.col("node") % 20).alias("nerve")), o.select("path", F.col("o_orderpriority").alias("kind")), drawn)


SNK6 = with_frames("path_nodes", body=""", n AS (SELECT DISTINCT path, node FROM path_nodes WHERE path % 3 > 0), w AS (SELECT path, o_orderstatus AS s, min(node) AS a,
  max(node) AS b FROM path_nodes JOIN orders ON o_orderkey = path WHERE path % 7 = 0 GROUP BY ALL),
i AS (SELECT path, 'nodes' AS w, node AS id FROM n UNION SELECT path, 'lines', node + 1000000 FROM n UNION SELECT path, 'nerves', node % 20 FROM n WHERE node % 5 = 0
  UNION SELECT path + 1000000000, 'lines', path FROM w UNION SELECT path + 1000000000, 'nodes', unnest([a, b]) FROM w),
r AS (SELECT DISTINCT path FROM i), k AS (SELECT o_orderpriority AS kind, o_orderkey AS path FROM orders WHERE o_orderkey IN (SELECT path FROM r) UNION SELECT s, path + 1000000000 FROM w),
m AS (SELECT 'm' || o_orderkey % 50 AS model, o_orderkey AS path FROM orders WHERE o_orderkey IN (SELECT path FROM r) UNION SELECT 'drawn' || path % 2, path + 1000000000 FROM w)
SELECT 'paths' AS section, path::VARCHAR AS key,
  '{"lines":[' || coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (w = 'lines'), '') || '],"nodes":[' || coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (w = 'nodes'), '') || '],"nerves":[' || coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (w = 'nerves'), '') || ']}' AS value FROM i GROUP BY path
UNION ALL SELECT 'node-paths', id::VARCHAR, '[' || string_agg(path::VARCHAR, ',' ORDER BY path) || ']' FROM i WHERE w = 'nodes' GROUP BY id
UNION ALL SELECT 'type-paths', kind, '[' || string_agg(path::VARCHAR, ',' ORDER BY path) || ']' FROM k GROUP BY kind UNION ALL SELECT 'models', model,
  '[' || string_agg(path::VARCHAR, ',' ORDER BY path) || ']' FROM m GROUP BY model""")


def gr27_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rendered without their missing parts; every ninth part stands for the one before it; orders lead on to the next but one."""
    n = frames.path_nodes(spark, sf_dir).select("path", "node").distinct()
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    same = part.where("p_partkey % 9 = 0 and p_partkey > 0").select(k.alias("node"), (k - 1).alias("into"))
    phenotypes = n.select("path", F.concat(F.lit("ph"), F.col("node") % 3).alias("phenotype"), "node")
    forward = n.select("path", (F.col("path") + 2).alias("target")).distinct()
    rows = rollups.rendered_lists(paths.gr4_bypassed(spark, sf_dir), same, phenotypes, forward, n.where("node % 5 = 0"), part.where("p_partkey % 2 = 0").select(k.alias("node")))
    pair = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(">", x[a].cast("string"), x[b].cast("string"))), ",")
    kinds = F.array_join(F.transform("phenotypes", lambda x: F.concat_ws(":", x["phenotype"], F.array_join(x["nodes"].cast("array<string>"), "+"))), ",")
    return rows.select("path", pair("connectivity", "src_as", "dst_as").alias("connectivity"), kinds.alias("phenotypes"), F.array_join(F.col("forward").cast("array<string>"), ",").alias("forward"), F.array_join(F.col("nerves").cast("array<string>"), ",").alias("nerves"), pair("mappings", "as", "node").alias("mappings"))


_AS = "CASE WHEN {0} % 9 = 0 AND {0} > 0 THEN {0} - 1 ELSE {0} END"
GR27L = f"""WITH b AS ({paths.ORACLE_SQL["gr4_bypassed"]}), n AS (SELECT DISTINCT path, node FROM ({frames.SQL["path_nodes"]})), v AS (SELECT path, src AS node FROM b
  UNION SELECT path, dst FROM b), w AS (SELECT path, node, {_AS.format('node')} AS a FROM v),
c AS (SELECT DISTINCT path, {_AS.format('src')} AS s, {_AS.format('dst')} AS t FROM b), h AS (SELECT DISTINCT path, 'ph' || node % 3 AS p, a FROM n JOIN w USING (path,
  node)), g AS (SELECT path, p, p || ':' || string_agg(a::VARCHAR, '+' ORDER BY a) AS x FROM h GROUP BY path, p),
u AS (SELECT DISTINCT path, {_AS.format('node')} AS a FROM n WHERE node % 10 = 0 AND node IN (SELECT p_partkey FROM part))
SELECT path, (SELECT string_agg(s || '>' || t, ',' ORDER BY s, t) FROM c WHERE c.path = w.path) AS connectivity, (SELECT string_agg(x, ',' ORDER BY p) FROM g WHERE g.path = w.path) AS phenotypes,
CASE WHEN path + 2 IN (SELECT path FROM b) THEN (path + 2)::VARCHAR END AS forward, (SELECT string_agg(a::VARCHAR, ',' ORDER BY a) FROM u
  WHERE u.path = w.path) AS nerves, string_agg(a || '>' || node, ',' ORDER BY a, node) AS mappings FROM w GROUP BY path"""


def ag25_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anatomical nodes, as JSON, that have used each feature (half a part)."""
    n = frames.path_nodes(spark, sf_dir)
    node = F.to_json(F.array(F.concat(F.lit("T:"), F.col("node")), F.concat(F.lit("L:"), F.col("node") % 7)))
    return rollups.inverted(n.select(F.floor(F.col("node") / 2).alias("feature"), node.alias("node")), "feature", "node").withColumn("nodes", F.array_join("nodes", ";"))


AG25 = with_frames("path_nodes", body=""" SELECT feature, string_agg(j, ';' ORDER BY j) AS nodes FROM (SELECT DISTINCT node // 2 AS feature,
  '["T:' || node || '","L:' || node % 7 || '"]' AS j FROM path_nodes) GROUP BY feature""")


def ag28_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publications (clerks) of each model (customer)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("model"), F.concat(F.lit("doi:"), F.col("o_orderkey") % 1000).alias("publication"))
    return rollups.inverted(o, "model", "publication").withColumn("publications", F.array_join("publications", ","))


AG28 = "SELECT model, string_agg(p, ',' ORDER BY p) AS publications FROM (SELECT DISTINCT o_custkey AS model, 'doi:' || o_orderkey % 1000 AS p FROM orders) GROUP BY model"


def tk4_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each map's log, numbered by location, then issue."""
    log = frames.log_events(spark, sf_dir).where("level <> 'info'")
    rows = quality.issue(log, "log", "LOG", F.col("node"), F.concat_ws(" ", "msg", "seq"))
    return rollups.numbered(rows, ["map_id"], ["location", "issue"])


TK4 = with_frames("log_events", body=""" SELECT map_id, 'log' AS type, 'LOG' AS code, node::VARCHAR AS location, msg || ' ' || seq AS issue,
  row_number() OVER (PARTITION BY map_id ORDER BY node::VARCHAR, msg || ' ' || seq) AS number FROM log_events WHERE level <> 'info'""")

def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points, lines and boxes with some of the properties that are written; every 17th is excluded."""
    f, k = frames.features(spark, sf_dir), F.col("id")
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    points = F.when(k % 3 == 0, F.array(p("x0", "y0"))).when(k % 3 == 1, F.array(p("x0", "y1"), p("x1", "y0"))).otherwise(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")))
    own = {
        "centreline": F.when(k % 5 == 0, True), "class": F.col("class"), "group": F.when(k % 4 == 0, "g"), "hyperlinks": F.when(k % 6 == 0, F.array(F.struct(F.lit("pmr").alias("id"), F.lit("u").alias("url")))),
        "kind": F.when(k % 5 == 0, "centreline"), "label": F.when(k % 7 > 0, F.col("name")).otherwise(""), "maxzoom": F.when(k % 8 == 0, F.lit(9)), "minzoom": F.when(k % 9 == 0, F.lit(3)), "tile-layer": F.lit("main/features"), "hidden": F.lit("x"),
    }
    return f.select("id", F.lit("base/one").alias("layer"), points.alias("points"), (k % 3 == 1).alias("open"), (k % 17 == 0).alias("exclude"), *[v.alias(c) for c, v in own.items()])


def snk1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.feature_documents(_drawn(spark, sf_dir), 4e6)


_CORNERS = "[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || ']"
_DRAWN = """, f AS (SELECT id, class, name, x0, y0, CASE WHEN id % 3 = 0 THEN x0 ELSE x1 END AS x1, CASE WHEN id % 3 = 0 THEN y0 ELSE y1 END AS y1 FROM features WHERE id % 17 <> 0),
a AS (SELECT *, CASE WHEN id % 3 = 2 THEN (x1 - x0) * (y1 - y0) ELSE 0 END::DOUBLE AS area FROM f), s AS (SELECT *, CASE
  WHEN area > 0 THEN round(log2(sqrt(4e6::DOUBLE / area)), 6) ELSE 10::DOUBLE END AS scale FROM a)"""
SNK1D = with_frames("features", body=_DRAWN + f"""
SELECT 'base_one_main_features' AS tile_layer, id,
  '{{"type":"Feature","id":' || id || ',"tippecanoe":{{"layer":"base_one_main_features"' || CASE WHEN id % 8 = 0 THEN ',"maxzoom":9' ELSE '' END || CASE WHEN id % 9 = 0 THEN ',"minzoom":3' WHEN area > 0 AND scale > 6 AND id % 4 > 0 THEN ',"minzoom":4' ELSE '' END
|| '}},"geometry":{{"type":' || CASE id % 3 WHEN 0 THEN '"Point","coordinates":[' || x0 || ',' || y0 || ']'
  WHEN 1 THEN '"LineString","coordinates":[[' || x0 || ',' || y1 || '],[' || x1 || ',' || y0 || ']]' ELSE '"Polygon","coordinates":[[{_CORNERS},[' || x0 || ',' || y0 || ']]]' END
|| '}},"properties":{{"bounds":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || '],"area":' || area || ',"length":' || CASE id % 3 WHEN 0 THEN 0::DOUBLE
  WHEN 1 THEN round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) ELSE (2 * (x1 - x0 + y1 - y0))::DOUBLE END || ',"layer":"base/one","scale":' || scale
|| CASE WHEN id % 5 = 0 THEN ',"centreline":true' ELSE '' END || ',"class":"' || class || '"' || CASE WHEN id % 4 = 0 THEN ',"group":"g"' ELSE '' END || CASE
  WHEN id % 6 = 0 THEN ',"hyperlinks":[{{"id":"pmr","url":"u"}}]' ELSE '' END || CASE WHEN id % 5 = 0 THEN ',"kind":"centreline"' ELSE '' END
|| CASE WHEN id % 7 > 0 THEN ',"label":"' || name || '"' ELSE '' END || CASE WHEN id % 8 = 0 THEN ',"maxzoom":9' ELSE '' END || CASE WHEN id % 9 = 0 THEN ',"minzoom":3'
  ELSE '' END || ',"tile-layer":"main/features"}}}}' AS feature FROM s""")


def snk2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations in a map of centrelines; parts of orders are the nodes that used them."""
    n = table(spark, sf_dir, "lineitem").where("l_partkey % 4 > 0").select(F.col("l_partkey").alias("id"), F.to_json(F.array(F.concat(F.lit("T:"), F.col("l_suppkey") % 3))).alias("node"))
    return sinks.feature_annotations(_drawn(spark, sf_dir), n, centreline_map=True)


SNK2D = with_frames("features", body=_DRAWN + """, u AS (SELECT id, string_agg(j, ',' ORDER BY j) AS used FROM (SELECT DISTINCT l_partkey AS id,
  '["T:' || l_suppkey % 3 || '"]' AS j FROM lineitem WHERE l_partkey % 4 > 0) GROUP BY id)
SELECT id, '{' || CASE WHEN id % 5 = 0 THEN '"centreline":true,' ELSE '' END || '"class":"' || class || '"' || CASE WHEN id % 4 = 0 THEN ',"group":"g"' ELSE '' END || CASE WHEN id % 6 = 0 THEN ',"hyperlinks":"[{\\"id\\":\\"pmr\\",\\"url\\":\\"u\\"}]"' ELSE '' END || CASE WHEN id % 5 = 0 THEN ',"kind":"centreline"' ELSE '' END
|| CASE WHEN id % 7 > 0 THEN ',"label":"' || name || '"' ELSE '' END || CASE WHEN id % 8 = 0 THEN ',"maxzoom":9' ELSE '' END || CASE WHEN id % 9 = 0 THEN ',"minzoom":3'
  ELSE '' END || ',"tile-layer":"main/features","bounds":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1
|| '],"markerPosition":[' || ((x0 + x1) / 2)::DOUBLE || ',' || ((y0 + y1) / 2)::DOUBLE || '],"geometry":"' || ['Point', 'LineString', 'Polygon'][id % 3 + 1] || '","layer":"base/one"'
|| CASE WHEN id % 3 = 1 THEN ',"pathStartPosition":[' || x0 || ',' || y1 || '],"pathEndPosition":[' || x1 || ',' || y0 || ']' || CASE
  WHEN id % 5 = 0 THEN ',"coordinates":[[' || x0 || ',' || y1 || '],[' || x1 || ',' || y0 || ']]' ELSE '' END ELSE '' END
|| coalesce(',"anatomical-nodes":[' || used || ']', '') || '}' AS annotation FROM s LEFT JOIN u USING (id)""")


def jn29_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' lines between terms in organs, against orders whose parts have up to three terms."""
    n = frames.path_nodes(spark, sf_dir)
    last = n.groupBy("path").agg(F.max("pos").alias("last"))
    k = F.col("node")
    terms = F.slice(F.array(k % 60, k % 9 + 100, k % 4 + 200), 1, (k % 3 + 1).cast("int"))
    nodes = n.join(last, "path").select("path", (F.col("path") % 3).alias("type"), terms.alias("terms"), ((F.col("pos") == 0) | (F.col("pos") == F.col("last"))).alias("is_end"))
    s = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select(s.alias("line"), (s % 3).alias("type"), (s * 7 % 60).alias("a"), F.when(s % 2 == 0, s % 9 + 100).alias("a_organ"), (s * 11 % 60).alias("b"), F.when(s % 5 > 1, s % 4 + 200).alias("b_organ"))
    return assembly.validated_by_terms(lines, nodes)


JN29T = with_frames("path_nodes", body=""", n AS (SELECT path, path % 3 AS type, [node % 60, node % 9 + 100, node % 4 + 200][1:node % 3 + 1] AS t, pos = 0
  OR pos = max(pos) OVER (PARTITION BY path) AS e FROM path_nodes),
p AS (SELECT path, type, e, t[i] AS term, t[i + 1:] AS layers FROM n, range(1, 4) r(i) WHERE i <= len(t)), l AS (SELECT s_suppkey AS line, s_suppkey % 3 AS type,
  s_suppkey * 7 % 60 AS a, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 9 + 100 END AS ao, s_suppkey * 11 % 60 AS b, CASE WHEN s_suppkey % 5 > 1 THEN s_suppkey % 4 + 200 END AS bo FROM supplier),
x AS (SELECT DISTINCT line, path, e FROM l JOIN p ON p.type = l.type AND ((term = a AND (len(layers) = 0 OR ao IS NULL OR list_contains(layers, ao))) OR term = ao)),
y AS (SELECT DISTINCT line, path, e FROM l JOIN p ON p.type = l.type AND ((term = b AND (len(layers) = 0 OR bo IS NULL OR list_contains(layers, bo))) OR term = bo)),
one AS (SELECT DISTINCT line, path FROM x JOIN y USING (line, path) WHERE x.e AND y.e)
SELECT line, path, 1 AS tier FROM one UNION ALL SELECT DISTINCT line, path, 2 FROM x JOIN y USING (line, path) WHERE line NOT IN (SELECT line FROM one)""")

def src13_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts drawn in their brand's drawing, in a group of their size."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    style = F.when(k % 3 == 0, F.concat(F.lit(' style="stroke:none; fill:#'), k % 10, F.lit('"'))).when(k % 3 == 1, ' fill="red" stroke="blue"').otherwise("")
    rect = F.concat(F.lit('<rect id="r'), k, F.lit('" width="'), k % 9, F.lit('"'), style, F.lit("><title>.id(P"), k, F.lit(")</title></rect>"))
    groups = p.groupBy("p_brand", "p_size").agg(F.array_join(F.array_sort(F.collect_list(rect)), "").alias("inner")).select("p_brand", F.concat(F.lit('<g id="s'), "p_size", F.lit('"><g>'), "inner", F.lit("</g></g>")).alias("g"))
    drawings = groups.groupBy(F.col("p_brand").alias("doc")).agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(F.array_sort(F.collect_list("g")), ""), F.lit("</svg>")).alias("xml"))
    return documents.drawing_tree(drawings).select("doc", "tag", "id", "title", "depth", "group", "fill", "stroke", F.try_element_at("attributes", F.lit("width")).alias("width"))


SRC13T = """WITH s AS (SELECT DISTINCT p_brand, p_size FROM part)
SELECT p_brand AS doc, 'svg' AS tag, NULL AS id, NULL AS title, 0 AS depth, NULL AS "group", NULL AS fill, NULL AS stroke, NULL AS width FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL SELECT p_brand, 'g', 's' || p_size, NULL, 1, NULL, NULL, NULL, NULL FROM s UNION ALL SELECT p_brand, 'g', NULL, NULL, 2, 's' || p_size, NULL, NULL, NULL FROM s
UNION ALL SELECT p_brand, 'rect', 'r' || p_partkey, '.id(P' || p_partkey || ')', 3, 's' || p_size, CASE p_partkey % 3 WHEN 0 THEN '#' || p_partkey % 10
  WHEN 1 THEN 'red' END, CASE WHEN p_partkey % 3 = 1 THEN 'blue' END, (p_partkey % 9)::VARCHAR FROM part"""


def src2_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as maps, their parts as sources."""
    n, k = frames.path_nodes(spark, sf_dir), F.col("node")
    kinds = F.element_at(F.array(*map(F.lit, ("base", "details", "image", "slides", "functional"))), (k % 5 + 1).cast("int"))
    listed = n.groupBy(F.col("path").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", kinds.alias("kind"), F.concat(F.lit("s"), "pos").alias("id")))), lambda s: F.struct(s["id"].alias("id"), s["kind"].alias("kind"))).alias("sources"))
    return documents.base_errors(documents.ordered_sources(listed))


SRC2 = with_frames("path_nodes", body=""", k AS (SELECT path AS map_id, 's' || pos AS id, ['base', 'details', 'image', 'slides', 'functional'][node % 5 + 1] AS kind, pos FROM path_nodes),
o AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY CASE WHEN kind IN ('base', 'slides') THEN 0 ELSE 1 END, kind, pos) AS r FROM k)
SELECT map_id, id, CASE WHEN r = 1 THEN 'Details layer cannot be the base map' ELSE 'Can only have a single base map' END AS error FROM o WHERE (r = 1
  AND kind = 'details') OR (r > 1 AND kind IN ('base', 'slides'))""")


def ag16_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders over 30 nodes, first steps upstream ones, last ones terminal."""
    n = frames.path_nodes(spark, sf_dir)
    w = Window.partitionBy("path").orderBy("pos")
    e = n.select("path", "pos", F.col("node") % 30, F.lead(F.col("node") % 30).over(w), F.lead("node", 2).over(w)).toDF("path", "pos", "src", "dst", "more").where("dst is not null")
    kind = F.when(F.col("more").isNull(), "terminal").when(F.col("pos") == 0, "upstream").otherwise("centreline")
    return graph.occupancy_apart(e.withColumn("type", kind)).withColumn("paths", _text("paths"))


AG16A = with_frames("path_nodes", body=""", e AS (SELECT path, pos, node % 30 AS s, lead(node % 30) OVER w AS t, lead(node, 2) OVER w AS m
  FROM path_nodes WINDOW w AS (PARTITION BY path ORDER BY pos)),
d AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b, m IS NULL OR pos = 0 AS terminal, path FROM e WHERE t IS NOT NULL) SELECT a, b, terminal,
  string_agg(path::VARCHAR, ',' ORDER BY path) AS paths FROM d GROUP BY a, b, terminal""")


def ag15_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as network nodes, two in three of them parts of a unit."""
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("n"), k).alias("node"), F.when(k % 3 > 0, F.floor(k / 6)).alias("unit"), k.alias("feature"))
    return assembly.unit_index(nodes).withColumn("nodes", _text("nodes"))


AG15U = """WITH n AS (SELECT 'n' || p_partkey AS node, p_partkey // 6 AS unit FROM part WHERE p_partkey % 3 > 0), a AS (SELECT unit, node FROM n UNION SELECT p_partkey,
  'n' || p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey IN (SELECT unit FROM n))
SELECT unit, string_agg(node, ',' ORDER BY node) AS nodes FROM a GROUP BY unit"""


def jn43_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as centrelines, customers as their models, suppliers as cuffs."""
    nodes = frames.path_nodes(spark, sf_dir).groupBy("path").agg(F.collect_set("node").alias("nodes"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 200).alias("model")).join(nodes, "path").select((F.col("path") + 10**9).alias("id"), "model", "nodes")
    cuffs = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3 % 200).alias("model"), F.concat(F.lit("cuff"), F.col("s_suppkey") % 1000).alias("cuff"))
    k = F.col("p_partkey")
    known = table(spark, sf_dir, "part").select(k.alias("feature"), F.when(k % 4 == 0, k).alias("model"), F.when(k % 5 == 0, F.col("p_name")).alias("label"))
    return assembly.network_properties(lines, cuffs, known)


JN43N = with_frames("path_nodes", body=""", c AS (SELECT s_suppkey * 3 % 200 AS m, min('cuff' || s_suppkey % 1000) AS cuff FROM supplier GROUP BY 1),
  o AS (SELECT o_orderkey AS k, o_custkey AS m FROM orders WHERE o_orderkey IN (SELECT path FROM path_nodes))
SELECT k + 1000000000 AS feature, 'nerve' AS prop, cuff AS value FROM o JOIN c ON c.m = o.m % 200 WHERE o.m % 2 = 0 UNION ALL SELECT k + 1000000000, 'centreline', 'true' FROM o
UNION ALL SELECT DISTINCT node, 'node', 'true' FROM path_nodes WHERE node NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0)""")

def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model documents: customers' orders as paths with drawn lines, nerves and routes, some of them misspelt."""
    nodes = frames.path_nodes(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("node").cast("string").alias("node")))).alias("n"))
    o = table(spark, sf_dir, "orders").join(nodes, F.col("o_orderkey") == F.col("path"))
    k = F.col("path")
    first, last = F.element_at("n.node", 1), F.element_at("n.node", -1)
    lines = F.when(k % 4 == 0, F.concat_ws(" ,", first, last)).when(k % 4 == 1, F.concat(first, F.lit(", ")))
    route = F.when(k % 3 == 0, F.concat(F.lit("("), first, F.lit(", x:"), first, F.lit("), "), last)).when(k % 3 == 1, F.concat(F.lit("("), first))
    path = F.struct(F.concat(F.lit("p"), k).alias("id"), F.col("o_orderpriority").alias("models"), F.when(k % 5 == 0, F.concat(F.lit("n/"), last)).alias("nerves"), lines.alias("path"), route.alias("route"), F.col("n.node").alias("nodes"))
    traced = F.collect_list(F.when(k % 6 == 0, F.concat(F.lit("p"), k))).alias("traced-paths")
    return o.groupBy(F.concat(F.lit("m"), F.col("o_custkey")).alias("id")).agg(F.collect_list(path).alias("paths"), traced, F.concat(F.lit("s"), F.first("o_custkey")).alias("source"))


def src10_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = scans.model_paths(spark, staged(_models(spark, sf_dir), "json"))
    return good.select("id", "source", "path", "models", F.size("nodes").alias("n_nodes"), F.array_join("lines", ",").alias("lines"), F.array_join("nerves", ",").alias("nerves"), F.array_join(F.transform("route", lambda g: F.array_join(g, "+")), ",").alias("route"), "traced")


_ENDS_OF = "o AS (SELECT path AS k, arg_min(node, pos) AS a, arg_max(node, pos) AS b, count(*) AS n FROM path_nodes GROUP BY path)"
SRC10P = with_frames("path_nodes", body=f""", {_ENDS_OF} SELECT 'm' || o_custkey AS id, 's' || o_custkey AS source, 'p' || k AS path, o_orderpriority AS models,
  n::INTEGER AS n_nodes, CASE WHEN k % 4 = 0 THEN a || ',' || b END AS lines,
CASE WHEN k % 5 = 0 THEN 'n/' || b END AS nerves, CASE WHEN k % 3 = 0 THEN a || '+x:' || a || ',' || b END AS route, k % 6 = 0 AS traced FROM o JOIN orders ON o_orderkey = k""")


def src10_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.model_paths(spark, staged(_models(spark, sf_dir), "json"))[1]


SRC10E = with_frames("path_nodes", body=f""", {_ENDS_OF} SELECT 'm' || o_custkey AS id, 'p' || k AS path, 'Syntax error in path lines list: ' || a || ', ' AS error FROM o
  JOIN orders ON o_orderkey = k WHERE k % 4 = 1
UNION ALL SELECT 'm' || o_custkey, 'p' || k, 'Syntax error in route node list: (' || a FROM o JOIN orders ON o_orderkey = k WHERE k % 3 = 1""")

def src12_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as entities; parts of a size are known, with their orders as paths."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = lambda c: F.concat(F.lit("E:"), c)
    on = frames.path_nodes(spark, sf_dir).groupBy("node").agg(F.collect_set("path").alias("paths"))
    known = p.where("p_size > 20").join(on, k == F.col("node"), "left").select(name(k).alias("entity"), F.when(k % 4 > 0, F.col("p_name")).alias("label"), "paths")
    return terms.knowledge_labels(p.select(name(k).alias("entity")).union(table(spark, sf_dir, "supplier").select(name(F.col("s_suppkey") * 7))), known)


SRC12 = with_frames("path_nodes", body=""", e AS (SELECT p_partkey AS k FROM part UNION SELECT s_suppkey * 7 FROM supplier)
SELECT 'E:' || k AS entity, CASE WHEN p_size > 20 AND k % 4 > 0 THEN p_name ELSE 'E:' || k END AS label, CASE WHEN p_size > 20 THEN (SELECT count(DISTINCT path)
  FROM path_nodes WHERE node = k) ELSE 0 END::INTEGER AS n_paths, coalesce(p_size > 20, false) AS known FROM e LEFT JOIN part ON p_partkey = k""")


def ag13_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part types as keys of brands; some are taken."""
    p = table(spark, sf_dir, "part")
    keys = p.where("p_size < 6").select(F.concat_ws(" ", "p_type", F.col("p_partkey") % 5).alias("key"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_brand")).alias("term"))
    return terms.unambiguous(keys, p.where("p_size = 50").select(F.concat_ws(" ", "p_type", F.col("p_partkey") % 5).alias("key")))


AG13 = """SELECT p_type || ' ' || p_partkey % 5 AS key, min(p_brand) AS term FROM part WHERE p_size < 6 AND p_partkey % 7 > 0
  AND p_type || ' ' || p_partkey % 5 NOT IN (SELECT p_type || ' ' || p_partkey % 5 FROM part WHERE p_size = 50) GROUP BY 1 HAVING count(DISTINCT p_brand) = 1"""


def ag24_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    layers = table(spark, sf_dir, "part").select(k.alias("node"), F.array(F.concat(F.lit("T:"), F.floor(k / 2)), F.concat(F.lit("L:"), k % 13)).alias("terms"))
    nodes, named = terms.knowledge_terms(frames.path_edges(spark, sf_dir), layers)
    return nodes.select(F.lit("node").alias("kind"), F.col("node").cast("string").alias("value")).union(named.select(F.lit("term"), "term"))


AG24 = with_frames("path_edges", body=""", n AS (SELECT src AS k FROM path_edges UNION SELECT dst FROM path_edges)
SELECT 'node' AS kind, k::VARCHAR AS value FROM n UNION ALL SELECT DISTINCT 'term', unnest(['T:' || k // 2, 'L:' || k % 13]) FROM n WHERE k IN (SELECT p_partkey FROM part)""")


def ag29_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as connections: their first two parts are their connectors, the third a component, further ones are passed."""
    n, k = frames.path_nodes(spark, sf_dir), F.col("node")
    kind = F.when(k % 10 == 0, "free-end").when(k % 10 == 1, "joiner").otherwise("port")
    rows = details.connection_nodes(
        n.where("pos < 2").select(F.col("path").alias("connection"), k.alias("connector"), kind.alias("kind")), table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("connector"), (F.col("p_partkey") + 10**6).alias("parent")),
        n.where("pos = 2").select(F.col("path").alias("connection"), k.alias("component")), n.where("pos > 2").select(F.col("path").alias("connection"), k.alias("connector")),
    )
    return rows.withColumn("nodes", _text("nodes"))


AG29 = with_frames("path_nodes", body=""", e AS (SELECT path, node FROM path_nodes UNION SELECT path, node + 1000000 FROM path_nodes WHERE pos < 2 AND node % 3 > 0
  AND node IN (SELECT p_partkey FROM part)), f AS (SELECT path, bool_or(node % 10 < 2) AS f FROM path_nodes WHERE pos < 2 GROUP BY path)
SELECT path AS connection, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes, any_value(f) AS free_end FROM e JOIN f USING (path) GROUP BY path""")


def jn18_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = frames.points(spark, sf_dir).select(F.floor(F.col("id") / 2).alias("line"), (F.col("id") % 2).alias("end"), "x", "y")
    return details.touching(ends, frames.features(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), 10).withColumn("lines", _text("lines"))


JN18T = with_frames("points", "features", body=""" SELECT component, string_agg(l::VARCHAR, ',' ORDER BY l) AS lines FROM (SELECT DISTINCT f.id AS component, p.id // 2 AS l
FROM points p JOIN features f ON f.x0 <= p.x + 10 AND f.x1 >= p.x - 10 AND f.y0 <= p.y + 10 AND f.y1 >= p.y - 10) GROUP BY component""")


def so2_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of orders, rendered or missing (SO-2, SNK-10)."""
    e = frames.path_edges(spark, sf_dir)
    lost = frames.missing_nodes(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    edges = rollups.rendered(e, e.join(lost.toDF("src"), "src", "left_semi").unionByName(e.join(lost.toDF("dst"), "dst", "left_semi").select("dst", "path", "src")), ["path", "src", "dst"])
    by = lambda df, what: df.groupBy("missing").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "missing", "n")
    return by(rollups.rendered(nodes, lost, ["node"]), "node").union(by(edges, "edge"))


SO2 = with_frames("path_edges", "missing_nodes", body=""" SELECT 'node' AS what, node IN (SELECT node FROM missing_nodes) AS missing, count(*) AS n
  FROM (SELECT src AS node FROM path_edges UNION SELECT dst FROM path_edges) GROUP BY ALL
UNION ALL SELECT 'edge', src IN (SELECT node FROM missing_nodes) OR dst IN (SELECT node FROM missing_nodes), count(*) FROM (SELECT DISTINCT * FROM path_edges) GROUP BY ALL""")


def so3_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frames.log_events(spark, sf_dir).where("level <> 'info'")
    return rollups.in_all_maps(log.select("map_id", F.concat_ws(" ", "msg", F.col("node") % 12).alias("issue")))


SO3 = with_frames("log_events", body=" SELECT msg || ' ' || node % 12 AS issue FROM log_events WHERE level <> 'info' GROUP BY 1 HAVING count(DISTINCT map_id) = (SELECT count(DISTINCT map_id) FROM log_events WHERE level <> 'info')")


def so4_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and destinations of orders, of which some are not in their connectivity (SO-4, GR-19)."""
    n = frames.path_nodes(spark, sf_dir)
    roles = n.where("pos < 2").select("path", (F.col("node") + F.when(F.col("path") % 13 == 0, 1).otherwise(0)).alias("node"), F.when(F.col("pos") == 0, "source").otherwise("via").alias("role"))
    return graph.suppressed(roles, frames.path_edges(spark, sf_dir)).withColumn("uncovered", _text("uncovered"))


SO4 = with_frames("path_nodes", "path_edges", body=""", r AS (SELECT path, node + CASE WHEN path % 13 = 0 THEN 1 ELSE 0 END AS node FROM path_nodes WHERE pos = 0),
  c AS (SELECT path, src AS node FROM path_edges UNION SELECT path, dst FROM path_edges)
SELECT path, string_agg(node::VARCHAR, ',' ORDER BY node) AS uncovered FROM (SELECT DISTINCT * FROM r ANTI JOIN c USING (path, node)) GROUP BY path""")


def wn13_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of orders as phenotypes in order."""
    names = F.array(*map(F.lit, ["ilxtr:Other", *pathtype.PHENOTYPES]))
    rows = frames.path_nodes(spark, sf_dir).select("path", "pos", F.element_at(names, (F.col("node") % 14 + 1).cast("int")).alias("phenotype"))
    return rollups.path_types(rows)


WN13 = with_frames("path_nodes", body=""", c AS (SELECT path, pos, [NULL, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 32, 64][node % 14 + 1] AS c FROM path_nodes)
SELECT path, (coalesce(arg_min(c, pos) FILTER (c <= 31), 1) | coalesce(arg_min(c, pos) FILTER (c > 31), 0))::INTEGER AS code FROM c GROUP BY path""")


def wn16_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each map's log what comes after its last marker."""
    kept = rollups.since_last_marker(frames.log_events(spark, sf_dir))
    return kept.groupBy("map_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


WN16 = with_frames("log_events", body=""", m AS (SELECT map_id, max(seq) AS last FROM log_events WHERE msg = 'Using knowledge source' GROUP BY map_id)
SELECT map_id, count(*) AS n, min(seq) AS first, max(seq) AS last FROM log_events LEFT JOIN m USING (map_id) WHERE m.last IS NULL OR seq > m.last GROUP BY map_id""")


def tk2_all_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (orders) of up to four phrases, each with the best scored parts of its lines."""
    n = frames.path_nodes(spark, sf_dir)
    s = n.select(F.col("path").alias("name"), (F.col("pos") % 4).alias("phrase"), (F.col("node") % 300).alias("term"), (F.col("node") % 97 / 97).alias("s")).groupBy("name", "phrase", "term").agg(F.round(F.max("s"), 4).alias("score"))
    return align.all_phrase_candidates(s, 3)


TK2A = with_frames("path_nodes", body=""", s AS (SELECT path AS name, pos % 4 AS phrase, node % 300 AS term, round(max(node % 97 / 97::DOUBLE), 4) AS score
  FROM path_nodes GROUP BY path, pos % 4, node % 300), l AS (SELECT name, max(phrase) AS last FROM s GROUP BY name),
a AS (SELECT name, [term] AS t, score AS z FROM s WHERE phrase = 0), b AS (SELECT a.name, CASE WHEN list_contains(t, term) THEN t ELSE t || [term] END AS t,
  z + score AS z FROM a JOIN s ON s.name = a.name AND phrase = 1),
c AS (SELECT b.name, CASE WHEN list_contains(t, term) THEN t ELSE t || [term] END AS t, z + score AS z FROM b JOIN s ON s.name = b.name AND phrase = 2),
  d AS (SELECT c.name, CASE WHEN list_contains(t, term) THEN t ELSE t || [term] END AS t, z + score AS z FROM c JOIN s ON s.name = c.name AND phrase = 3),
e AS (SELECT *, 0 AS p FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c UNION ALL SELECT *, 3 FROM d), m AS (SELECT name, array_to_string(t, '/') AS node,
  max(round(z / (p + 1), 6)) AS score FROM e JOIN l USING (name) WHERE p = last GROUP BY ALL)
SELECT name, node, score, (row_number() OVER (PARTITION BY name ORDER BY score DESC, node))::INTEGER AS rank FROM m QUALIFY rank <= 3""")


def tk2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of names made of part names."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 3 > 0, F.concat(F.lit(" IN  "), "p_type")).otherwise(""), F.when(k % 4 == 0, F.concat(F.lit(" of "), "p_brand")).otherwise(""), F.when(k % 5 == 0, " in ").otherwise(""))
    return align.phrases(p.select(name.alias("name")))


TK2S = r"""WITH n AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 3 > 0 THEN ' IN  ' || p_type ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN ' of ' || p_brand
  ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' in ' ELSE '' END AS name FROM part),
l AS (SELECT name, list_filter(list_transform(regexp_split_to_array(name, '(?i)\s+(?:in|of)\s+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM n) SELECT name,
  (i - 1)::INTEGER AS phrase, p[i] AS text FROM l, range(1, 9) r(i) WHERE i <= len(p)"""

_ALL = {
    src12_labels: SRC12, ag13_keys: AG13, ag24_terms: AG24, ag29_nodes: AG29, jn18_touching: JN18T, so2_rendered: SO2, so3_common: SO3, so4_uncovered: SO4, wn13_types: WN13, wn16_slices: WN16, tk2_all_phrases: TK2A, tk2_split: TK2S,
    src10_paths: SRC10P, src10_errors: SRC10E, src13_tree: SRC13T, src2_bases: SRC2, ag16_apart: AG16A, ag15_units: AG15U, jn43_network: JN43N, snk1_documents: SNK1D, snk2_documents: SNK2D, jn29_terms: JN29T, ag8_reports: AG8, snk6_document: SNK6, gr27_lists: GR27L, ag25_used: AG25, ag28_publications: AG28, tk4_issues: TK4,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items()}
