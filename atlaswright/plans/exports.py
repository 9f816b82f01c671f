"""Documents and reports of maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exports, graph
from ..sources.scans import staged
from . import frames
from .frames import table, with_frames


def sc30_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of orders as paths; some have no known kind."""
    k = F.col("o_orderkey")
    kinds = ("cns", "sensory", "symp-pre", "para-post", "somatic", "unheard")
    return table(spark, sf_dir, "orders").select(k.alias("path"), exports.path_colour(F.element_at(F.array(*map(F.lit, kinds)), (k % 6 + 1).cast("int"))).alias("colour"))


SC30 = "SELECT o_orderkey AS path, ['#9B1FC1', '#2A62F6', '#EA3423', '#3F8F4A', '#98561D', '#888'][o_orderkey % 6 + 1] AS colour FROM orders"


def sc32_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(k.alias("id"), F.array(k % 7, k % 3).alias("hyperlinks"), F.struct((k % 5).alias("a"), F.col("p_brand").alias("b")).alias("scaffold"), "p_name")
    return exports.json_encoded(rows, ["hyperlinks", "scaffold"])


SC32 = """SELECT p_partkey AS id, '[' || p_partkey % 7 || ',' || p_partkey % 3 || ']' AS hyperlinks, '{"a":' || p_partkey % 5 || ',"b":"' || p_brand || '"}' AS scaffold, p_name FROM part"""


def snk2_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points, lines and boxes."""
    f = frames.features(spark, sf_dir)
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    points = F.when(F.col("id") % 3 == 0, F.array(p("x0", "y0"))).when(F.col("id") % 3 == 1, F.array(p("x0", "y1"), p("x1", "y0"))).otherwise(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")))
    return exports.annotation_rows(f.select("id", points.alias("points"), F.col("name").alias("label"), F.col("model").alias("models"), F.col("class").alias("hidden")))


SNK2 = with_frames("features", body=""", f AS (SELECT *, CASE WHEN id % 3 = 0 THEN x0 ELSE x1 END AS u, CASE WHEN id % 3 = 0 THEN y0 ELSE y1 END AS v FROM features)
SELECT id, name AS label, model AS models, '[' || x0 || ',' || y0 || ',' || u || ',' || v || ']' AS bounds,
'[' || ((x0 + u) / 2)::DOUBLE || ',' || ((y0 + v) / 2)::DOUBLE || ']' AS marker, ['Point', 'LineString', 'Polygon'][id % 3 + 1] AS geometry,
CASE WHEN id % 3 = 1 THEN '[' || x0 || ',' || y1 || ']' END AS path_start, CASE WHEN id % 3 = 1 THEN '[' || x1 || ',' || y0 || ']' END AS path_end FROM f""")


def snk4_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    layer = F.concat(F.lit("L"), "s_nationkey")
    images = s.select(layer.alias("layer"), (F.col("s_suppkey") * 7 % 1000).alias("ordinal"), F.concat(F.lit("img"), "s_suppkey").alias("id"))
    details = s.where("s_suppkey % 3 = 0").select(layer.alias("layer"), F.concat(F.lit("detail"), F.col("s_suppkey") % 4).alias("extra"))
    return exports.layer_documents(n.select(F.concat(F.lit("L"), "n_nationkey").alias("layer"), F.col("n_name").alias("description")), images, details)


SNK4 = """WITH i AS (SELECT s_nationkey AS k, string_agg('"img' || s_suppkey || '"', ',' ORDER BY s_suppkey * 7 % 1000, 'img' || s_suppkey) AS images FROM supplier GROUP BY 1),
d AS (SELECT k, string_agg('"' || e || '"', ',' ORDER BY e) AS extras FROM (SELECT DISTINCT s_nationkey AS k, 'detail' || s_suppkey % 4 AS e FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY k)
SELECT 'L' || n_nationkey AS layer, '{"id":"L' || n_nationkey || '","description":"' || n_name || '"' || coalesce(',"image-layers":[' || images || ']', '') || coalesce(',"extras":[' || extras || ']', '') || '}' AS document
FROM nation LEFT JOIN i ON i.k = n_nationkey LEFT JOIN d ON d.k = n_nationkey"""


def snk5_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    layers = s.select(F.col("s_nationkey").alias("map_id"), F.concat(F.lit("layer"), F.col("s_suppkey") % 3).alias("layer"))
    return exports.map_documents(n.select(F.col("n_nationkey").alias("map_id"), F.col("n_name").alias("name"), F.concat(F.lit("NCBITaxon:"), "n_regionkey").alias("taxon")), layers, c.select(F.col("c_nationkey").alias("map_id")))


SNK5 = """WITH l AS (SELECT k, string_agg('"' || e || '"', ',' ORDER BY e) AS layers FROM (SELECT DISTINCT s_nationkey AS k, 'layer' || s_suppkey % 3 AS e FROM supplier)
  GROUP BY k), f AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT n_nationkey AS map_id, '{"id":' || n_nationkey || ',"name":"' || n_name || '","taxon":"NCBITaxon:' || n_regionkey || '","layers":[' || coalesce(layers, '') || '],"features":' || coalesce(n, 0) || '}' AS document
FROM nation LEFT JOIN l ON l.k = n_nationkey LEFT JOIN f ON f.k = n_nationkey"""


def snk7_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in their nations in their regions."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = c.select(F.concat(F.lit("C:"), "c_custkey").alias("term"), F.array(F.concat(F.lit("N:"), "n_nationkey"), F.concat(F.lit("R:"), "n_regionkey")).alias("layers"))
    return exports.hierarchy_documents(*graph.hierarchy(nodes))


SNK7 = """WITH n AS (SELECT 'R:' || n_regionkey AS r, 'R:' || n_regionkey || '/N:' || n_nationkey AS n, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT n || '/C:' || c_custkey AS node, n AS parent FROM n UNION SELECT n, r FROM n)
SELECT 'nodes' AS part, '{"id":"' || node || '"}' AS document FROM (SELECT node FROM l UNION SELECT r FROM n)
UNION ALL SELECT 'links', '{"source":"' || node || '","target":"' || parent || '"}' FROM l"""


def snk8_neurons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as neurons, their shipments as derivations."""
    line = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    neurons = line.groupBy(k.alias("neuron")).agg(F.collect_set(F.col("l_partkey") % 3).alias("ends"))
    derivations = line.where("l_partkey % 4 = 0").select(k.alias("neuron"), F.col("l_shipdate").alias("at"), F.col("l_suppkey").alias("evidence"))
    return exports.evidenced(neurons, derivations).select("neuron", F.size("ends").alias("n_ends"), F.col("evidence").cast("string").alias("evidence"))


SNK8 = """WITH n AS (SELECT l_orderkey AS neuron, count(DISTINCT l_partkey % 3)::INTEGER AS n_ends FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey % 3) > 1),
d AS (SELECT l_orderkey AS neuron, arg_max(l_suppkey, (l_shipdate, l_suppkey)) AS e FROM lineitem WHERE l_partkey % 4 = 0 GROUP BY 1) SELECT neuron, n_ends,
  e::VARCHAR AS evidence FROM n LEFT JOIN d USING (neuron)"""


def snk9_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders blocked by missing parts, written as CSV and read again."""
    n = frames.path_nodes(spark, sf_dir).join(frames.missing_nodes(spark, sf_dir), "node")
    rows = exports.missing_reports(n.select("node", "path", (F.col("path") % 10).alias("map_id")))
    return spark.read.schema("report string, key string, value string").csv(staged(rows, "csv", header="true"), header=True)


SNK9 = with_frames("path_nodes", body=""", b AS (SELECT DISTINCT node, path, path % 10 AS m FROM path_nodes WHERE node % 11 = 0), m AS (SELECT DISTINCT node, m FROM b),
n AS (SELECT node, count(DISTINCT path) AS n FROM b GROUP BY node)
SELECT 'paths_minimal' AS report, path::VARCHAR AS key, string_agg(node::VARCHAR, ',' ORDER BY node::VARCHAR) AS value FROM (SELECT DISTINCT path, node FROM b) GROUP BY path
UNION ALL SELECT 'node_minimal', node::VARCHAR, n::VARCHAR FROM n
UNION ALL SELECT 'node_complete', node::VARCHAR, any_value(n) || ';' || string_agg(m::VARCHAR, ',' ORDER BY m::VARCHAR) FROM m JOIN n USING (node) GROUP BY node""")


def snk12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions written as a JSON file each: their kinds and number."""
    path = staged(table(spark, sf_dir, "region").repartition("r_regionkey").select("r_name", F.col("r_regionkey").alias("k")), "json", partitionBy="k")
    return exports.file_manifest(spark, path).groupBy("suffix", "mime").agg(F.count("*").alias("files"))


SNK12 = "SELECT 'json' AS suffix, 'application/json' AS mime, count(*) AS files FROM region"


def snk14_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    row = [F.concat(F.lit("S"), k % 5).alias("section"), F.concat(F.when(k % 2 == 0, "n").otherwise("N"), k % 40).alias("name"), F.concat(F.lit("p"), k % 3).alias("parent")]
    sheet = s.where("s_suppkey % 3 <> 0").select(*row, F.concat(F.lit("T:"), k).alias("term")).groupBy("section", "name", "parent").agg(F.min("term").alias("term"))
    return exports.written_back(sheet, s.where("s_suppkey % 4 <> 1").select(*row))


SNK14 = """WITH r AS (SELECT s_suppkey AS k, 'S' || s_suppkey % 5 AS section, CASE WHEN s_suppkey % 2 = 0 THEN 'n' ELSE 'N' END || s_suppkey % 40 AS name,
  'p' || s_suppkey % 3 AS parent FROM supplier),
a AS (SELECT section, name, parent, coalesce(min('T:' || k) FILTER (WHERE k % 3 <> 0), '') AS term FROM r WHERE k % 3 <> 0 OR k % 4 <> 1 GROUP BY ALL)
SELECT section, (row_number() OVER (PARTITION BY section ORDER BY lower(name), lower(parent), name, parent) - 1)::INTEGER AS "row", name, parent, term FROM a"""


def snk16_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    shapes = s.where("s_suppkey % 5 <> 0").select(k.alias("id"), F.concat(F.lit("#"), k % 4).alias("colour"), F.concat(F.element_at(F.array(*map(F.lit, "uvq")), (k % 3 + 1).cast("int")), k).alias("symbol"))
    kinds = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.concat(F.lit("#"), "r_regionkey").alias("colour"), F.concat(F.lit("kind"), "r_regionkey").alias("kind"))
    return exports.bond_triples(shapes, s.select(k.alias("line"), (k + 1).alias("source"), (k + 2).alias("target")), kinds)


SNK16 = """WITH n AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT 'N' || k AS s, 'type' AS p, CASE WHEN k % 4 < 2 THEN 'kind' || k % 4 ELSE ['potential', 'flow', 'node'][k % 3 + 1] END AS o FROM n
UNION ALL SELECT 'L' || s_suppkey, 'hasSource', coalesce('N' || k, 'MISSING') FROM supplier LEFT JOIN n ON k = s_suppkey + 1
UNION ALL SELECT 'L' || s_suppkey, 'hasTarget', coalesce('N' || k, 'MISSING') FROM supplier LEFT JOIN n ON k = s_suppkey + 2"""


def tl8_zooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the layers of their brands, some of which begin at a zoom."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    features = part.select(k.alias("id"), F.col("p_brand").alias("layer"), F.when(k % 5 > 0, 1000.0 / (1 + k % 300)).otherwise(0.0).alias("area"), F.when(k % 7 == 0, "g").alias("group"), F.when(k % 9 == 0, k % 14).alias("minzoom"), F.when(k % 8 == 0, F.lit(9)).alias("maxzoom"))
    n = F.length("layer") + F.ascii(F.substring("layer", -1, 1))
    layers = part.select(F.col("p_brand").alias("layer")).distinct().select("layer", F.when(n % 3 > 0, n % 5).alias("minzoom"), (n % 2 == 0).alias("detail"), (n % 4 == 1).alias("based"))
    rows = exports.zoom_hints(features, layers, 1e6)
    return rows.select("id", "scale", *[F.col(c).cast("string").alias(c) for c in ("minzoom", "maxzoom", "image_minzoom")])


TL8 = """WITH b AS (SELECT DISTINCT p_brand AS brand, length(p_brand) + ascii(right(p_brand, 1)) AS n FROM part),
p AS (SELECT p_partkey AS k, n, CASE WHEN n % 3 > 0 THEN n % 5 END AS first, CASE
  WHEN p_partkey % 5 > 0 THEN log2(sqrt(1e6::DOUBLE / (1000.0::DOUBLE / (1 + p_partkey % 300)))) END AS s FROM part JOIN b ON brand = p_brand)
SELECT k AS id, round(coalesce(s, 10), 9) AS scale, (CASE WHEN k % 9 = 0 THEN k % 14 WHEN first IS NOT NULL THEN greatest(first - 1, 0) WHEN s > 6 AND k % 7 <> 0 THEN 4 END)::VARCHAR AS minzoom,
CASE WHEN k % 8 = 0 THEN '9' END AS maxzoom, (first + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END - CASE WHEN n % 4 = 1 THEN 2 ELSE 0 END)::VARCHAR AS image_minzoom FROM p"""


def tk7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.by_status(frames.log_events(spark, sf_dir).select(F.col("type").alias("status"), "seq"), ["error", "purchase", "view"])


TK7 = with_frames("log_events", body=" SELECT CASE type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS section, type AS status, count(*) AS n, min(seq) AS first, max(seq) AS last FROM log_events GROUP BY ALL")


def so5_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return exports.used(drawn, table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("id")))


SO5 = "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20)"


def so6_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.triples(spark, sf_dir)
    return exports.merged_triples(t, t.where("p = 'label'"), t.select("s", F.lit("about").alias("p"), F.col("p").alias("o")))


SO6 = with_frames("triples", body=" SELECT s, p, o FROM triples UNION SELECT s, 'about', p FROM triples")

_ALL = {
    sc30_colours: SC30, sc32_encoded: SC32, snk2_annotations: SNK2, snk4_layers: SNK4, snk5_maps: SNK5, snk7_hierarchy: SNK7, snk8_neurons: SNK8, snk9_reports: SNK9, snk12_manifest: SNK12, snk14_sheet: SNK14,
    snk16_bonds: SNK16, tl8_zooms: TL8, tk7_report: TK7, so5_used: SO5, so6_merged: SO6,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items()}
