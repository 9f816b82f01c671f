"""Documents derived from the driver tables, written as files and scanned again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scans
from ..sources.scans import staged
from . import frames
from .frames import table, with_frames


def _text(c: str):
    return F.array_join(c, ",")


def src5_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of parts in a sheet; a sheet without its headers adds nothing."""
    k = F.col("p_partkey")
    dash = lambda c, n: F.when(k % n == 0, "-").otherwise(F.concat(F.lit(c), k))
    sheet = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), k).alias(scans.IDENTIFIER), dash("ILX:", 3).alias(scans.PREFERRED), dash("UBERON:", 5).alias(scans.UBERON))
    other = staged(sheet.toDF("a", "b", "c"), "csv", header="true")
    return scans.anatomical_map(spark, staged(sheet, "csv", header="true")).union(scans.anatomical_map(spark, other))


SRC5 = """SELECT 'P' || p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN 'ILX:' ELSE 'UBERON:' END || p_partkey AS term
FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 <> 0"""


def src6_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    section = F.element_at(F.array(*map(F.lit, ("FTUs", "Neural", "Organs", "Systems", "Vascular"))), (k % 5 + 1).cast("int"))
    parents = F.concat(F.lit("n"), k % 25, F.lit(" , "), F.lit("N"), k % 7, F.lit(",, a"), k % 3)
    return scans.annotations(spark, staged(s.select(section.alias("section"), F.col("s_name").alias("name"), F.concat(F.lit("T:"), k).alias("term"), parents.alias("parents")), "csv", header="true")).withColumn("parents", _text("parents"))


SRC6 = """WITH s AS (SELECT ['FTUs', 'Neural', 'Organs', 'Systems', 'Vascular'][s_suppkey % 5 + 1] AS section, s_name AS name, 'T:' || s_suppkey AS term,
    unnest(['n' || s_suppkey % 25, 'N' || s_suppkey % 7, 'a' || s_suppkey % 3]) AS p FROM supplier)
SELECT section, name, term, string_agg(p, ',' ORDER BY lower(p), p) AS parents FROM s GROUP BY ALL"""


def src8_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size < 5")
    docs = p.groupBy(F.col("p_brand").alias("feature")).agg(F.min("p_type").alias("name"), F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")).alias("proxies"))
    return scans.proxies(spark, staged(docs, "json"))


SRC8 = """SELECT p_brand AS feature, min(p_type) OVER (PARTITION BY p_brand) AS name,
(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS seq, p_partkey::VARCHAR AS proxy FROM part WHERE p_size < 5"""


def src9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.collect_list(F.col("p_partkey").cast("string")).alias("features"))
    docs = p.groupBy(F.col("p_type").alias("layer")).agg(F.collect_list(F.struct(F.col("p_brand").alias("id"), "features")).alias("groups"))
    return scans.feature_groups(spark, staged(docs, "json"))


SRC9 = "SELECT p_type AS layer, p_brand AS group_id, p_partkey::VARCHAR AS feature FROM part"


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model documents: a customer's orders as paths, their parts as nodes."""
    nodes = frames.path_nodes(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("node").cast("string").alias("node")))).alias("n"))
    o = table(spark, sf_dir, "orders").join(nodes, F.col("o_orderkey") == F.col("path"))
    path = F.struct(F.concat(F.lit("path-"), "path").alias("id"), F.col("o_orderpriority").alias("models"), F.col("n.node").alias("nodes"))
    return o.groupBy(F.concat(F.lit("model-"), F.col("o_custkey") % 97).alias("id")).agg(F.collect_list(path).alias("paths"))


def src10_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.connectivity(spark, staged(_models(spark, sf_dir), "json")).withColumn("nodes", _text("nodes"))


SRC10 = with_frames("path_nodes", body=""" SELECT 'model-' || o_custkey % 97 AS uri, 'path-' || path AS path, o_orderpriority AS models, string_agg(node::VARCHAR, ',' ORDER BY pos) AS nodes
FROM path_nodes JOIN orders ON o_orderkey = path GROUP BY ALL""")


def src11_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as maps: each names two models, some the whole knowledge, and that twice."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    whole = F.when(k % 6 == 0, "NPO").otherwise(F.concat(F.lit("model-"), k))
    uris = F.array(F.concat(F.lit("model-"), k * 3), whole, whole)
    paths = scans.connectivity(spark, staged(_models(spark, sf_dir), "json"))
    return scans.resolved(n.select(F.col("n_name").alias("map_id"), F.explode(uris).alias("uri")), paths)


SRC11 = """WITH p AS (SELECT DISTINCT 'model-' || o_custkey % 97 AS uri, 'path-' || o_orderkey AS path FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT DISTINCT n_name AS map_id, path FROM nation JOIN p ON uri = 'model-' || n_nationkey * 3 OR n_nationkey % 6 = 0 OR uri = 'model-' || n_nationkey"""


def src15_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' boxes as contour elements; one in three is open."""
    c = frames.containers(spark, sf_dir)
    point = lambda x, y: F.concat(F.lit('<point x="'), x, F.lit('" y="'), y, F.lit('"/>'))
    points = F.concat(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"))
    name = F.concat(F.lit('<contour name="C'), "id", F.lit('" closed="'), (F.col("id") % 3 != 0).cast("string"), F.lit('"><property name="'))
    kind = F.when(F.col("id") % 4 == 0, "Other").otherwise("TraceAssociation")
    xml = F.concat(name, kind, F.lit('"><s>T:'), "id", F.lit("</s></property>"), points, F.lit("</contour>"))
    rings = scans.contours(c.select("id", xml.alias("xml")), 0.5)
    at = F.transform("ring", lambda p: F.concat_ws(" ", (p["x"] * 2).cast("long"), (p["y"] * 2).cast("long")))
    return rings.withColumn("ring", F.array_join(at, ","))


SRC15 = with_frames("containers", body=""" SELECT id, 'C' || id AS name, CASE WHEN id % 4 <> 0 THEN 'T:' || id END AS term,
x0 || ' ' || -y0 || ',' || x1 || ' ' || -y0 || ',' || x1 || ' ' || -y1 || CASE WHEN id % 3 <> 0 THEN ',' || x0 || ' ' || -y0 ELSE '' END AS ring FROM containers""")


def src17_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.log_events(spark, sf_dir)
    line = F.concat(F.lit("2024 "), F.upper("level"), F.lit(": "), "msg", F.when(F.col("type") == "error", F.concat(F.lit(" N"), "node")).when(F.col("type") == "purchase", F.concat(F.lit(": P"), "path")).otherwise(""))
    phrases = {"missing": r"Cannot find feature for node (N\d+)", "suppressed": r"Path suppressed .*: (P\d+)"}
    return scans.log_text(spark, staged(e.select(line.alias("value")), "text"), phrases).groupBy("kind", "found").agg(F.count("*").alias("n"))


SRC17 = with_frames("log_events", body=""" SELECT CASE type WHEN 'error' THEN 'missing' ELSE 'suppressed' END AS kind, CASE type WHEN 'error' THEN 'N' || node
  ELSE 'P' || path END AS found, count(*) AS n
FROM log_events WHERE type IN ('error', 'purchase') GROUP BY ALL""")


def src18_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents of nations in folders by id, by uuid, or by neither."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    docs = n.select(F.concat(F.lit("map"), k).alias("id"), F.md5("n_name").alias("uuid"), (1 + (k % 6) / 10).alias("version"))
    number = F.substring("id", 4, 9).cast("int")
    docs = docs.withColumn("dir", F.when(number % 3 == 0, F.col("id")).when(number % 3 == 1, F.col("uuid")).otherwise("lost"))
    return scans.map_index(spark, staged(docs, "json", partitionBy="dir"))


SRC18 = "SELECT 'map' || n_nationkey AS id, md5(n_name) AS uuid, 1 + (n_nationkey % 6) / 10 AS version FROM nation WHERE n_nationkey % 6 >= 3 AND n_nationkey % 3 <> 2"


def src19_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of nations and suppliers; regions have no namespace."""
    names = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "N").otherwise("S").alias("prefix"))
    return scans.expanded(frames.triples(spark, sf_dir), names.select("prefix", F.concat(F.lit("http://example.org/"), F.lower("prefix"), F.lit("/")).alias("uri")))


SRC19 = with_frames("triples", body=r""" SELECT CASE WHEN regexp_matches(s, '^[NS]:') THEN 'http://example.org/' || lower(s[1]) || '/' || s[3:] ELSE s END AS s, p,
CASE WHEN regexp_matches(o, '^[NS]:') THEN 'http://example.org/' || lower(o[1]) || '/' || o[3:] ELSE o END AS o FROM triples""")


def src20_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    some = lambda n, c: F.when(k % n == 0, F.concat(F.lit(c), k)).otherwise(" ")
    sheet = table(spark, sf_dir, "part").select(F.lit("x"), F.concat(F.lit("T:"), k), F.col("p_name"), F.lit(""), some(2, "A:"), F.lit("y"), F.lit("z"), some(3, "B:"))
    return scans.equivalents(spark, staged(sheet.toDF(*[f"c{i}" for i in range(8)]), "csv")).withColumn("aliases", _text("aliases"))


SRC20 = """SELECT 'T:' || p_partkey AS id, p_name AS label, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'A:' || p_partkey END, CASE WHEN p_partkey % 3 = 0 THEN 'B:' || p_partkey END) AS aliases
FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"""

_ALL = {
    src5_anatomy: SRC5, src6_annotations: SRC6, src8_proxies: SRC8, src9_groups: SRC9, src10_connectivity: SRC10, src11_resolved: SRC11, src15_contours: SRC15,
    src17_log_text: SRC17, src18_index: SRC18, src19_triples: SRC19, src20_equivalents: SRC20,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items()}
