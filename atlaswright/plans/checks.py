"""Whole checks of networks, drawings, proxies and layers over frames of the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from . import frames
from .frames import table, with_frames


def _sql(parts: list[tuple[str, str, str, str]], code: str, map_id: str = "0") -> str:
    """``SELECT`` of issues from ``(type, location, issue, from)``."""
    return "\nUNION ALL ".join(f"SELECT ({map_id})::BIGINT AS map_id, '{t}' AS type, '{code}' AS code, ({where})::VARCHAR AS location, {what} AS issue FROM {source}" for t, where, what, source in parts)


def _pick(values: tuple, k) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def qa17_centrelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as centrelines along their parts; every 50th has no id, every 40th the id of the order before; suppliers contain them."""
    k = F.col("path")
    nodes = frames.path_nodes(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("n"))
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_set(F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey"))).alias("containers"))
    lines = nodes.join(held, "path").select(
        k.alias("seq"), F.when(k % 50 > 0, F.when(k % 40 == 1, k - 1).otherwise(k)).alias("id"), F.when(k % 3 > 0, F.concat(F.lit("M"), k % 7)).alias("models"), F.col("n.node").alias("nodes"), "containers",
    )
    part = F.col("p_partkey")
    terms = table(spark, sf_dir, "part").where("p_partkey % 4 > 0").select(part.alias("feature"), F.concat(F.lit("M"), part % 6).alias("models"))
    nerves = table(spark, sf_dir, "part").where("p_partkey % 8 = 1").select(part.alias("feature"), F.concat(F.lit("M"), part % 5).alias("models"))
    return checks.centreline_checks(lines, terms, nerves)


QA17 = with_frames("path_nodes", body=""", c AS (SELECT path AS seq, CASE WHEN path % 50 > 0 THEN CASE WHEN path % 40 = 1 THEN path - 1 ELSE path END END AS id, CASE
  WHEN path % 3 > 0 THEN 'M' || path % 7 END AS models,
  (SELECT list(node ORDER BY pos) FROM path_nodes n WHERE n.path = o.path) AS nodes FROM (SELECT DISTINCT path FROM path_nodes) o),
f AS (SELECT * FROM c WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
i AS (SELECT DISTINCT id, models, l_suppkey AS x FROM f JOIN lineitem ON l_orderkey = seq WHERE l_suppkey % 3 > 0),
t AS (SELECT p_partkey AS x, 'M' || p_partkey % 6 AS m FROM part WHERE p_partkey % 4 > 0), v AS (SELECT p_partkey AS x, 'M' || p_partkey % 5 AS m FROM part WHERE p_partkey % 8 = 1),
e AS (SELECT DISTINCT id, x FROM (SELECT id, unnest([nodes[1], nodes[-1]]) AS x FROM f WHERE len(nodes) >= 2)), w AS (SELECT DISTINCT id, x FROM (SELECT id,
  unnest(nodes[2:-2]) AS x FROM f WHERE len(nodes) >= 2))
""") + _sql([
    ("centreline", "seq", "'Centreline has no id'", "c WHERE id IS NULL"),
    ("centreline", "id || '/' || seq", "'Centreline has a duplicate id'", "c WHERE id IS NOT NULL AND seq NOT IN (SELECT seq FROM f)"),
    ("centreline", "id", "'Centreline has too few nodes'", "f WHERE len(nodes) < 2"),
    ("centreline", "id", "'Centreline models two entities: ' || models || ', ' || m", "f JOIN t ON x = id WHERE models <> m"),
    ("centreline", "id || '/' || x", "'Container has no anatomical term'", "i WHERE x NOT IN (SELECT x FROM t)"),
    ("centreline", "id || '/' || x", "'Container models a different nerve'", "i JOIN v USING (x) WHERE m <> models AND x IN (SELECT x FROM t)"),
    ("centreline", "id || '/' || x", "'Container is also an end node'", "i WHERE x IN (SELECT x FROM t) AND x NOT IN (SELECT x FROM v) AND x IN (SELECT x FROM e)"),
    ("centreline", "x", "'Node is inside several centrelines: ' || ids", "(SELECT x, string_agg(DISTINCT id::VARCHAR, ', ' ORDER BY id::VARCHAR) AS ids FROM w GROUP BY x HAVING count(DISTINCT id) > 1)"),
    ("centreline", "x", "'Inner node branches to several centrelines: ' || ids", "(SELECT x, string_agg(DISTINCT id::VARCHAR, ', ' ORDER BY id::VARCHAR) AS ids FROM e WHERE x IN (SELECT x FROM w) GROUP BY x HAVING count(DISTINCT id) > 1)"),
], "QA-17")


def qa19_nerves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' items as property rows, a third of them of nerves."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_suppkey").alias("s"))
    rows = line.select((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("seq"), F.concat(F.lit("f"), F.col("l_partkey") % 90).alias("feature"), _pick(("nerve", "organ", "unit"), F.col("l_orderkey")).alias("type"), F.when(F.col("s") % 5 > 0, F.concat(F.lit("M"), F.col("s"))).alias("models"))
    return checks.nerve_checks(rows)


QA19 = """WITH p AS (SELECT l_orderkey * 1000000 + l_partkey AS seq, 'f' || l_partkey % 90 AS feature, CASE
  WHEN min(l_suppkey) % 5 > 0 THEN 'M' || min(l_suppkey) END AS models FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey, l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY models ORDER BY seq) AS a, row_number() OVER (PARTITION BY feature ORDER BY seq) AS b FROM p WHERE models IS NOT NULL)
""" + _sql([
    ("nerve", "models || '/' || feature", "'Nerve has already been assigned to a feature'", "r WHERE a > 1"),
    ("nerve", "feature || '/' || models", "'Feature has already been assigned a model'", "r WHERE b > 1"),
], "QA-19")


def qa22_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as shapes inside others by the orders they share, orders as connections between parts."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    classes = ("organ", "unit", "neural", "region", "vascular", "neural", "system")
    shapes = part.select(k.alias("id"), F.when(k % 5 > 0, F.col("p_name")).otherwise("").alias("name"), _pick(classes, k).alias("class"), F.concat(F.lit("k"), k % 3).alias("kind"))
    edges = frames.path_edges(spark, sf_dir)
    parents = edges.where("path % 2 = 0 and src % 4 > 0").select(F.col("src").alias("id"), F.col("dst").alias("parent")).distinct()
    ends = edges.where("path % 3 = 0").groupBy("path").agg(F.min("src").alias("source"), F.max("dst").alias("target"))
    lines = ends.select(F.col("path").alias("id"), "source", "target", F.when(F.col("path") % 4 > 0, F.concat(F.lit("k"), F.col("path") % 3)).alias("colour_kind"))
    return checks.functional_checks(shapes, parents, lines)


QA22 = with_frames("path_edges", body=""", s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE '' END AS name, ['organ', 'unit', 'neural',
  'region', 'vascular', 'neural', 'system'][p_partkey % 7 + 1] AS class, 'k' || p_partkey % 3 AS kind FROM part),
u AS (SELECT DISTINCT src AS id, dst AS parent FROM path_edges WHERE path % 2 = 0 AND src % 4 > 0), n AS (SELECT u.id, s.class AS above FROM u LEFT JOIN s ON s.id = u.parent),
l AS (SELECT path AS id, min(src) AS source, max(dst) AS target, CASE WHEN path % 4 > 0 THEN 'k' || path % 3 END AS ck FROM path_edges WHERE path % 3 = 0 GROUP BY path),
c AS (SELECT * FROM s WHERE class IN ('neural', 'vascular')), x AS (SELECT l.*, a.class AS ac, a.kind AS ak, b.class AS bc FROM l LEFT JOIN c a ON a.id = l.source LEFT JOIN c b ON b.id = l.target)
""") + _sql([
    ("organ", "id", "'An organ must have a name'", "s WHERE class = 'organ' AND name = ''"),
    ("organ", "id", "'An organ must be in at least one system'", "s WHERE class = 'organ' AND id NOT IN (SELECT id FROM n WHERE above = 'system')"),
    ("unit", "id", "'Units and regions can only be in a single organ'", "s WHERE class IN ('unit', 'region') AND (SELECT count(*) FROM n WHERE n.id = s.id AND above = 'organ') > 1"),
    ("connector", "id", "'Connector has no parent'", "c WHERE id NOT IN (SELECT id FROM u)"),
    ("connector", "id", "'Connector is not in a unit'", "c WHERE class = 'neural' AND id IN (SELECT id FROM u) AND id NOT IN (SELECT id FROM n WHERE above = 'unit')"),
    ("connection", "id", "'Connection has unconnected ends'", "x WHERE ac IS NULL OR bc IS NULL"),
    ("connection", "id", "'Connection ends are not compatible: ' || ac || ', ' || bc", "x WHERE ac <> bc"),
    ("connection", "id", "'Connection''s colour is of no known kind'", "x WHERE ck IS NULL"),
    ("connection", "id", "'Connection''s kind is not its connector''s: ' || ck || ', ' || ak", "x WHERE ck <> ak"),
], "QA-22")


def qa24_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand in for terms on the features that model others."""
    line = table(spark, sf_dir, "lineitem")
    proxies = line.select((F.col("l_suppkey") * 3).alias("models"), (F.col("l_partkey") * 2).alias("host")).distinct()
    k = F.col("p_partkey")
    features = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 4 > 0, k).alias("models"), _pick(("Polygon", "Polygon", "LineString"), k).alias("geometry"))
    return checks.proxy_checks(proxies, features)


QA24 = """WITH p AS (SELECT DISTINCT l_suppkey * 3 AS m, l_partkey * 2 AS h FROM lineitem), f AS (SELECT p_partkey AS id, ['Polygon', 'Polygon',
  'LineString'][p_partkey % 3 + 1] AS g FROM part WHERE p_partkey % 4 > 0), r AS (SELECT * FROM p WHERE m NOT IN (SELECT id FROM f))
""" + _sql([
    ("proxy", "m", "'Proxied feature is already on the map'", "(SELECT DISTINCT m FROM p WHERE m IN (SELECT id FROM f))"),
    ("proxy", "m || '/' || h", "'Proxy is missing from the map'", "r WHERE h NOT IN (SELECT id FROM f)"),
    ("proxy", "m || '/' || h", "'Proxy feature must have a polygon shape'", "r JOIN f ON f.id = h WHERE g <> 'Polygon'"),
], "QA-24")


def qa26_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as maps, their items as layers."""
    n = frames.path_nodes(spark, sf_dir)
    k = F.col("node")
    kinds = ("base", "details", "functional", "image", "layer", "anatomical")
    layers = n.select(F.col("path").alias("map_id"), F.col("pos").alias("seq"), F.concat(F.lit("L"), k % 9).alias("id"), _pick(kinds, k).alias("kind"), F.when(k % 5 > 0, k % 40).alias("feature"), F.when(k % 11 > 0, k % 4).alias("zoom"))
    return checks.layer_checks(layers, n.select(F.col("path").alias("map_id"), (k % 20).alias("id")))


QA26 = with_frames("path_nodes", body=""", l AS (SELECT path AS m, pos, 'L' || node % 9 AS id, ['base', 'details', 'functional', 'image', 'layer',
  'anatomical'][node % 6 + 1] AS kind, CASE WHEN node % 5 > 0 THEN node % 40 END AS f, CASE WHEN node % 11 > 0 THEN node % 4 END AS z FROM path_nodes),
d AS (SELECT * FROM l WHERE kind IN ('details', 'functional', 'anatomical')), f AS (SELECT DISTINCT path AS m, node % 20 AS f FROM path_nodes)
""") + _sql([
    ("layer", "id", "'Duplicate layer id'", "(SELECT m, id, row_number() OVER (PARTITION BY m, id ORDER BY pos) AS r FROM l) WHERE r > 1"),
    ("layer", "id", "'Details layer cannot be the base map'", "l WHERE pos = 0 AND kind = 'details'"),
    ("layer", "id", "'Can only have a single base map'", "l WHERE pos > 0 AND kind = 'base'"),
    ("layer", "id", "'Details need a feature'", "d WHERE f IS NULL"),
    ("layer", "id", "'Unknown source feature: ' || f", "d ANTI JOIN f USING (m, f) WHERE f IS NOT NULL"),
    ("layer", "id", "'Details need a zoom'", "d WHERE coalesce(z, 0) < 1"),
], "QA-26", "m")

_ALL = {qa17_centrelines: QA17, qa19_nerves: QA19, qa22_drawing: QA22, qa24_proxies: QA24, qa26_layers: QA26}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items()}
