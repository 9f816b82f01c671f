"""Audits of map sources, alignments, and the systems above components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align, graph, quality, rollups
from . import frames
from .frames import table, with_frames


def qa_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that nothing defines, in drawings, aliases, proxies, features and networks (QA-1, 2, 6..15)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    ids = p.select(k.alias("id"))
    drawn, defined, known, aliased, used = ids.where("id % 3 <> 0"), ids.where("id % 4 <> 0"), ids.where("id % 5 <> 0"), ids.where("id % 7 = 0"), p.select("p_brand")
    mapped = p.where("p_size > 10").select("p_brand").distinct()
    q = quality.unknown
    return (
        q(drawn, "id", known, "drawn", "QA-1", "Term is not known")
        .unionByName(q(drawn, "id", defined, "drawn", "QA-2", "Not in properties"))
        .unionByName(q(aliased, "id", known, "alias", "QA-6", "Alias is not known"))
        .unionByName(q(aliased, "id", defined, "alias", "QA-7", "Canonical is not in properties"))
        .unionByName(q(defined, "id", drawn, "feature", "QA-14", "Not drawn"))
        .unionByName(q(used, "p_brand", mapped, "class", "QA-13", "Class is not mapped"))
    )


QA_REFERENCES = """WITH i AS (SELECT p_partkey AS id FROM part), u AS (
SELECT 'drawn' AS type, 'QA-1' AS code, id::VARCHAR AS location, 'Term is not known' AS issue FROM i WHERE id % 3 <> 0 AND id % 5 = 0
UNION ALL SELECT 'drawn', 'QA-2', id::VARCHAR, 'Not in properties' FROM i WHERE id % 3 <> 0 AND id % 4 = 0 UNION ALL SELECT 'alias', 'QA-6', id::VARCHAR,
  'Alias is not known' FROM i WHERE id % 7 = 0 AND id % 5 = 0
UNION ALL SELECT 'alias', 'QA-7', id::VARCHAR, 'Canonical is not in properties' FROM i WHERE id % 7 = 0 AND id % 4 = 0 UNION ALL SELECT 'feature', 'QA-14', id::VARCHAR,
  'Not drawn' FROM i WHERE id % 4 <> 0 AND id % 3 = 0
UNION ALL SELECT DISTINCT 'class', 'QA-13', p_brand, 'Class is not mapped' FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 10))
SELECT 0::BIGINT AS map_id, * FROM u"""


def qa18_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of lines that stand before the node they follow."""
    n = frames.path_nodes(spark, sf_dir)
    return quality.out_of_sequence(n.select(F.col("path").alias("line"), "pos", "node", (F.col("node") % 10).alias("along")))


QA18 = with_frames("path_nodes", body=""" SELECT 0::BIGINT AS map_id, 'centreline' AS type, 'QA-18' AS code, path || '/' || node AS location, 'Node is out of sequence' AS issue
FROM (SELECT *, lag(node % 10) OVER (PARTITION BY path ORDER BY pos) AS b FROM path_nodes) WHERE node % 10 < b""")


def gr15_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All systems (regions and the root) above each nation."""
    up = graph.closure(frames.subclass(spark, sf_dir).where("child not like 'C:%'"))
    return up.where("child like 'N:%'").groupBy("child").agg(F.array_join(F.array_sort(F.collect_set("ancestor")), ",").alias("systems"))


GR15 = "SELECT 'N:' || n_nationkey AS child, 'R:' || n_regionkey || ',ROOT' AS systems FROM nation"


def ag7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and visible features of each layer (AG-7, 24)."""
    f = frames.features(spark, sf_dir)
    return f.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("size") > 10).alias("visible"), F.countDistinct("class").alias("classes"))


AG7 = with_frames("features", body=" SELECT model, count(*) AS n, count(*) FILTER (WHERE size > 10) AS visible, count(DISTINCT class) AS classes FROM features GROUP BY model")


def ag4_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn connections by model: how many, and their nodes (AG-4, 29)."""
    e = frames.path_edges(spark, sf_dir).select((F.col("path") % 50).alias("model"), "path", F.explode(F.array("src", "dst")).alias("node"))
    return e.groupBy("model").agg(F.countDistinct("path").alias("paths"), F.countDistinct("node").alias("nodes"), F.min("node").alias("least"), F.bool_or(F.col("node") % 11 == 0).alias("free_end"))


AG4 = with_frames("path_edges", body=""", n AS (SELECT path % 50 AS model, path, src AS node FROM path_edges UNION ALL SELECT path % 50, path, dst FROM path_edges)
SELECT model, count(DISTINCT path) AS paths, count(DISTINCT node) AS nodes, min(node) AS least, bool_or(node % 11 = 0) AS free_end FROM n GROUP BY model""")


def so1_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed and drawn node lists of the paths merged (SO-1)."""
    routed = frames.path_nodes(spark, sf_dir).select("path", "node")
    drawn = routed.where("path % 4 = 0").select("path", (F.col("node") + 1_000_000).alias("node"))
    return rollups.inverted(routed.unionByName(drawn), "path", "node").withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


SO1 = with_frames("path_nodes", body=""", u AS (SELECT path, node FROM path_nodes UNION SELECT path, node + 1000000 FROM path_nodes WHERE path % 4 = 0)
SELECT path, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes FROM u GROUP BY path""")


def wn6_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest derivation of each customer (WN-6), of equals the largest."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("feature")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("feature", F.col("m.o_orderkey").alias("derived_from"))


WN6 = "SELECT o_custkey AS feature, o_orderkey AS derived_from FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def wn4_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of features by layer, in input order."""
    return rollups.dense_ids(frames.features(spark, sf_dir).select("id", "model"), ["model"], ["id"])


WN4 = with_frames("features", body=" SELECT id, model, (row_number() OVER (PARTITION BY model ORDER BY id))::INTEGER AS number FROM features")


def tk2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (orders) of one or two phrases, each with the best scored parts of its lines."""
    n = frames.path_nodes(spark, sf_dir)
    s = n.select(F.col("path").alias("name"), (F.col("pos") % 2).alias("phrase"), (F.col("node") % 300).alias("term"), (F.col("node") % 97 / 97).alias("s")).groupBy("name", "phrase", "term").agg(F.round(F.max("s"), 4).alias("score"))
    w = Window.partitionBy("name", "phrase").orderBy(F.desc("score"), "term")
    return align.phrase_candidates(s.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r"), 3)


TK2 = with_frames("path_nodes", body=""", g AS (SELECT path AS name, pos % 2 AS phrase, node % 300 AS term, round(max(node % 97 / 97::DOUBLE), 4) AS score FROM path_nodes
  GROUP BY path, pos % 2, node % 300),
s AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY name, phrase ORDER BY score DESC, term) <= 3),
c AS (SELECT name, term::VARCHAR AS node, score FROM s WHERE phrase = 0 AND name NOT IN (SELECT name FROM s WHERE phrase = 1)
UNION ALL SELECT a.name, CASE WHEN a.term = b.term THEN a.term::VARCHAR ELSE a.term || '/' || b.term END, round((a.score + b.score) / 2, 6) FROM s a
  JOIN s b ON a.name = b.name AND a.phrase = 0 AND b.phrase = 1),
m AS (SELECT name, node, max(score) AS score FROM c GROUP BY ALL)
SELECT name, node, score, (row_number() OVER (PARTITION BY name ORDER BY score DESC, node))::INTEGER AS rank FROM m QUALIFY rank <= 3""")


def tk3_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ancestor on the map for each customer that has a vector, by cosine to the vectors of nations and regions."""
    up = graph.two_levels(frames.subclass(spark, sf_dir)).where("child like 'C:%'")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    named = lambda prefix, base, most: v.where(f"vec_id between {base} and {base + most}").select(F.concat(F.lit(prefix), F.col("vec_id") - base).alias("ancestor"), F.col("embedding").alias("b"))
    above = named("N:", 0, 24).union(named("R:", 100, 4))
    pairs = up.join(v.select(F.concat(F.lit("C:"), "vec_id").alias("child"), F.col("embedding").alias("a")), "child").join(above, "ancestor")
    scores = pairs.select("child", "ancestor", F.round(rollups.cosine(F.col("a"), F.col("b")), 6).alias("score"))
    on_map = up.where("ancestor like 'R:%' or ancestor rlike '^N:[0-9]?[0-4]$'").select("ancestor")
    return align.ancestor_choice(up, on_map, scores, 0.05)


TK3 = """WITH n AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey),
a AS (SELECT k, 'N:' || n AS ancestor, 1 AS level, n AS v FROM n WHERE n % 10 < 5 UNION ALL SELECT k, 'R:' || r, 2, r + 100 FROM n),
s AS (SELECT k, ancestor, level, round(list_sum(list_transform(list_zip(x.embedding, y.embedding),
  lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(x.embedding, lambda p: p::DOUBLE ** 2)) * list_sum(list_transform(y.embedding, lambda p: p::DOUBLE ** 2))), 6) AS score
  FROM a JOIN embeddings x ON x.vec_id = k JOIN embeddings y ON y.vec_id = v)
SELECT 'C:' || k AS child, ancestor, level FROM s WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score + level, ancestor) = 1"""


_ALL = {qa_references: QA_REFERENCES, qa18_sequence: QA18, gr15_systems: GR15, ag7_counts: AG7, ag4_connections: AG4, so1_merged: SO1, wn6_latest: WN6, wn4_numbers: WN4, tk2_phrases: TK2, tk3_ancestors: TK3}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items() if sql}
