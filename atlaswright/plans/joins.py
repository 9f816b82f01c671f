"""Enrichment, term resolution, spatial joins, windows, rankings, quality rules and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import enrich, quality, rollups, spatial, terms, tiling
from ..sources import sinks
from . import frames
from .frames import table, with_frames


def _text(column: str | Column) -> Column:
    return F.array_join((F.col(column) if isinstance(column, str) else column).cast("array<string>"), ",")


def jn1_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and colours by class and id, the id's winning; two classes each."""
    f = frames.features(spark, sf_dir).select("id", F.array(F.concat(F.lit("Brand#"), (F.col("id") % 5).cast("string")), "class").alias("classes"))
    return enrich.cascade(f, frames.rules(spark, sf_dir))


JN1 = with_frames("features", "rules", body=""", c AS (SELECT id, 'Brand#' || (id % 5) AS key, 1 AS p FROM features UNION ALL SELECT id, class, 3 FROM features UNION ALL
  SELECT id, id::VARCHAR, 9 FROM features)
SELECT id, prop, arg_max(value, p) AS value FROM c JOIN rules r ON r.key = c.key AND (r.scope = 'id') = (p = 9) GROUP BY id, prop""")


def jn3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of parts by the knowledge of their type; sizes under 3 have no model."""
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") >= 3, F.col("p_type")).alias("models"), F.col("p_name").alias("name"))
    k = p.where("p_partkey % 2 = 0").groupBy(F.col("p_type").alias("entity")).agg(F.min("p_name").alias("label"), F.array_sort(F.collect_set("p_brand")).alias("taxons"))
    return enrich.labelled(f, k).withColumn("taxons", _text("taxons"))


JN3 = """WITH k AS (SELECT p_type AS models, min(p_name) AS label, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS taxons FROM part WHERE p_partkey % 2 = 0 GROUP BY p_type),
f AS (SELECT p_partkey AS id, CASE WHEN p_size >= 3 THEN p_type END AS models, p_name AS name FROM part)
SELECT id, f.models, CASE WHEN f.models IS NULL THEN name ELSE coalesce(label, f.models) END AS label, coalesce(taxons, '') AS taxons FROM f LEFT JOIN k ON k.models = f.models"""


def jn6_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path nodes by canonical names."""
    first, _ = terms.alias_table(frames.aliases(spark, sf_dir))
    return terms.resolved(frames.path_nodes(spark, sf_dir), first).select("path", "pos", "canonical")


JN6 = with_frames("path_nodes", body=" SELECT path, pos, node - node % 5 AS canonical FROM path_nodes")


def src7_alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.alias_table(frames.aliases(spark, sf_dir))[1]


SRC7 = with_frames("aliases", body=" SELECT alias, canonical, (SELECT arg_min(canonical, ord) FROM aliases b WHERE b.alias = a.alias) AS kept FROM aliases a WHERE ord = 1")


def jn7_node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (part, its two layers) to features, by layers that have some and by place."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    nodes = p.select(k.alias("node"), (k % 97).alias("term"), F.array(k % 53 + 100, k % 29 + 200).alias("layers"))
    f = table(spark, sf_dir, "part").select(F.explode(F.array(k % 89, k % 31 + 100, k % 23 + 200)).alias("model"), k.alias("feature"))
    nerves = spark.range(205, 210).select(F.col("id").alias("model"))
    inside = f.select("feature", F.col("model").alias("layer")).where("(feature + layer) % 2 = 0").distinct()
    return terms.node_features(nodes, f.distinct(), nerves, inside)


JN7 = """WITH n AS (SELECT p_partkey AS node, p_partkey % 97 AS term, [p_partkey % 53 + 100, p_partkey % 29 + 200] AS layers FROM part),
f AS (SELECT DISTINCT unnest([p_partkey % 89, p_partkey % 31 + 100, p_partkey % 23 + 200]) AS model, p_partkey AS feature FROM part),
l AS (SELECT node, layers[i] AS layer, i - 1 AS pos FROM n, (SELECT unnest([1, 2]) AS i) WHERE layers[i] IN (SELECT model FROM f) AND layers[i] NOT BETWEEN 205 AND 209),
u AS (SELECT node, term, -1 AS pos FROM n WHERE term IN (SELECT model FROM f) UNION ALL SELECT n.node, arg_min(layer, pos), min(pos) FROM n JOIN l USING (node)
  WHERE term NOT IN (SELECT model FROM f) GROUP BY n.node),
r AS (SELECT l.node, layer FROM l JOIN u USING (node) WHERE l.pos > u.pos), c AS (SELECT DISTINCT node, feature FROM u JOIN f ON f.model = u.term),
x AS (SELECT c.*, EXISTS (SELECT 1 FROM r JOIN f ON f.model = r.layer WHERE r.node = c.node AND f.feature = c.feature AND (c.feature + r.layer) % 2 = 0) AS fits,
  EXISTS (SELECT 1 FROM r WHERE r.node = c.node) AS held FROM c)
SELECT node, feature FROM x QUALIFY NOT held OR fits OR (NOT bool_or(fits) OVER (PARTITION BY node) AND count(*) OVER (PARTITION BY node) = 1)"""


def jn9_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.features(spark, sf_dir).select("id", (F.col("id") % 40).alias("model"))
    k = F.col("s_suppkey")
    proxies = F.array((k * 3) % 60, (k * 7) % 60)
    d = table(spark, sf_dir, "supplier").select(k.alias("feature"), F.posexplode(proxies).alias("ord", "proxy"))
    return terms.proxy_features(d, f)


JN9 = with_frames("features", body=""", f AS (SELECT id, id % 40 AS model FROM features), d AS (SELECT feature, ord, CASE ord WHEN 0 THEN feature * 3 % 60
  ELSE feature * 7 % 60 END AS proxy FROM (SELECT s_suppkey AS feature FROM supplier), (SELECT unnest([0, 1]) AS ord))
SELECT feature, id AS host, (row_number() OVER (PARTITION BY id ORDER BY feature, ord) - 1)::INTEGER AS seq FROM d JOIN f ON f.model = proxy WHERE feature NOT IN (SELECT model FROM f)""")


def jn32_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of (type, brand) names."""
    p = table(spark, sf_dir, "part")
    a = p.where("p_size < 20").select(F.col("p_type").alias("name"), F.col("p_brand").alias("parent"), F.col("p_size").alias("term"))
    n = p.select(F.col("p_type").alias("name"), F.col("p_brand").alias("parent")).distinct()
    return terms.name_lookup(n, a).withColumn("term", F.col("term").cast("string"))


JN32 = """WITH a AS (SELECT p_type AS name, p_brand AS parent, p_size AS term FROM part WHERE p_size < 20),
p AS (SELECT list_sort([name, parent]) AS k, min(term) AS t FROM a GROUP BY k HAVING count(DISTINCT term) = 1), s AS (SELECT name, min(term) AS t FROM a GROUP BY name HAVING count(DISTINCT term) = 1)
SELECT n.name, n.parent, coalesce(p.t, s.t)::VARCHAR AS term FROM (SELECT DISTINCT p_type AS name, p_brand AS parent FROM part) n LEFT JOIN p ON p.k = list_sort([n.name,
  n.parent]) LEFT JOIN s ON s.name = n.name"""


def jn38_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triple pattern: where suppliers are, with optional labels."""
    t = frames.triples(spark, sf_dir)
    at, part = t.where("p = 'locatedIn'").select("s", F.col("o").alias("n")), t.where("p = 'partOf'").select(F.col("s").alias("n"), F.col("o").alias("region"))
    labels = t.where("p = 'label'")
    return at.join(part, "n").join(labels.select("s", F.col("o").alias("label")), "s", "left").join(labels.select(F.col("s").alias("n"), F.col("o").alias("nation")), "n", "left").select("s", "n", "region", "label", "nation")


JN38 = with_frames("triples", body=""" SELECT a.s, a.o AS n, b.o AS region, c.o AS label, d.o AS nation FROM triples a JOIN triples b ON b.s = a.o AND b.p = 'partOf'
LEFT JOIN triples c ON c.s = a.s AND c.p = 'label' LEFT JOIN triples d ON d.s = a.o AND d.p = 'label' WHERE a.p = 'locatedIn'""")


def jn41_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each path by number; those of a prime remainder are known by name."""
    lists = frames.path_nodes(spark, sf_dir).groupBy(F.col("path").alias("owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"].cast("string")).alias("ids"))
    f = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("string").alias("key"), F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") + 1).cast("string")).alias("name_key"), F.col("p_partkey").alias("number"))
    found, _ = terms.numeric_ids(lists, f)
    return found.withColumn("numbers", _text("numbers"))


JN41 = with_frames("path_nodes", body=""", f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 END AS n FROM part WHERE p_partkey % 7 <> 0),
r AS (SELECT path, pos, coalesce((SELECT k FROM f WHERE n = node), (SELECT k FROM f WHERE k = node)) AS number FROM path_nodes)
SELECT path AS owner, string_agg(number::VARCHAR, ',' ORDER BY pos) AS numbers FROM r WHERE number IS NOT NULL GROUP BY path""")


_IN = "b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
_OVER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


def jn10_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.covering(frames.features(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), frames.containers(spark, sf_dir).select((F.col("id") + 10_000_000).alias("id"), "x0", "y0", "x1", "y1")).withColumn("covering", _text("covering"))


JN10 = with_frames("features", "containers", body=f" SELECT a.id, string_agg((b.id + 10000000)::VARCHAR, ',' ORDER BY {_AREA.format('b')}, b.id) AS covering FROM features a JOIN containers b ON {_IN} GROUP BY a.id")


def jn12_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.features(spark, sf_dir).select("id", "x0", "y0", "x1", "y1")
    return spatial.smallest_parent(f, f)


JN12 = with_frames("features", body=f" SELECT a.id, arg_min(b.id, ({_AREA.format('b')}, b.id)) AS parent FROM features a JOIN features b ON a.id <> b.id AND b.x0 < a.x0 AND b.y0 < a.y0 AND b.x1 > a.x1 AND b.y1 > a.y1 GROUP BY a.id")


def jn13_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.features(spark, sf_dir).select("id", "x0", "y0", "x1", "y1")
    return spatial.overlap_parents(f, f).withColumn("parents", _text("parents"))


JN13 = with_frames("features", body=f" SELECT a.id, string_agg(b.id::VARCHAR, ',' ORDER BY {_AREA.format('b')}, b.id) AS parents FROM features a JOIN features b ON {_AREA.format('b')} > {_AREA.format('a')} AND {_OVER} >= 0.2 * {_AREA.format('a')} GROUP BY a.id")


def jn14_nearly_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearly_inside(frames.features(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), frames.containers(spark, sf_dir).select((-F.col("id") - 1).alias("id"), "x0", "y0", "x1", "y1"))


JN14 = with_frames("features", "containers", body=f" SELECT a.id, -b.id - 1 AS outer_id FROM features a JOIN containers b ON {_OVER} > 0 AND {_AREA.format('a')} - {_OVER} <= 0.1 * {_AREA.format('a')}")


def jn15_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the map moved by a unit or two, against the map."""
    f = frames.features(spark, sf_dir).select("id", "x0", "y0", "x1", "y1", F.col("class").alias("name"))
    d = F.col("id") % 4
    layer = f.where("id % 2 = 0").select("id", (F.col("x0") + d).alias("x0"), "y0", (F.col("x1") + d).alias("x1"), "y1", "name")
    return spatial.near_duplicates(layer, f).select("id", "base_id", "tier")


JN15 = with_frames("features", body=f""", a AS (SELECT id, x0 + id % 4 AS x0, y0, x1 + id % 4 AS x1, y1, class FROM features WHERE id % 2 = 0),
p AS (SELECT a.id, b.id AS base_id, {_OVER} AS c, least({_OVER} / ({_AREA.format('a')})::DOUBLE, {_OVER} / ({_AREA.format('b')})::DOUBLE) AS s, a.class = b.class AS same
  FROM a JOIN features b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
t AS (SELECT *, CASE WHEN s >= 0.98 THEN 1 WHEN s >= 0.8 THEN 2 WHEN same THEN 3 END AS tier FROM p)
SELECT id, base_id, tier::INTEGER AS tier FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, c DESC, base_id) = 1""")


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.features(spark, sf_dir).select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))


def jn16_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(_ends(spark, sf_dir), frames.points(spark, sf_dir), 40).withColumn("connector", F.col("connector").cast("string"))


JN16 = with_frames("features", "points", body=""", p AS (SELECT f.id, p.id AS c, (f.x0 - x) ** 2 + (f.y0 - y) ** 2 AS d FROM features f
  JOIN points p ON x BETWEEN f.x0 - 40 AND f.x0 + 40 AND y BETWEEN f.y0 - 40 AND f.y0 + 40),
m AS (SELECT id, c, d FROM p WHERE d < 1600 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)
SELECT f.id, c::VARCHAR AS connector, round(sqrt(d), 6) AS distance FROM features f LEFT JOIN m USING (id)""")


def jn17_all_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = frames.points(spark, sf_dir).select("id", F.floor(F.col("x") / 25).alias("x"), F.floor(F.col("y") / 25).alias("y"))
    e = _ends(spark, sf_dir).select("id", F.floor(F.col("x") / 25).alias("x"), F.floor(F.col("y") / 25).alias("y"))
    return spatial.all_nearest(e, snap, 3).withColumn("connectors", _text("connectors"))


JN17 = with_frames("features", "points", body=""", p AS (SELECT f.id, p.id AS c, (f.x0 // 25 - x // 25) ** 2 + (f.y0 // 25 - y // 25) ** 2 AS d FROM features f
  JOIN points p ON abs(x // 25 - f.x0 // 25) <= 3 AND abs(y // 25 - f.y0 // 25) <= 3),
m AS (SELECT id, c FROM p WHERE d < 9 QUALIFY d = min(d) OVER (PARTITION BY id))
SELECT id, string_agg(c::VARCHAR, ',' ORDER BY c) AS connectors, CASE count(*) WHEN 1 THEN 'skip' WHEN 2 THEN 'join' ELSE 'flag' END AS action FROM m GROUP BY id""")


def jn34_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.smallest_container_of_points(frames.points(spark, sf_dir), frames.containers(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"))


JN34 = with_frames("points", "containers", body=" SELECT p.id, min(c.id) AS region FROM points p JOIN containers c ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY p.id")


def ag6_group_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.features(spark, sf_dir)
    return spatial.group_bounds(f.select(F.col("class").alias("group"), F.col("id").alias("member")), f.where("id % 9 <> 0"))


AG6 = with_frames("features", body=' SELECT class AS "group", min(x0) FILTER (WHERE id % 9 <> 0) AS x0, min(y0) FILTER (WHERE id % 9 <> 0) AS y0, max(x1) FILTER (WHERE id % 9 <> 0) AS x1, max(y1) FILTER (WHERE id % 9 <> 0) AS y1, count(*) FILTER (WHERE id % 9 = 0) AS missing FROM features GROUP BY class')


def tl4_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features each tile of 64 units meets."""
    return tiling.tiles_of_boxes(frames.features(spark, sf_dir), 64).groupBy("tx", "ty").agg(F.count("*").alias("n"))


TL4 = with_frames("features", body=""" SELECT tx::INTEGER AS tx, ty::INTEGER AS ty, count(*) AS n FROM (SELECT tx, unnest(range(y0 // 64, y1 // 64 + 1)) AS ty
  FROM (SELECT y0, y1, unnest(range(x0 // 64, x1 // 64 + 1)) AS tx FROM features)) GROUP BY ALL""")


def wn5_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.latest_map(frames.maps(spark, sf_dir))


WN5 = with_frames("maps", body=" SELECT taxon, sex, map_id, created FROM maps QUALIFY row_number() OVER (PARTITION BY taxon, sex ORDER BY created DESC, map_id DESC) = 1")


def wn8_text_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of the texts of each brand, clustered by their cluster's first."""
    p = table(spark, sf_dir, "part")
    return rollups.text_clusters(p.select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("baseline")), 12)


WN8 = """WITH RECURSIVE t AS (SELECT p_brand AS g, p_partkey AS seq, p_size AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_size) AS k FROM part),
r AS (SELECT g, k, seq, b AS head, 1 AS c FROM t WHERE k = 1 UNION ALL SELECT t.g, t.k, t.seq, CASE WHEN abs(t.b - head) > 12 THEN t.b ELSE head END, c + CASE
  WHEN abs(t.b - head) > 12 THEN 1 ELSE 0 END FROM r JOIN t ON t.g = r.g AND t.k = r.k + 1)
SELECT g AS "group", seq, c::INTEGER AS cluster FROM r"""


def wn14_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.regexp_replace("p_brand", "#", "").alias("class"))
    taken = rows.where("id % 10 = 0").select(F.concat_ws("-", "class", ((F.col("id") / 10).cast("int") % 20 + 1)).alias("name")).distinct()
    return rollups.unique_names(rows, taken)


WN14 = """WITH r AS (SELECT p_partkey AS id, replace(p_brand, '#', '') AS class, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
t AS (SELECT DISTINCT class || '-' || (id // 10 % 20 + 1) AS name FROM r WHERE id % 10 = 0),
n AS (SELECT class, class || '-' || i AS name, row_number() OVER (PARTITION BY class ORDER BY i) AS k FROM (SELECT DISTINCT class FROM r), (SELECT unnest(range(1,
  (SELECT max(k) + 30 FROM r))) AS i) WHERE class || '-' || i NOT IN (SELECT name FROM t))
SELECT r.id, r.class, n.name FROM r JOIN n ON n.class = r.class AND n.k = r.k"""


def tk1_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five terms nearest to every vector whose id is divisible by 50, among all others."""
    e = table(spark, sf_dir, "embeddings")
    return rollups.top_k(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), e.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("term"), F.col("embedding").alias("vector")), 5)


TK1 = """WITH s AS (SELECT q.vec_id AS query, t.vec_id AS term, round(list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS score FROM embeddings q,
  embeddings t WHERE q.vec_id % 50 = 0 AND t.vec_id % 50 <> 0)
SELECT query, term, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, term))::INTEGER AS rank FROM s QUALIFY rank <= 5"""


def ag12_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of drawn tags and the first page of each."""
    t = frames.drawn_tags(spark, sf_dir)
    return rollups.tag_counts(t.select("tag", "value", F.col("page_id").alias("seq"), (F.col("page_id") % 5).alias("category")))


AG12 = with_frames("drawn_tags", body=" SELECT tag, value, count(*) AS n, arg_min(page_id % 5, page_id) AS category FROM drawn_tags GROUP BY tag, value")


def ag17_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frames.log_events(spark, sf_dir)
    return rollups.common_issues(log.where("level <> 'info'").select("map_id", F.concat_ws(" ", "msg", (F.col("node") % 25).cast("string")).alias("issue")))


AG17 = with_frames("log_events", body=""", i AS (SELECT map_id, msg || ' ' || (node % 25) AS issue FROM log_events WHERE level <> 'info')
SELECT issue, count(DISTINCT map_id) AS maps, count(DISTINCT map_id) = (SELECT count(DISTINCT map_id) FROM i) AS common FROM i GROUP BY issue""")


def ag18_merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = frames.aliases(spark, sf_dir)
    lists = lambda df, name: df.groupBy(F.col("canonical").alias("id")).agg(F.collect_list("alias").alias("aliases")).withColumn("name", F.concat(F.lit(name), F.col("id").cast("string")))
    return terms.merged_aliases(lists(a.where("ord = 0"), "first "), lists(a.where("ord = 1 or alias % 3 = 0"), "second ")).withColumn("aliases", _text("aliases"))


AG18 = with_frames("aliases", body=""" SELECT canonical AS id, CASE WHEN bool_or(ord = 0) THEN 'first ' ELSE 'second ' END || canonical AS name,
  array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases FROM aliases GROUP BY canonical""")


def flt1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.path_nodes(spark, sf_dir).select("path").distinct()
    of = lambda m: p.where(f"path % {m} = 0")
    return enrich.filtered_paths(p, of(6), of(10), of(4))


FLT1 = with_frames("path_nodes", body=" SELECT DISTINCT path FROM path_nodes WHERE (path % 6 = 0 OR path % 10 = 0) AND path % 4 <> 0")


def flt9_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the parts of one name and brand the first; the number of others is kept."""
    f = frames.features(spark, sf_dir).select(F.concat_ws("|", "class", (F.col("id") % 30).cast("string")).alias("id"), F.col("id").alias("seq"))
    kept, lost = enrich.first_of_each_id(f, "seq")
    return kept.join(lost.groupBy("id").agg(F.count("*").alias("rejected")), "id", "left").select("id", "seq", F.coalesce("rejected", F.lit(0)).alias("rejected"))


FLT9 = with_frames("features", body=" SELECT class || '|' || (id % 30) AS id, min(features.id) AS seq, count(*) - 1 AS rejected FROM features GROUP BY class || '|' || (features.id % 30)")


def qa_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and ambiguous names, unknown classes, markup errors, of all parts at once."""
    f, a = frames.features(spark, sf_dir), frames.aliases(spark, sf_dir)
    m = frames.markup(spark, sf_dir).select("id", markup.parsed(F.col("markup"))["error"].alias("error"))
    known = frames.rules(spark, sf_dir).where("scope = 'class' and value like '%3%'").select("key")
    return (
        quality.repeated(f, "name", "drawn", "QA-3", "Drawn more than once")
        .unionByName(quality.several(a, "alias", "canonical", "alias", "QA-5", "Alias of several"))
        .unionByName(quality.unknown(f, "class", known, "class", "QA-4", "Class has no rule"))
        .unionByName(quality.flagged(m, "id", "error", "markup", "QA-20"))
    )


QA = with_frames("features", "aliases", "rules", "markup", body=""", u AS (
SELECT 'drawn' AS type, 'QA-3' AS code, name AS location, 'Drawn more than once: ' || count(*) AS issue FROM features GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'alias', 'QA-5', alias::VARCHAR, 'Alias of several: ' || array_to_string(list_sort(list(DISTINCT canonical)), ', ') FROM aliases GROUP BY alias HAVING count(DISTINCT canonical) > 1
UNION ALL SELECT DISTINCT 'class', 'QA-4', class, 'Class has no rule' FROM features WHERE class NOT IN (SELECT key FROM rules WHERE scope = 'class' AND value LIKE '%3%')
UNION ALL SELECT 'markup', 'QA-20', id::VARCHAR, CASE WHEN markup LIKE '% styling%' THEN '''styling'' element can''t have an ''id'' nor ''class''' ELSE 'Syntax error' END
  FROM markup WHERE markup LIKE '% styling%' OR markup LIKE '%path(%')
SELECT 0::BIGINT AS map_id, * FROM u""")


def snk1_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows as they are written, a document a line."""
    f = frames.features(spark, sf_dir)
    props = F.map_filter(F.create_map(F.lit("label"), F.col("name"), F.lit("models"), F.col("model"), F.lit("kind"), F.when(F.col("size") > 25, "organ")), lambda k, v: v.isNotNull())
    return sinks.geojson(f.select("id", F.lit("base/main").alias("layer"), "x0", "y0", "x1", "y1", props.alias("props"))).select("tile_layer", "id", "feature")


SNK1 = with_frames("features", body=""" SELECT 'base_main_features' AS tile_layer, id,
  '{"type":"Feature","id":' || id || ',"geometry":{"type":"Polygon","coordinates":[[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]},"properties":{"label":"' || name || '","models":"' || model || '"'
 || CASE WHEN size > 25 THEN ',"kind":"organ"' ELSE '' END || '}}' AS feature FROM features""")


def str1_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the live monitor emits for a finished log: warnings and errors per hour, map and type."""
    from ..streaming.monitor import windowed

    return windowed(frames.log_events(spark, sf_dir), "1 hour").select(F.col("window.start").alias("start"), "map_id", "type", "level", "n")


STR1 = with_frames("log_events", body=" SELECT date_trunc('hour', ts) AS start, map_id, type, level, count(*) AS n FROM log_events WHERE level IN ('warning', 'error') GROUP BY ALL")

_ALL = {
    jn1_cascade: JN1, jn3_labels: JN3, jn6_aliases: JN6, src7_alias_conflicts: SRC7, jn7_node_features: JN7, jn9_proxies: JN9, jn32_names: JN32, jn38_labels: JN38, jn41_numbers: JN41, jn10_covering: JN10, jn12_parents: JN12,
    jn13_overlaps: JN13, jn14_nearly_inside: JN14, jn15_near_duplicates: JN15, jn16_nearest: JN16, jn17_all_nearest: JN17, jn34_regions: JN34, ag6_group_bounds: AG6, tl4_tiles: TL4, wn5_latest: WN5, wn8_text_clusters: WN8, wn14_names: WN14,
    tk1_top_terms: TK1, ag12_tags: AG12, ag17_common: AG17, ag18_merged_aliases: AG18, flt1_paths: FLT1, flt9_first: FLT9, qa_rules: QA, snk1_geojson: SNK1, str1_monitor: STR1,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items()}
