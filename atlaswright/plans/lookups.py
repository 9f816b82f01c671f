"""Lookups, filters and roll-ups of features and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import classify, enrich, graph, rollups, spatial, terms
from ..sources import documents, sinks
from ..sources.scans import staged
from . import frames
from .frames import table, with_frames


def _text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _pick(values: tuple[str, ...], k) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return table(spark, sf_dir, "part"), F.col("p_partkey")


def src1_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as manifests, read as files; some lack an id, sources, or an href (SRC-1, 2, 3)."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    source = lambda n, kind: F.struct(F.lit(n).alias("id"), F.when(k % 7 > 0, F.concat(F.lit(" h"), k)).alias("href"), F.lit(kind).alias("kind"))
    sources = F.when(k % 5 > 0, F.array(source("a", "details"), source("b", "base"), source("c", "annotation"))).otherwise(F.array().cast("array<struct<id:string,href:string,kind:string>>"))
    docs = s.select(F.when(k % 11 > 0, F.concat(F.lit("m"), k, F.lit(" "))).alias("id"), F.col("s_name").alias("name"), _pick(("functional map", "centreline", "other"), k).alias("kind"), sources.alias("sources"))
    good, _ = documents.manifests(spark, staged(docs.withColumn("dir", F.col("name")), "json", partitionBy="dir"))
    return documents.ordered_sources(good).join(good.select(F.col("id").alias("map_id"), "map_kind"), "map_id").select("map_id", "map_kind", "id", "href", "ordinal")


SRC1 = """SELECT 'm' || s_suppkey AS map_id, ['functional', 'centreline', 'anatomical'][s_suppkey % 3 + 1] AS map_kind, ['b', 'c', 'a'][o + 1] AS id, 'h' || s_suppkey AS href, o::INTEGER AS ordinal
FROM supplier, range(0, 3) t(o) WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 AND s_suppkey % 11 > 0"""


def src4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' property documents, in the new layout and the old one."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    new = F.concat(F.lit('{"classes": {"c'), k % 3, F.lit('": {"label": "L'), k, F.lit('"}}, "features": {"f '), k % 4, F.lit('": {"type": "T'), k, F.lit('", "associated-details": '), F.when(k % 4 == 0, '"one"').otherwise('["one","two"]'), F.lit("}}}"))
    old = F.concat(F.lit('{"features": [{"id": "f '), k % 4, F.lit('", "properties": {"type": "T'), k, F.lit('"}}, {"class": "c'), k % 3, F.lit('", "properties": {"label": "L'), k, F.lit('"}}]}'))
    return documents.property_rules(s.select(F.col("s_nationkey").alias("map_id"), k.alias("seq"), F.when(k % 2 == 0, new).otherwise(old).alias("json")))


SRC4 = """SELECT s_nationkey AS map_id, 'class' AS scope, 'c' || s_suppkey % 3 AS key, 'label' AS prop, 'L' || max(s_suppkey) AS value FROM supplier GROUP BY s_nationkey, s_suppkey % 3
UNION ALL SELECT s_nationkey, 'id', 'f_' || s_suppkey % 4, 'type', 'T' || max(s_suppkey) FROM supplier GROUP BY s_nationkey, s_suppkey % 4
UNION ALL SELECT s_nationkey, 'id', 'f_' || s_suppkey % 4, 'associated-details', CASE WHEN max(s_suppkey) % 4 = 0 THEN '["one"]' ELSE '["one","two"]' END FROM supplier
  WHERE s_suppkey % 2 = 0 GROUP BY s_nationkey, s_suppkey % 4"""


def src13_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' boxes drawn as XML files, scanned and turned into vertices (SRC-13, 14)."""
    c = frames.containers(spark, sf_dir)
    names = (("x", "x0"), ("y", "y0"), ("width", "w"), ("height", "h"))
    attributes = F.concat(*[F.concat(F.lit(f' {a}="'), F.col(b).cast("string"), F.lit('"')) for a, b in names])
    size = F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("x1") - F.col("x0"))
    rows = c.select("id", "x0", "y0", size.alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    rect = F.concat(F.lit('<rect id="'), "id", F.lit('"'), attributes, F.lit("/>"))
    drawing = F.concat(F.lit("<svg>"), F.array_join(F.collect_list(rect), ""), F.lit("</svg>"))
    files = rows.groupBy((F.col("id") % 50).alias("dir")).agg(drawing.alias("value"))  # a file each
    found = documents.drawing_elements(spark, staged(files, "text", partitionBy="dir"), "rect")
    none = dict.fromkeys(("r", "rx", "ry", "cx", "cy", "points", "x1", "y1", "x2", "y2"), F.lit(None).cast("string"))
    shape = documents.basic_shape(F.lit("rect"), none | {a: F.col(f"_{a}") for a, _ in names})
    return found.select(F.col("_id").alias("id"), F.array_join(F.transform(shape, lambda p: F.concat_ws(" ", p["x"].cast("long"), p["y"].cast("long"))), ",").alias("vertices"))


SRC13 = with_frames("containers", body=""" SELECT id, CASE
  WHEN id % 4 <> 0 THEN x0 || ' ' || y0 || ',' || x1 || ' ' || y0 || ',' || x1 || ' ' || y1 || ',' || x0 || ' ' || y1 || ',' || x0 || ' ' || y0 END AS vertices FROM containers""")


def snk3_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    return sinks.labelled(p.select(k.alias("id"), F.when(k % 3 > 0, F.concat(F.lit("T:"), k % 9)).alias("models"), F.col("p_name").alias("label")))


SNK3 = """SELECT p_partkey AS id, '{"id":' || p_partkey || ',"models":"T:' || p_partkey % 9 || '","label":"' || p_name || '"}' AS feature FROM part WHERE p_partkey % 3 > 0"""


def snk11_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cited = F.when(k % 4 > 0, F.array_distinct(F.array(k % 30, k % 7))).otherwise(F.array().cast("array<long>"))
    details = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("publication"), F.col("n_name").alias("title"))
    return rollups.publications(o.select(k.alias("path"), cited.alias("publications")), details).withColumn("publication", F.col("publication").cast("string")).select("path", "publication", "title")


SNK11 = """SELECT path, x::VARCHAR AS publication, n_name AS title FROM (SELECT o_orderkey AS path, unnest(CASE
  WHEN o_orderkey % 4 > 0 THEN list_distinct([o_orderkey % 30, o_orderkey % 7]) ELSE [NULL] END) AS x FROM orders) LEFT JOIN nation ON n_nationkey = x"""


def snk15_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    shapes = p.select(k.cast("string").alias("id"), _pick(("component", "connection"), k).alias("kind"), F.when(k % 3 > 0, F.col("p_brand")).alias("label"), F.when(k % 4 == 0, F.upper("p_brand")).otherwise(F.col("p_type")).alias("name"), F.when(k % 2 == 1, (k + 1).cast("string")).alias("source"), F.when(k % 6 == 1, (k + 2).cast("string")).alias("target"))
    return sinks.shape_triples(shapes)


SNK15 = """WITH s AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS s, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS label, CASE
  WHEN p_partkey % 4 = 0 THEN upper(p_brand) ELSE p_type END AS name FROM part)
SELECT s, 'type' AS p, ['component', 'connection'][k % 2 + 1] AS o FROM s UNION ALL SELECT s, 'label', label FROM s WHERE label IS NOT NULL UNION ALL SELECT s, 'comment',
  name FROM s WHERE lower(name) <> lower(label)
UNION ALL SELECT s, 'hasSource', (k + 1)::VARCHAR FROM s WHERE k % 2 = 1 UNION ALL SELECT s, 'hasTarget', (k + 2)::VARCHAR FROM s WHERE k % 6 = 1"""


def flt2_sexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose sex, where known, agrees with that of their customer."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sex = lambda k: F.when(k % 3 == 0, "female").when(k % 3 == 1, "male")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.where(enrich.compatible_sex(sex(F.col("o_orderkey")), sex(F.col("c_custkey")))).select(F.col("o_orderkey").alias("path"))


FLT2 = "SELECT o_orderkey AS path FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 2 OR c_custkey % 3 = 2 OR o_orderkey % 3 = c_custkey % 3"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    return p.select(k.alias("id"), F.when(k % 5 == 0, F.lit(True)).alias("exclude"), F.when(k % 7 == 0, "bad").alias("error"), F.when(k % 3 == 0, "odd").alias("warning"), _pick(("auto-hide", "plain", "other"), k).alias("class"), F.when(k % 4 > 0, _pick(("nerve", "node", "organ"), k * 5)).alias("kind"), F.when(k % 2 == 0, F.lit(True)).alias("centreline"))


_KIND = "CASE WHEN p_partkey % 4 > 0 THEN ['nerve', 'node', 'organ'][p_partkey * 5 % 3 + 1] END"


def flt4_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is output, and what more when authoring."""
    f = _features(spark, sf_dir)
    rows = lambda authoring: enrich.output_rows(f, authoring).select("id", F.lit(authoring).alias("authoring"), F.coalesce("warning", F.lit("")).alias("warning"))
    return rows(False).union(rows(True))


FLT4 = """SELECT p_partkey AS id, false AS authoring, '' AS warning FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 7 > 0
UNION ALL SELECT p_partkey, true, CASE WHEN p_partkey % 3 = 0 THEN 'odd' ELSE '' END FROM part WHERE p_partkey % 5 > 0"""


def flt5_whitelisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    props = F.create_map(F.lit("label"), F.col("p_name"), F.lit("secret"), F.col("p_type"), F.lit("kind"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("p_brand")))
    kept = F.transform(F.array_sort(F.map_entries(enrich.whitelisted(props, ["label", "kind"]))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return p.select(k.alias("id"), F.array_join(kept, ";").alias("props"))


FLT5 = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN 'kind=' || p_brand || ';' ELSE '' END || 'label=' || p_name AS props FROM part"


def flt6_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default visibility, and what paths make visible again (FLT-6, 7)."""
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("id"))
    return enrich.visible_again(enrich.default_visibility(_features(spark, sf_dir).drop("exclude")), used).select("id", "exclude", "tile_layer")


FLT6 = f"""WITH f AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS auto, {_KIND} AS kind, p_partkey % 2 = 0 AS line FROM part)
SELECT id, (auto OR coalesce(kind = 'node', false) OR coalesce(kind = 'nerve', false) AND NOT line) AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25) AS exclude,
CASE WHEN kind IN ('nerve', 'node') THEN 'pathways' ELSE 'features' END AS tile_layer FROM f"""


def flt8_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = enrich.default_visibility(_features(spark, sf_dir).drop("exclude"))
    return enrich.network_only(f, table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id"))).select("id", "tile_layer")


FLT8 = f"""WITH f AS (SELECT p_partkey AS id, CASE WHEN {_KIND} IN ('nerve', 'node') THEN 'pathways' ELSE 'features' END AS tile_layer FROM part)
SELECT * FROM f WHERE tile_layer = 'pathways' OR id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)"""


def flt11_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    props = F.create_map(F.lit("id"), k.cast("string"), F.concat(F.lit("q"), k % 3), F.concat(F.lit("v"), k))
    rows = enrich.inherited(p.select(k.alias("id"), (k - k % 10).alias("parent"), props.alias("props")))
    return rows.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("props"))


FLT11 = """WITH g AS (SELECT p_partkey AS k, p_partkey - p_partkey % 10 AS p FROM part)
SELECT c.k AS id, 'id=' || c.k || ';' || CASE WHEN u.k IS NULL OR u.k % 3 = c.k % 3 THEN 'q' || c.k % 3 || '=v' || c.k
WHEN u.k % 3 < c.k % 3 THEN 'q' || u.k % 3 || '=v' || u.k || ';q' || c.k % 3 || '=v' || c.k
  ELSE 'q' || c.k % 3 || '=v' || c.k || ';q' || u.k % 3 || '=v' || u.k END AS props FROM g c LEFT JOIN g u ON u.k = c.p"""


def flt12_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that make features, and what their paint says (FLT-12, 13, SC-36)."""
    p, k = _part(spark, sf_dir)
    shapes = p.select(F.when(k % 4 == 0, k).alias("id"), k.alias("key"), F.when(k % 3 == 0, "red").alias("fill"), F.when(k % 5 == 0, "blue").alias("stroke"), (k % 7 == 0).alias("is_path"), (k % 11 == 0).alias("invisible"), (k % 13 == 0).alias("styling"))
    return enrich.painted(shapes).select("key", F.coalesce(classify.paint_category(F.col("fill"), F.col("stroke")), F.lit("")).alias("category"))


FLT12 = """SELECT p_partkey AS key, CASE WHEN p_partkey % 15 = 0 THEN 'region' WHEN p_partkey % 3 = 0 THEN 'nuclei' WHEN p_partkey % 5 = 0 THEN 'plexus' ELSE '' END AS category FROM part
WHERE (p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 4 = 0) AND p_partkey % 7 > 0 AND p_partkey % 11 > 0 AND p_partkey % 13 > 0"""


def flt14_hyperlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    links = enrich.hyperlinks(p.select(k.alias("id"), F.col("p_brand").alias("parent"), _pick(("hyperlink", "text"), k).alias("kind"), F.concat(F.lit("u"), k).alias("url")))
    return links.select("parent", F.array_join("hyperlinks.url", ",").alias("urls"))


FLT14 = "SELECT p_brand AS parent, string_agg('u' || p_partkey, ',' ORDER BY p_partkey) AS urls FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand"


def jn2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of classes, and the classes that have none."""
    p, k = _part(spark, sf_dir)
    anatomy = p.where("p_size > 40").groupBy(F.col("p_brand").alias("class")).agg(F.concat(F.lit("T:"), F.min("p_partkey")).alias("term"))
    known, lost = enrich.class_terms(p.select(k.alias("id"), F.col("p_brand").alias("class")), anatomy)
    return known.select("id", "class", F.coalesce("term", F.lit("")).alias("term")).union(lost.select(F.lit(-1).cast("long"), "class", F.lit("none")))


JN2 = """WITH a AS (SELECT p_brand AS class, 'T:' || min(p_partkey) AS term FROM part WHERE p_size > 40 GROUP BY 1)
SELECT p_partkey AS id, p_brand AS class, coalesce(term, '') AS term FROM part LEFT JOIN a ON class = p_brand UNION ALL SELECT DISTINCT -1, p_brand, 'none' FROM part
  WHERE p_brand NOT IN (SELECT class FROM a)"""


def jn4_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    set_ = lambda n: F.when(k % n == 0, "x")
    return p.select(k.alias("id"), F.coalesce(enrich.marker_kind(set_(4), set_(3), set_(2)), F.lit("none")).alias("kind"))


JN4 = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'dataset' WHEN p_partkey % 3 = 0 THEN 'scaffold' WHEN p_partkey % 2 = 0 THEN 'simulation' ELSE 'none' END AS kind FROM part"


def jn5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    n = frames.path_nodes(spark, sf_dir).select(F.col("node").alias("feature"), "path")
    rows = enrich.tag_lines(p.select(k.alias("id")), n.where("path % 5 = 0"), n.where("path % 3 = 0"))
    return rows.select("id", F.coalesce(_text("line_paths"), F.lit("")).alias("lines"), F.coalesce(_text("nerve_paths"), F.lit("")).alias("nerves"), F.coalesce("type", F.lit("")).alias("type"))


JN5 = with_frames("path_nodes", body=""", d AS (SELECT DISTINCT node, path FROM path_nodes), l AS (SELECT node, string_agg(path::VARCHAR, ',' ORDER BY path) AS l FROM d
  WHERE path % 5 = 0 GROUP BY node),
v AS (SELECT node, string_agg(path::VARCHAR, ',' ORDER BY path) AS v FROM d WHERE path % 3 = 0 GROUP BY node)
SELECT p_partkey AS id, coalesce(l, '') AS lines, coalesce(v, '') AS nerves, CASE WHEN l IS NOT NULL THEN 'line' WHEN v IS NOT NULL THEN 'nerve' ELSE '' END AS type
  FROM part LEFT JOIN l ON l.node = p_partkey LEFT JOIN v ON v.node = p_partkey""")


def jn8_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    nodes = p.select(k.alias("node"), (k % 20).alias("term"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("term"), (F.col("s_suppkey") + 100_000).alias("feature"))
    return terms.with_proxies(p.where("p_size > 25").select(k.alias("node"), k.alias("feature")), nodes, s)


JN8 = """SELECT p_partkey AS node, p_partkey AS feature, 'feature' AS kind FROM part WHERE p_size > 25
UNION ALL SELECT p_partkey, s_suppkey + 100000, 'proxy' FROM part JOIN supplier ON p_partkey % 20 = s_suppkey % 20 WHERE p_size <= 25"""


def jn10_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' boxes in suppliers' diamonds, by their rings."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    c = F.col
    f = frames.features(spark, sf_dir).select("id", "x0", "y0", "x1", "y1", F.array(p(c("x0"), c("y0")), p(c("x1"), c("y0")), p(c("x1"), c("y1")), p(c("x0"), c("y1"))).alias("ring"))
    mx, my = (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2
    diamonds = frames.containers(spark, sf_dir).select((c("id") + 10_000_000).alias("id"), "x0", "y0", "x1", "y1", F.array(p(mx, c("y0")), p(c("x1"), my), p(mx, c("y1")), p(c("x0"), my)).alias("ring"))
    return spatial.inside(diamonds, f).select((c("id") - 10_000_000).alias("diamond"), "feature")


JN10R = with_frames("features", "containers", body=""" SELECT b.id AS diamond, a.id AS feature FROM features a JOIN containers b ON b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1
WHERE greatest(abs(2 * a.x0 - b.x0 - b.x1), abs(2 * a.x1 - b.x0 - b.x1)) * (b.y1 - b.y0) + greatest(abs(2 * a.y0 - b.y0 - b.y1),
  abs(2 * a.y1 - b.y0 - b.y1)) * (b.x1 - b.x0) <= (b.x1 - b.x0) * (b.y1 - b.y0)""")


def jn11_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = ["id", "x0", "y0", "x1", "y1"]
    return spatial.inside(frames.containers(spark, sf_dir).select((F.col("id") + 10_000_000).alias("id"), *box[1:]), frames.features(spark, sf_dir).select(*box))


JN11 = with_frames("features", "containers", body=" SELECT b.id + 10000000 AS id, a.id AS feature FROM features a JOIN containers b ON b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1")


def jn19_crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' diagonals across parts of their class."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    c = frames.containers(spark, sf_dir).select((F.col("id") + 10_000_000).alias("id"), (F.col("id") % 3).alias("class"), F.array(corner("x0", "y0"), corner("x1", "y1")).alias("points"))
    return spatial.crossed(c, frames.features(spark, sf_dir).select("id", (F.col("id") % 3).alias("class"), "x0", "y0", "x1", "y1"))


JN19 = with_frames("features", "containers", body=""", p AS (SELECT b.id + 10000000 AS line, a.id AS component, b.x1 - b.x0 AS dx, b.y1 - b.y0 AS dy, sqrt((a.x1 - a.x0) * (a.y1 - a.y0)) AS size,
least(least((a.x1 - b.x0) / (b.x1 - b.x0)::DOUBLE, (a.y1 - b.y0) / (b.y1 - b.y0)::DOUBLE), 1) - greatest((a.x0 - b.x0) / (b.x1 - b.x0)::DOUBLE, (a.y0 - b.y0) / (b.y1 - b.y0)::DOUBLE, 0) AS span
FROM features a JOIN containers b ON a.id % 3 = b.id % 3 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1) SELECT line, component FROM p
  WHERE greatest(span, 0) * sqrt(dx ** 2 + dy ** 2) > size""")


def _inverted(name: str, key: str, value: str, by: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select((F.col(key) % by).alias("key"), F.col(value).alias("value"))
        return rollups.inverted(rows, "key", "value").withColumn("values", _text("values"))

    run.__name__ = name
    return run, f"SELECT key, string_agg(value::VARCHAR, ',' ORDER BY value) AS \"values\" FROM (SELECT DISTINCT {key} % {by} AS key, {value} AS value FROM lineitem) GROUP BY key"


ag3_nerve_paths, AG3 = _inverted("ag3_nerve_paths", "l_suppkey", "l_orderkey", 1 << 40)
ag14_end_paths, AG14 = _inverted("ag14_end_paths", "l_partkey", "l_orderkey", 1 << 40)
ag20_path_types, AG20 = _inverted("ag20_path_types", "l_orderkey", "l_linenumber", 1 << 40)
ag21_segment_paths, AG21 = _inverted("ag21_segment_paths", "l_suppkey", "l_partkey", 1 << 40)


def ag30_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    rows = lambda where: p.where(where).select(k.alias("id"), F.concat(F.lit("T:"), F.floor(k / 4)).alias("term"))
    labels = p.where("p_partkey % 4 > 0").select(F.concat(F.lit("T:"), k).alias("term"), F.upper("p_name").alias("label"))
    return terms.vocabulary([rows("p_size > 10"), rows("p_size < 5")], table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")), labels)


AG30 = """SELECT DISTINCT 'T:' || p.p_partkey // 4 AS term, coalesce(lower(n.p_name), 't:' || p.p_partkey // 4) AS label FROM part p LEFT
  JOIN part n ON n.p_partkey = p.p_partkey // 4 AND n.p_partkey % 4 > 0
WHERE (p.p_size > 10 OR p.p_size < 5) AND p.p_partkey IN (SELECT l_partkey FROM lineitem)"""


def wn15_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.path_edges(spark, sf_dir).where("dst > src").select((F.col("src") % 60).alias("src"), (F.col("dst") % 60).alias("dst")).where("src <> dst")
    places = frames.features(spark, sf_dir).where("id < 60").select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return spatial.ordered_neighbours(e, places).withColumn("neighbours", _text("neighbours"))


WN15 = with_frames("path_edges", "features", body=""", d AS (SELECT DISTINCT src % 60 AS a, dst % 60 AS b FROM path_edges WHERE dst > src AND src % 60 <> dst % 60),
  e AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
n AS (SELECT e.a AS node, e.b, round(atan2(q.y0 - p.y0, q.x0 - p.x0), 9) AS t FROM e JOIN features p ON p.id = e.a JOIN features q ON q.id = e.b)
SELECT node, string_agg(b::VARCHAR, ',' ORDER BY CASE WHEN t < 0 THEN t + 6.283185307::DOUBLE ELSE t END, b) AS neighbours FROM n GROUP BY node HAVING count(*) > 2""")


def sc21_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    kind, following = _pick(("Polygon", "MultiPolygon", "LineString"), k), _pick(("text", "image"), k)
    share, coverage = (k % 40).cast("double") / 20_000, (k % 101).cast("double") / 100
    return p.select(k.alias("id"), classify.shape_type(kind, k % 23 == 0, F.lit(0.5), coverage, share, k % 6, following).alias("type"))


SC21 = """WITH s AS (SELECT p_partkey AS k, p_partkey % 3 = 1 AS multi, p_partkey % 3 = 2 AS line, (p_partkey % 40)::DOUBLE / 20000 AS b, (p_partkey % 101)::DOUBLE / 100 AS c FROM part)
SELECT k AS id, CASE WHEN k % 23 = 0 THEN 'excluded' WHEN b > 0.001::DOUBLE AND multi THEN 'boundary' WHEN k % 2 = 0 AND c < 0.5::DOUBLE
  AND b < 0.001::DOUBLE THEN 'excluded' WHEN line OR (c < 0.4::DOUBLE AND NOT multi) THEN 'connection' WHEN k % 6 = 4 THEN 'port'
WHEN b > 0.001::DOUBLE AND c > 0.9::DOUBLE THEN 'component' WHEN b < 0.0003::DOUBLE AND c > 0.7::DOUBLE AND c <= 0.8::DOUBLE THEN 'annotation' WHEN b < 0.001::DOUBLE
  AND c > 0.75::DOUBLE THEN 'component' ELSE 'unclassified' END AS type FROM s"""


def sc24_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' diagonals that run within 30 degrees of those of the parts before them."""
    f = frames.features(spark, sf_dir)
    a, b = f.select("id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]), f.select((F.col("id") + 1).alias("id"), *[F.col(c).cast("double").alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    one, two = geometry.direction(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]), geometry.direction(*[F.col(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    return a.join(b, "id").where(geometry.similar_direction(one, two)).select("id")


SC24 = with_frames("features", body=""", d AS (SELECT id, (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS u, (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS v FROM features)
SELECT a.id FROM d a JOIN d b ON b.id + 1 = a.id WHERE a.u * b.u + a.v * b.v >= cos(radians(30))""")


def gr23_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below nations below regions, depth first."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    row = lambda i, p, o: (i.alias("id"), p.alias("parent"), o.cast("long").alias("ord"))
    tree = r.select(*row(F.concat(F.lit("R"), "r_regionkey"), F.lit(None).cast("string"), F.col("r_regionkey"))).union(n.select(*row(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), F.col("n_nationkey")))).union(c.select(*row(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey"), F.col("c_custkey"))))
    return graph.flattened(tree).withColumn("at", _text("at"))


GR23 = """SELECT 'R' || r_regionkey AS id, r_regionkey::VARCHAR AS at FROM region UNION ALL SELECT 'N' || n_nationkey, n_regionkey || ',' || n_nationkey FROM nation
UNION ALL SELECT 'C' || c_custkey, n_regionkey || ',' || n_nationkey || ',' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey"""

_ALL = {
    src1_manifests: SRC1, src4_rules: SRC4, src13_elements: SRC13, snk3_labelled: SNK3, snk11_publications: SNK11, snk15_triples: SNK15, flt2_sexes: FLT2, flt4_output: FLT4, flt5_whitelisted: FLT5, flt6_visibility: FLT6,
    flt8_network: FLT8, flt11_inherited: FLT11, flt12_painted: FLT12, flt14_hyperlinks: FLT14, jn2_terms: JN2, jn4_markers: JN4, jn5_lines: JN5, jn8_proxies: JN8, jn10_rings: JN10R, jn11_inside: JN11, jn19_crossed: JN19,
    ag3_nerve_paths: AG3, ag14_end_paths: AG14, ag20_path_types: AG20, ag21_segment_paths: AG21, ag30_vocabulary: AG30, wn15_neighbours: WN15, sc21_shapes: SC21, sc24_directions: SC24, gr23_tree: GR23,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items()}
