"""Frames derived from the driver tables in integer arithmetic, for Spark and as SQL text.

``SQL`` holds the same definitions for the oracles: ``with_frames("features", ...)`` starts
a query with those it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _boxes(k, width, height):
    x0, y0 = (k * 7919) % 2003, (k * 104729) % 1999
    return [x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + height).alias("y1")]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes named and classed by part."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), *_boxes(k, 5 + k % 60, 5 + (k * 7) % 45), F.col("p_type").alias("model"), F.col("p_brand").alias("class"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), *_boxes(k, 150 + k % 100, 150 + (k * 7) % 100), F.col("s_name").alias("name"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919) % 2003).alias("x"), ((k * 104729) % 1999).alias("y"), F.col("c_nationkey").alias("nation"))


def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path per order: its parts in line order; consecutive different parts are an edge."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst is not null and src <> dst")


def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each path in order, from 0."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_partkey").alias("node"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slashed names, some of them the beginning of others."""
    k = F.col("p_partkey")
    region, nation = F.concat(F.lit("R"), k % 2), F.concat(F.lit("/N"), k % 4)
    name = F.when(k % 3 == 0, region).when(k % 3 == 1, F.concat(region, nation)).otherwise(F.concat(region, nation, F.lit("/C"), k % 12))
    return table(spark, sf_dir, "part").select(k.alias("node"), name.alias("name"))


def subclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    tag = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    return (
        c.select(tag("C:", "c_custkey").alias("child"), tag("N:", "c_nationkey").alias("parent"))
        .union(n.select(tag("N:", "n_nationkey"), tag("R:", "n_regionkey")))
        .union(r.select(tag("R:", "r_regionkey"), F.lit("ROOT")))
    )


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build logs of ten maps."""
    e = table(spark, sf_dir, "events")
    msg = F.when(F.col("event_type") == "error", "Cannot find feature for node").when(F.col("event_type") == "purchase", "Path suppressed as source/destination nodes are missing").when((F.col("event_type") == "view") & (F.col("event_id") < 500), "Using knowledge source").otherwise("info")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return e.select((F.col("user_id") % 10).alias("map_id"), F.col("event_id").alias("seq"), "ts", level.alias("level"), msg.alias("msg"), F.col("event_type").alias("type"), ((F.col("event_id") * 13) % 500).alias("node"), ((F.col("event_id") * 7) % 1000).alias("path"))


def missing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 11 = 0").select(F.col("p_partkey").alias("node"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("map_id"), F.col("o_orderpriority").alias("taxon"), F.col("o_orderstatus").alias("sex"), F.col("o_orderdate").alias("created"))


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape names as markup; some with an unclosed bracket."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        F.lit(".id(P"), k.cast("string"), F.lit(") class("), F.regexp_replace("p_brand", "#", "_"), F.lit(")"),
        F.when(s % 3 == 0, " node").otherwise(""),
        F.when(s % 4 == 0, F.concat(F.lit(" details(D"), (k % 7).cast("string"), F.lit(", "), (3 + k % 5).cast("string"), F.lit(")"))).otherwise(""),
        F.when(s % 5 == 0, " marker").otherwise(""), F.when(s % 29 == 0, " styling").otherwise(""), F.when(k % 97 == 0, " path(").otherwise(""),
    )
    return table(spark, sf_dir, "part").select(k.alias("id"), text.alias("markup"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of a node to a canonical one, some of them to two."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    first = p.where("k % 5 <> 0").select(F.col("k").alias("alias"), (F.col("k") - F.col("k") % 5).alias("canonical"), F.lit(0).alias("ord"))
    return first.union(p.where("k % 50 = 7").select("k", F.col("k") - F.col("k") % 5 + 5, F.lit(1)))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property rules: label and colour for each class, a label for some ids."""
    p = table(spark, sf_dir, "part")
    brands = p.select(F.col("p_brand").alias("b")).distinct()
    by_class = brands.select(F.lit("class").alias("scope"), F.col("b").alias("key"), F.explode(F.array(F.struct(F.lit("label").alias("prop"), F.concat(F.lit("Class "), "b").alias("value")), F.struct(F.lit("colour").alias("prop"), F.lower("b").alias("value")))).alias("e")).select("scope", "key", "e.prop", "e.value")
    by_id = p.where("p_partkey % 13 = 0").select(F.lit("id").alias("scope"), F.col("p_partkey").cast("string").alias("key"), F.lit("label").alias("prop"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("value"))
    return by_class.union(by_id)


def lnglat(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919) % 360 - 180).cast("double").alias("lng"), ((k * 104729) % 160 - 80).cast("double").alias("lat"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    tag = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    return (
        n.select(tag("N:", "n_nationkey").alias("s"), F.lit("label").alias("p"), F.col("n_name").alias("o"))
        .union(n.select(tag("N:", "n_nationkey"), F.lit("partOf"), tag("R:", "n_regionkey")))
        .union(s.select(tag("S:", "s_suppkey"), F.lit("locatedIn"), tag("N:", "s_nationkey")))
        .union(s.where("s_suppkey % 2 = 0").select(tag("S:", "s_suppkey"), F.lit("label"), F.col("s_name")))
    )


def drawn_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link and title tags of raw pages: ``(page_id, tag, value)``."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.lit("href").alias("tag"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("value"))
    return links.union(pages.select("page_id", F.lit("title"), F.explode(F.regexp_extract_all("html", F.lit("<title>([^<]*)</title>"), 1))))


_BOX = "({k} * 7919) % 2003 AS x0, ({k} * 104729) % 1999 AS y0, ({k} * 7919) % 2003 + {w} AS x1, ({k} * 104729) % 1999 + {h} AS y1"
_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey"
SQL = {
    "features": f"SELECT p_partkey AS id, {_BOX.format(k='p_partkey', w='5 + p_partkey % 60', h='5 + (p_partkey * 7) % 45')}, p_type AS model, p_brand AS class, p_name AS name, p_size AS size FROM part",
    "containers": f"SELECT s_suppkey AS id, {_BOX.format(k='s_suppkey', w='150 + s_suppkey % 100', h='150 + (s_suppkey * 7) % 100')}, s_name AS name FROM supplier",
    "points": "SELECT c_custkey AS id, (c_custkey * 7919) % 2003 AS x, (c_custkey * 104729) % 1999 AS y, c_nationkey AS nation FROM customer",
    "path_edges": f"SELECT path, src, dst FROM (SELECT l_orderkey AS path, l_partkey AS src, lead(l_partkey) OVER ({_ORDER}) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst",
    "path_nodes": f"SELECT l_orderkey AS path, row_number() OVER ({_ORDER}) - 1 AS pos, l_partkey AS node FROM lineitem",
    "subclass": "SELECT 'C:' || c_custkey AS child, 'N:' || c_nationkey AS parent FROM customer UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation UNION ALL SELECT 'R:' || r_regionkey, 'ROOT' FROM region",
    "log_events": """SELECT user_id % 10 AS map_id, event_id AS seq, ts,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS level,
        CASE WHEN event_type = 'error' THEN 'Cannot find feature for node' WHEN event_type = 'purchase' THEN 'Path suppressed as source/destination nodes are missing'
             WHEN event_type = 'view' AND event_id < 500 THEN 'Using knowledge source' ELSE 'info' END AS msg,
        event_type AS type, (event_id * 13) % 500 AS node, (event_id * 7) % 1000 AS path FROM events""",
    "missing_nodes": "SELECT p_partkey AS node FROM part WHERE p_partkey % 11 = 0",
    "maps": "SELECT o_orderkey AS map_id, o_orderpriority AS taxon, o_orderstatus AS sex, o_orderdate AS created FROM orders",
    "markup": """SELECT p_partkey AS id, '.id(P' || p_partkey || ') class(' || replace(p_brand, '#', '_') || ')' || CASE WHEN p_size % 3 = 0 THEN ' node' ELSE '' END
        || CASE WHEN p_size % 4 = 0 THEN ' details(D' || (p_partkey % 7) || ', ' || (3 + p_partkey % 5) || ')' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' marker' ELSE '' END
        || CASE WHEN p_size % 29 = 0 THEN ' styling' ELSE '' END || CASE WHEN p_partkey % 97 = 0 THEN ' path(' ELSE '' END AS markup FROM part""",
    "aliases": "SELECT p_partkey AS alias, p_partkey - p_partkey % 5 AS canonical, 0 AS ord FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, p_partkey - p_partkey % 5 + 5, 1 FROM part WHERE p_partkey % 50 = 7",
    "rules": """SELECT DISTINCT 'class' AS scope, p_brand AS key, 'label' AS prop, 'Class ' || p_brand AS value FROM part
        UNION ALL SELECT DISTINCT 'class', p_brand, 'colour', lower(p_brand) FROM part
        UNION ALL SELECT 'id', p_partkey::VARCHAR, 'label', 'Part ' || p_partkey FROM part WHERE p_partkey % 13 = 0""",
    "lnglat": "SELECT c_custkey AS id, ((c_custkey * 7919) % 360 - 180)::DOUBLE AS lng, ((c_custkey * 104729) % 160 - 80)::DOUBLE AS lat FROM customer",
    "triples": """SELECT 'N:' || n_nationkey AS s, 'label' AS p, n_name AS o FROM nation UNION ALL SELECT 'N:' || n_nationkey, 'partOf', 'R:' || n_regionkey FROM nation
        UNION ALL SELECT 'S:' || s_suppkey, 'locatedIn', 'N:' || s_nationkey FROM supplier UNION ALL SELECT 'S:' || s_suppkey, 'label', s_name FROM supplier WHERE s_suppkey % 2 = 0""",
    "drawn_tags": """SELECT page_id, 'href' AS tag, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS value FROM pages
        UNION ALL SELECT page_id, 'title', unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1)) FROM pages""",
}


def with_frames(*names: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + body
