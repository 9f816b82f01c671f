"""Detail layers, groups, functional components and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import details
from . import frames
from .frames import table, with_frames

BOX = ["x0", "y0", "x1", "y1"]


def _part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return table(spark, sf_dir, "part"), F.col("p_partkey")


def _pick(values: tuple[str, ...], k) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def flt3_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return details.connected_only(table(spark, sf_dir, "orders").select(k.alias("path"), F.when(k % 3 > 0, k % 3 == 1).alias("path_disconnected"))).select("path")


FLT3 = "SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 3 <> 1"


def flt10_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as elements three deep: in their brand, in their size."""
    p, k = _part(spark, sf_dir)
    at = F.array(F.col("p_size"), (k % 7).cast("int"), k.cast("int"))
    leaves = p.select(k.alias("id"), at.alias("at"), F.col("p_brand").alias("layer"), _pick(("path", "rect", "text"), k).alias("kind"), F.when(k % 11 == 0, F.lit(True)).alias("exclude"))
    groups = p.select(F.col("p_size").alias("s")).distinct().select((-F.col("s") - 1).cast("long").alias("id"), F.array("s").alias("at"), F.lit("group").alias("layer"), F.lit("g").alias("kind"), (F.col("s") % 5 == 0).alias("exclude"))
    return details.display_copy(leaves.unionByName(groups), ["Brand#11", "Brand#12"], ["text"]).select("id")


FLT10 = """SELECT p_partkey AS id FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') AND p_partkey % 3 <> 2 AND p_partkey % 11 <> 0 AND p_size % 5 <> 0
UNION ALL SELECT DISTINCT -p_size - 1 FROM part WHERE p_size % 5 <> 0"""


def flt15_centrelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    f = p.select(F.when(k % 13 > 0, k).alias("id"), F.col("p_brand").alias("layer"), (k % 2 == 0).alias("centreline"), F.when(k % 5 == 0, F.lit(True)).alias("exclude"))
    return details.drawn_centrelines(f, p.where("p_size > 40").select(F.col("p_brand").alias("layer")))


FLT15 = """SELECT p_partkey AS id, p_brand AS layer, 'centreline' AS kind, 'centreline' AS type FROM part
WHERE p_partkey % 13 > 0 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0 AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 40)"""


def jn18_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = frames.points(spark, sf_dir).select(F.floor(F.col("id") / 2).alias("line"), (F.col("id") % 2).alias("end"), "x", "y")
    return details.end_components(ends, frames.features(spark, sf_dir).select("id", (F.col("size") % 4 == 0).alias("port"), *BOX), 10)


JN18 = with_frames("points", "features", body=""" SELECT p.id // 2 AS line, p.id % 2 AS "end", arg_min(f.id, (f.size % 4 <> 0, (f.x1 - f.x0) * (f.y1 - f.y0), f.id)) AS terminal, count(*) AS touched
FROM points p JOIN features f ON f.x0 <= p.x + 10 AND f.x1 >= p.x - 10 AND f.y0 <= p.y + 10 AND f.y1 >= p.y - 10 GROUP BY ALL""")


def jn20_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = frames.path_edges(spark, sf_dir).groupBy(F.col("path").alias("line")).agg(F.min("src").alias("source"), F.max("dst").alias("target"))
    p, j = _part(spark, sf_dir)
    return details.line_classes(lines, p.where("p_partkey % 10 < 9").select(j.alias("id"), F.when(j % 4 > 0, _pick(("symp", "para"), j)).alias("class")))


JN20 = with_frames("path_edges", body=""", c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 0 THEN ['symp', 'para'][p_partkey % 2 + 1] END AS c FROM part WHERE p_partkey % 10 < 9),
l AS (SELECT path AS line, min(src) AS s, max(dst) AS t FROM path_edges GROUP BY path)
SELECT line, CASE WHEN a.c IS NULL OR b.c IS NULL OR a.c = b.c THEN coalesce(a.c, b.c) END AS class, CASE WHEN a.c <> b.c THEN a.c || ' and ' || b.c END AS issue
FROM l LEFT JOIN c a ON a.id = s LEFT JOIN c b ON b.id = t""")


def jn28_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    units = s.select(k.alias("unit"), (k % 5).alias("model"), _pick(("symp-pre", "para-post", "sensory"), k).alias("path_type"))
    line = table(spark, sf_dir, "lineitem")
    j = F.col("l_partkey")
    children = line.select(F.col("l_suppkey").alias("unit"), j.alias("child"), _pick(("unit", "connector"), j).alias("kind"), (j % 7).alias("model"), _pick(("symp-post", "para-pre", "motor", "sensory"), j).alias("path_type"))
    return details.unit_children(units, children)


JN28 = """WITH c AS (SELECT l_suppkey AS unit, l_partkey AS child, CASE WHEN l_partkey % 2 = 0 AND l_partkey % 7 = l_suppkey % 5 THEN 0
WHEN l_partkey % 2 = 1 AND ['symp', 'para', 'motor', 'sensory'][l_partkey % 4 + 1] = ['symp', 'para', 'sensory'][l_suppkey % 3 + 1] THEN 1 END AS rank FROM lineitem)
SELECT unit, child, rank::INTEGER AS rank FROM (SELECT DISTINCT * FROM c WHERE rank IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY rank, child) = 1"""


def gr16_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in nations in regions; some nations are organs, regions are systems."""
    kinds = frames.subclass(spark, sf_dir).select(F.col("child").alias("id")).where("id not like 'C:%'")
    number = F.substring("id", 3, 9).try_cast("int")
    kinds = kinds.select("id", F.when(F.col("id").startswith("R:"), "system").when(number % 4 == 0, "organ").otherwise("component").alias("kind"))
    return details.ensured_systems(frames.subclass(spark, sf_dir).toDF("id", "parent"), kinds)


GR16 = """SELECT 'C:' || c_custkey AS id, 'R:' || n_regionkey AS system FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 4 <> 0
UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation"""


def jn35_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers open detail layers, parts are associated with them, orders run through parts."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    line = table(spark, sf_dir, "lineitem")
    layers = line.groupBy((F.col("l_suppkey") % 20).alias("n")).agg(F.collect_set("l_partkey").alias("associated")).select(F.concat(F.lit("D"), "n").alias("layer"), "associated")
    tagged = details.attached_details(s.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("D"), k % 20)).alias("details")), layers, line.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("connection")))[1]
    return tagged.withColumn("layers", F.array_join("layers", ","))


JN35 = """WITH o AS (SELECT DISTINCT 'D' || s_suppkey % 20 AS d FROM supplier WHERE s_suppkey % 3 = 0), m AS (SELECT DISTINCT 'D' || l_suppkey % 20 AS d, l_partkey AS id FROM lineitem),
t AS (SELECT DISTINCT l_orderkey AS connection, d FROM o JOIN m USING (d) JOIN lineitem ON l_partkey = id) SELECT connection, string_agg(d, ',' ORDER BY d) AS layers FROM t GROUP BY connection"""


def jn36_replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as hosts of detail layers of parts, some of which open the next layer, to the last."""
    s, k = frames.containers(spark, sf_dir), F.col("id")
    f = frames.features(spark, sf_dir).withColumn("layer", k % 10)
    member = f.select("layer", "id", F.when((k % 29 == 0) & (k % 10 < 9), k % 10 + 1).alias("details"), *BOX)
    edge = f.groupBy("layer").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    rows = details.replicated(s.select(k.alias("host"), (k % 10).alias("layer"), *BOX), edge, member)
    return rows.select("host", "path", "id", *[F.round(c, 6).alias(c) for c in BOX])


JN36 = with_frames("features", "containers", recursive=True, body=""", m AS (SELECT id % 10 AS layer, id, CASE WHEN id % 29 = 0 AND id % 10 < 9 THEN id % 10 + 1 END AS d,
  x0, y0, x1, y1 FROM features),
e AS (SELECT layer, min(x0) AS p, min(y0) AS q, (max(x1) - min(x0))::DOUBLE AS w, (max(y1) - min(y0))::DOUBLE AS h FROM m GROUP BY layer),
r AS (SELECT id AS host, '' AS path, id, id % 10 AS d, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, 0 AS k FROM containers
  UNION ALL SELECT host, path || '/' || m.id, m.id, m.d, r.x0 + (m.x0 - p) * (r.x1 - r.x0) / w, r.y0 + (m.y0 - q) * (r.y1 - r.y0) / h,
  r.x0 + (m.x1 - p) * (r.x1 - r.x0) / w, r.y0 + (m.y1 - q) * (r.y1 - r.y0) / h, k + 1
  FROM r JOIN m ON m.layer = r.d JOIN e ON e.layer = r.d)
SELECT host, path, id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM r WHERE k > 0""")


def jn37_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _part(spark, sf_dir)
    return details.layer_offsets(p.select(F.col("p_brand").alias("layer"), k.alias("feature"), (k - k % 10).alias("base")), frames.features(spark, sf_dir))


JN37 = with_frames("features", body=""" SELECT f.class AS layer, (min(b.x0) + max(b.x1)) / 2 - (min(f.x0) + max(f.x1)) / 2 AS dx, (min(b.y0) + max(b.y1)) / 2 - (min(f.y0) + max(f.y1)) / 2 AS dy
FROM features f JOIN features b ON b.id = f.id - f.id % 10 GROUP BY f.class""")


def ag19_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return details.organ_systems(c.select(F.concat(F.lit("organ"), F.col("c_custkey") % 50).alias("organ"), F.col("c_mktsegment").alias("system")))


AG19 = "SELECT organ, string_agg(s, ', ' ORDER BY s) AS systems FROM (SELECT DISTINCT 'organ' || c_custkey % 50 AS organ, c_mktsegment AS s FROM customer) GROUP BY organ"


def ag22_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = frames.features(spark, sf_dir), F.col("id")
    group = F.floor(k / 3)
    return details.merged_groups(f.select("id", group.alias("group"), F.when(k % 17 == 0, "port").otherwise("component").alias("kind"), (group % 4 + F.when(k % 13 == 0, 1).otherwise(0)).alias("colour"), F.when(k % 4 == 0, F.col("name")).otherwise("").alias("name"), *BOX))


AG22 = with_frames("features", body=""" SELECT id // 3 AS "group", min(CASE WHEN id % 4 = 0 THEN name END) AS name, count(*) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
FROM features GROUP BY id // 3 HAVING bool_and(id % 17 <> 0) AND count(DISTINCT (id % 13 = 0)) = 1 AND count(DISTINCT CASE WHEN id % 4 = 0 THEN nullif(name, '') END) <= 1""")


def ag26_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("neuron"), F.concat(F.lit("p"), F.col("l_partkey") % 3).alias("phenotype"))
    labels = table(spark, sf_dir, "region").select(F.element_at(F.array(*map(F.lit, ("p0", "p1", "p0|p1", "p1|p2", "p9"))), (F.col("r_regionkey") + 1).cast("int")).alias("key"), F.concat(F.lit("label "), "r_regionkey").alias("label"))
    return details.phenotype_labels(line, labels)


AG26 = """WITH s AS (SELECT neuron, string_agg(p, '|' ORDER BY p) AS key, '["' || string_agg(p, '","' ORDER BY p) || '"]' AS j FROM (SELECT DISTINCT l_orderkey AS neuron,
  'p' || l_partkey % 3 AS p FROM lineitem) GROUP BY neuron)
SELECT neuron, coalesce('label ' || (list_position(['p0', 'p1', 'p0|p1', 'p1|p2'], key) - 1), j) AS label FROM s"""


def ag27_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.features(spark, sf_dir).select(F.col("model").alias("group"), _pick(("line", "polygon", "point"), F.col("id")).alias("geometry"), *BOX, "class")
    p, k = _part(spark, sf_dir)
    return details.group_outlines(f, p.where("p_partkey % 40 = 0").groupBy(F.col("p_type").alias("group")).agg(F.max("p_name").alias("class")))


AG27 = with_frames("features", body=""", d AS (SELECT model AS g, max(name) AS c FROM features WHERE id % 40 = 0 GROUP BY model)
SELECT model AS "group", count(*) AS members, count(*) FILTER (WHERE id % 3 = 0) AS lines, count(*) FILTER (WHERE id % 3 = 1) AS polygons, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
coalesce(any_value(c), min(class)) AS class FROM features LEFT JOIN d ON g = model GROUP BY model""")


def wn9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_suppkey").alias("s"))
    parts = line.select(F.col("l_orderkey").alias("label"), F.col("l_partkey").alias("seq"), F.concat(F.lit("t"), F.col("l_partkey") % 10).alias("text"), (F.col("s") % 7).cast("double").alias("baseline"))
    return details.label_text(parts, 2.0)


WN9 = """WITH p AS (SELECT l_orderkey AS label, l_partkey AS seq, 't' || l_partkey % 10 AS t, min(l_suppkey) % 7 AS b FROM lineitem GROUP BY ALL), q AS (SELECT *,
  b - first(b) OVER (PARTITION BY label ORDER BY seq) AS r FROM p)
SELECT label, string_agg(CASE WHEN r > 2 THEN '^{' || t || '}' WHEN r < -2 THEN '_{' || t || '}' ELSE t END, '' ORDER BY seq) AS text FROM q GROUP BY label"""


def sc22_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in others by number; paint and connectors by number too."""
    p, k = _part(spark, sf_dir)
    paint = F.when(k % 50 == 0, "system").when(k % 10 == 0, "organ").otherwise(_pick(("plain", "vascular", "nerve", "vessel"), k))
    shapes = p.select(k.alias("id"), paint.alias("paint"), F.when(k % 6 == 1, "neural").when(k % 6 == 2, "joiner").alias("connector"))
    parent = F.when(k % 10 > 4, k - 2).otherwise(k - k % 10)
    return details.functional_class(shapes, p.where("p_partkey % 10 > 0").select(k.alias("id"), parent.alias("parent")))


SC22 = """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN 'system' WHEN p_partkey % 10 = 0 THEN 'organ' ELSE ['plain', 'vascular', 'nerve',
  'vessel'][p_partkey % 4 + 1] END AS paint, p_partkey % 6 = 1 AS port,
CASE WHEN p_partkey % 10 > 4 THEN p_partkey - 2 WHEN p_partkey % 10 > 0 THEN p_partkey - p_partkey % 10 END AS parent FROM part),
u AS (SELECT *, paint <> 'system' AND EXISTS (SELECT 1 FROM s c WHERE c.parent = s.id AND c.port) AS unit FROM s),
o AS (SELECT *, paint = 'organ' OR (paint <> 'system' AND EXISTS (SELECT 1 FROM u c WHERE c.parent = u.id AND c.unit)) AS organ FROM u),
r AS (SELECT o.*, EXISTS (SELECT 1 FROM o q WHERE q.id = o.parent AND q.organ AND NOT q.unit AND NOT q.port) AS held FROM o)
SELECT id, CASE WHEN paint = 'system' THEN 'system' WHEN port THEN 'port' WHEN unit THEN 'unit' WHEN organ THEN 'organ' WHEN paint = 'vascular' AND held THEN 'region'
  WHEN paint IN ('nerve', 'vessel') THEN paint ELSE 'conduit' END AS class FROM r"""


def sc23_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' diagonals against those of the parts before them."""
    f = frames.features(spark, sf_dir).select("id", *BOX)
    a, b = f.toDF("a", "ax0", "ay0", "ax1", "ay1"), f.select((F.col("id") + 1).alias("a"), F.col("id").alias("b"), *[F.col(c).alias(f"b{c}") for c in BOX])
    return details.line_tests(a.join(b, "a"))


SC23 = with_frames("features", body=""", p AS (SELECT f.id AS a, g.id AS b, f.x0 AS p, f.y0 AS q, f.x1 - f.x0 AS dx, f.y1 - f.y0 AS dy, g.x0 AS r, g.y0 AS s,
  g.x1 - g.x0 AS ex, g.y1 - g.y0 AS ey FROM features f JOIN features g ON g.id + 1 = f.id),
l AS (SELECT *, sqrt(dx ** 2 + dy ** 2) AS la, sqrt(ex ** 2 + ey ** 2) AS lb, dx * ey - dy * ex AS c, ((r - p) * dx + (s - q) * dy) / sqrt(dx ** 2 + dy ** 2) AS u,
  ((r + ex - p) * dx + (s + ey - q) * dy) / sqrt(dx ** 2 + dy ** 2) AS v FROM p)
SELECT a, b, sign(dx * (s - q) - dy * (r - p)) * sign(dx * (s + ey - q) - dy * (r + ex - p)) <= 0
  AND sign(ex * (q - s) - ey * (p - r)) * sign(ex * (q + dy - s) - ey * (p + dx - r)) <= 0 AND c <> 0 AS crosses,
abs(c) < 1e-3 * la * lb AS parallel, round(greatest(least(greatest(u, v), la) - greatest(least(u, v), 0), 0), 6) AS overlap, round(abs((r - p) * dy - (s - q) * dx) / la, 6) AS separation FROM l""")


def sc25_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of up to 25,000 pixels; every seventh has no rule."""
    p, k = _part(spark, sf_dir)
    rule = F.when(k % 7 > 0, _pick(("width", "height", "mean", "smallest", "largest"), k))
    scale = details.fitted_scale(rule, (k % 60 + 5).cast("double"), (k % 45 + 5).cast("double"), F.lit(20.0), F.lit(30.0))
    return p.select(k.alias("id"), F.round(details.metres_per_pixel(k * 7919 % 25_000, k * 31 % 9000), 6).alias("metres"), F.round(scale, 6).alias("scale"))


SC25 = """WITH p AS (SELECT p_partkey AS k, (p_partkey % 60 + 5) / 20.0::DOUBLE AS a, (p_partkey % 45 + 5) / 30.0::DOUBLE AS b, greatest(p_partkey * 7919 % 25000,
  p_partkey * 31 % 9000) AS side FROM part)
SELECT k AS id, round(5000000 / coalesce(list_min(list_filter([50, 100, 200, 500, 1000, 2000, 5000, 10000], lambda s: s > side)), 20000)::DOUBLE, 6) AS metres,
round(CASE WHEN k % 7 = 0 THEN greatest(a, b) ELSE [a, b, sqrt(a * a + b * b), least(a, b), greatest(a, b)][k % 5 + 1] END, 6) AS scale FROM p"""


def sc29_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the curve through each supplier's box, its sampled length and the sample nearest to its upper left corner."""
    c = frames.containers(spark, sf_dir)
    points = details.sampled(c.select("id", F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0").alias("y1"), F.col("x0").alias("x2"), F.col("y1").alias("y2"), F.col("x1").alias("x3"), F.col("y1").alias("y3")))
    near = points.join(c.select("id", F.col("x0").alias("u"), F.col("y1").alias("v")), "id")
    d = F.round((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v")), 6)
    return near.groupBy("id").agg(F.min(F.struct(d.alias("d"), "k")).alias("m")).select("id", "m.k", "m.d")


SC29 = with_frames("containers", body=""", s AS (SELECT id, k::INTEGER AS k, k / 100.0::DOUBLE AS t, 1 - k / 100.0::DOUBLE AS w, x0, y0, x1, y1 FROM containers, range(0, 101) r(k)),
p AS (SELECT id, k, x0, y1, w * w * w * x0 + 3 * w * w * t * x1 + 3 * w * t * t * x0 + t * t * t * x1 AS x, w * w * w * y0 + 3 * w * w * t * y0 + 3 * w * t * t * y1 + t * t * t * y1 AS y FROM s),
d AS (SELECT id, k, round((x - x0) * (x - x0) + (y - y1) * (y - y1), 6) AS d FROM p) SELECT id, k, d FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1""")


def sc33_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    changes = e.select(F.col("user_id").alias("id"), k.alias("seq"), _pick(("append", "append", "set", "append", "pop"), k * 7 % 11).alias("op"), F.concat(F.lit("p"), k % 2).alias("prop"), F.concat(F.lit("v"), k % 9).alias("value"))
    return details.property_changes(changes)


SC33 = """WITH c AS (SELECT user_id AS id, event_id AS seq, ['append', 'append', 'set', 'append', 'pop'][event_id * 7 % 11 % 5 + 1] AS op, 'p' || event_id % 2 AS prop,
  'v' || event_id % 9 AS value FROM events),
l AS (SELECT *, max(seq) FILTER (WHERE op IN ('set', 'pop')) OVER (PARTITION BY id, prop) AS last FROM c)
SELECT id, prop, '["' || string_agg(value, '","' ORDER BY seq) || '"]' AS value FROM l WHERE (last IS NULL OR seq >= last) AND op <> 'pop' GROUP BY id, prop"""


def sc38_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' boxes as detail layers, two in three functional, drawn at so many metres a pixel."""
    k = F.col("id")
    return details.margin_boxes(frames.containers(spark, sf_dir).select(k.alias("layer"), _pick(("functional", "anatomical", "functional"), k).alias("kind"), (k % 9 / 2).alias("metres"), *BOX))


SC38 = with_frames("containers", body=""", m AS (SELECT *, 50 * (id % 9 / 2.0::DOUBLE) AS m FROM containers WHERE id % 3 <> 1),
inner_box AS (SELECT id, m, x0 + m AS a, y0 - m AS b, x1 - m AS c, y1 - m AS d FROM m) SELECT id AS layer, a - 2 * m AS x0, b - 2 * m AS y0, c + 2 * m AS x1, d + 2 * m AS y1 FROM inner_box""")


def sc40_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = frames.features(spark, sf_dir), F.col("id")
    lines = f.select(k.alias("line"), (k * 3 % 100).alias("a"), (k * 7 % 100).alias("b"), *BOX)
    return details.directed(lines, f.select("id", F.col("x0").alias("x"), F.col("y0").alias("y")))


SC40 = with_frames("features", body=""" SELECT l.id AS line, least((l.x0 - b.x0) ** 2 + (l.y0 - b.y0) ** 2,
  (l.x1 - a.x0) ** 2 + (l.y1 - a.y0) ** 2) < least((l.x0 - a.x0) ** 2 + (l.y0 - a.y0) ** 2, (l.x1 - b.x0) ** 2 + (l.y1 - b.y0) ** 2) AS reversed
FROM features l JOIN features a ON a.id = l.id * 3 % 100 JOIN features b ON b.id = l.id * 7 % 100""")

_ALL = {
    flt3_connected: FLT3, flt10_display: FLT10, flt15_centrelines: FLT15, jn18_terminals: JN18, jn20_classes: JN20, jn28_children: JN28, gr16_systems: GR16, jn35_details: JN35, jn36_replicated: JN36, jn37_offsets: JN37,
    ag19_systems: AG19, ag22_groups: AG22, ag26_labels: AG26, ag27_outlines: AG27, wn9_labels: WN9, sc22_functional: SC22, sc23_lines: SC23, sc25_scales: SC25, sc29_samples: SC29, sc33_properties: SC33,
    sc38_margins: SC38, sc40_directions: SC40,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items()}
