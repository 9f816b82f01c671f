"""Scalar functions over frames of names, keys and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, markup, pathtype, text, tiles
from . import frames
from .frames import table, with_frames


def sc1_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frames.markup(spark, sf_dir)
    p = markup.parsed(F.col("markup"))
    return m.select(F.col("id").alias("shape"), p["id"].alias("id"), p["class"].alias("class"), F.array_join(p["flags"], ",").alias("flags"), p["details"].alias("details"), p["maxzoom"].cast("string").alias("maxzoom"), p["warning"].alias("warning"), p["error"].alias("error"))


SC1 = with_frames("markup", body="""
SELECT id AS shape, nullif(regexp_extract(markup, '\\bid\\(([^()]*)\\)', 1), '') AS id, nullif(regexp_extract(markup, '\\bclass\\(([^()]*)\\)', 1), '') AS class,
  array_to_string(list_sort(list_filter(['marker', 'node', 'styling'], lambda w: regexp_matches(markup, ' ' || w || '( |$)'))), ',') AS flags,
  nullif(regexp_extract(markup, 'details\\((D\\d+), ', 1), '') AS details, (try_cast(nullif(regexp_extract(markup, 'details\\(D\\d+, (\\d+)', 1), '') AS INTEGER) - 1)::VARCHAR AS maxzoom,
  CASE WHEN markup LIKE '% marker%' THEN 'Deprecated `marker`' END AS warning,
  CASE WHEN markup LIKE '% styling%' THEN '''styling'' element can''t have an ''id'' nor ''class''' WHEN markup LIKE '%path(%' THEN 'Syntax error' END AS error
FROM markup""")


def sc2_layer_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    note = F.concat(F.lit(".id(L"), k, F.lit(") models(UBERON:"), k, F.lit(")"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" zoom(1, "), F.col("p_size").cast("string"), F.lit(", 9)"))).otherwise(""), F.when(F.col("p_size") % 7 == 0, " ???").otherwise(""))
    d = markup.layer_directive(F.col("note"))
    return p.select("p_partkey", note.alias("note")).select("p_partkey", d["id"].alias("id"), d["models"].alias("models"), F.array_join(d["zoom"].cast("array<string>"), ",").alias("zoom"), d["error"].alias("error"))


SC2 = """SELECT p_partkey, 'L' || p_partkey AS id, 'UBERON:' || p_partkey AS models, CASE WHEN p_size % 2 = 0 THEN '1,' || p_size || ',9' END AS zoom,
  CASE WHEN p_size % 7 = 0 THEN 'Syntax error in layer directive' END AS error FROM part"""


def sc4_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List and route texts, their groups and ends (SC-4, 5)."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    texts = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.concat(k, F.lit(", (,")))
                     .when(F.col("o_orderkey") % 3 == 0, F.concat(k, F.lit(" , ("), c, F.lit(", X"), k, F.lit(" ), "), c))
                     .otherwise(F.concat(k, F.lit(","), c)).alias("t"))
    rows = texts.select("o_orderkey", markup.id_list(F.col("t")).alias("ids"), markup.route_list(F.col("t")).alias("groups"))
    r = markup.route(F.col("groups"))
    return rows.select("o_orderkey", F.array_join("ids", "|").alias("ids"), F.array_join(r["start_nodes"], "|").alias("start_nodes"), F.array_join(r["through_nodes"], "|").alias("through_nodes"), F.array_join(r["end_nodes"], "|").alias("end_nodes"))


SC4 = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey || '|' || o_custkey END AS ids,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey::VARCHAR END AS start_nodes,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_custkey || '|X' || o_orderkey ELSE '' END AS through_nodes,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey::VARCHAR END AS end_nodes FROM orders"""


def sc7_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CURIEs, normalised, decoded, short and readable ids (SC-7..11)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    uri = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("http://purl.obolibrary.org/obo/UBERON_"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("http://uri.interlex.org/base/ilx_"), k)).otherwise(F.concat(F.lit("http://example.org/"), k))
    spaces = {"http://purl.obolibrary.org/obo/UBERON_": "UBERON", "http://uri.interlex.org/base/ilx_": "ILX"}
    escaped = F.concat(F.lit("a_x2E_b_"), k, F.lit("_x28_c_"), k, F.lit("_"))
    return p.select("p_partkey", text.curie(uri, spaces).alias("curie"), text.normalised_id(F.concat(F.lit("UBERON:000"), k, F.lit(":000"))).alias("normalised"), text.decoded_id(escaped).alias("decoded"), text.short_id(F.concat(F.lit("layer/SHAPE_"), k)).alias("short"), text.readable(F.concat(F.lit("left-lung_"), k)).alias("readable"), text.css_class(F.col("p_brand")).alias("css"))


SC7 = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'UBERON:' || p_partkey WHEN 1 THEN 'ILX:' || p_partkey ELSE 'http://example.org/' || p_partkey END AS curie,
  'UBERON:' || p_partkey || ':0' AS normalised, 'a.b ' || p_partkey || '(c' AS decoded, 'ID-' || lpad(p_partkey::VARCHAR, 8, '0') AS short,
  'Left Lung ' || p_partkey AS readable, lower(regexp_replace(p_brand, '[^A-Za-z0-9\\-]', '-', 'g')) AS css FROM part"""


def sc12_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    unit = F.element_at(F.array(*map(F.lit, ["px", "in", "cm", "mm", "pt", "pc", "%", "parsec"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = p.select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("t"))
    return rows.select("p_partkey", F.round(text.pixels(F.col("t"), F.lit(200.0)), 6).alias("pixels"), F.round(text.points(F.col("t")), 6).alias("points"))


SC12 = """WITH u AS (SELECT p_partkey, p_size * CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 96 WHEN 2 THEN 96 / 2.54::DOUBLE WHEN 3 THEN 96 / 25.4::DOUBLE
  WHEN 4 THEN 4 / 3::DOUBLE WHEN 5 THEN 16 END AS px,
    CASE WHEN p_partkey % 8 = 6 THEN p_size * 2.0::DOUBLE END AS share FROM part)
SELECT p_partkey, round(coalesce(px, share), 6) AS pixels, round(px * 0.75, 6) AS points FROM u"""


def sc13_path_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, names and kinds from phenotypes, and drawn styles (SC-13, 34, WN-13)."""
    o = table(spark, sf_dir, "orders")
    names = F.array(*map(F.lit, ["ilxtr:Other", *pathtype.PHENOTYPES]))
    pick = lambda m: F.element_at(names, (F.col("o_orderkey") * m % 14 + 1).cast("int"))
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("style"), F.array(pick(3), pick(5), pick(7)).alias("phenotypes")).withColumn("code", pathtype.from_phenotypes(F.col("phenotypes")))
    rows = rows.withColumn("base", F.col("code").bitwiseAND(F.lit(31)))
    return rows.select("o_orderkey", "code", pathtype.name(F.col("code")).alias("name"), pathtype.viewer_kind(F.col("code")).alias("kind"), pathtype.is_dashed(F.col("code")).alias("dashed"), pathtype.drawn(F.col("base"), F.when(F.col("o_orderkey") % 2 == 0, "dashDot").otherwise("solid")).alias("drawn"))


_CODES = "[0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 32, 64]"
_NAMES = "['unknown', 'central nervous system', 'enteric', 'excitatory', 'inhibitory', 'intestinal', 'intracardiac', 'motor', 'parasympathetic', 'sensory', 'spinal ascending', 'spinal descending', 'sympathetic']"
_KINDS = "['unknown', 'cns', 'enteric', 'excitatory', 'inhibitory', 'intestinal', 'intracardiac', 'somatic', 'para', 'sensory', 'cns', 'cns', 'symp']"
SC13 = f"""WITH p AS (SELECT o_orderkey, [{_CODES}[o_orderkey * 3 % 14 + 1], {_CODES}[o_orderkey * 5 % 14 + 1], {_CODES}[o_orderkey * 7 % 14 + 1]] AS c FROM orders),
q AS (SELECT o_orderkey, coalesce(list_filter(c, lambda x: x BETWEEN 1 AND 31)[1], 1) AS t, coalesce(list_filter(c, lambda x: x > 31)[1], 0) AS o FROM p)
SELECT o_orderkey, (t + o)::INTEGER AS code, CASE o WHEN 32 THEN 'post-ganglionic ' WHEN 64 THEN 'pre-ganglionic ' ELSE '' END || {_NAMES}[t + 1] AS name,
  {_KINDS}[t + 1] || CASE o WHEN 32 THEN '-post' WHEN 64 THEN '-pre' ELSE '' END AS kind, o = 32 AS dashed,
  (CASE WHEN t IN (8, 12) THEN t + CASE WHEN o_orderkey % 2 = 0 THEN 64 ELSE 32 END ELSE t END)::INTEGER AS drawn FROM q"""


def sc14_node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node names, nerve texts, system names (SC-14, 31, 35, 37)."""
    n = table(spark, sf_dir, "nation")
    r = F.array(F.concat(F.lit("R:"), F.col("n_regionkey").cast("string")), F.lit("ROOT"))
    return n.select("n_nationkey", text.node_name(F.col("n_name"), r).alias("name"), text.full_name(F.col("n_name"), r).alias("full_name"), text.capitalised(text.nerve_text(F.concat(F.lit("vagus n. "), "n_name"))).alias("nerve"), text.is_system_name(F.col("n_name")).alias("system"), text.dataset_link(F.concat(F.lit("https://example.org/datasets/"), F.col("n_nationkey").cast("string"), F.lit("/versions/2/x"))).alias("dataset"))


SC14 = """SELECT n_nationkey, 'ROOT/R:' || n_regionkey || '/' || n_name AS name, n_name || ' in R:' || n_regionkey || ', ROOT' AS full_name, 'Vagus nerve ' || n_name AS nerve,
  length(n_name) > 6 AND n_name = upper(n_name) AS system, 'dataset/' || n_nationkey || '/2' AS dataset FROM nation"""


def sc16_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map composed, applied and inverted again (SC-16)."""
    p = frames.points(spark, sf_dir)
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    m = geometry.compose(lit(2, 0, 0, 3, 10, -5), lit(0, -1, 1, 0, 4, 7))
    x, y = geometry.apply(m, F.col("x"), F.col("y"))
    u, v = geometry.apply(geometry.invert(m), x, y)
    return p.select("id", x.alias("tx"), y.alias("ty"), F.round(u, 6).alias("back_x"), F.round(v, 6).alias("back_y"))


SC16 = with_frames("points", body=" SELECT id, (2 * (4 - y) + 10)::DOUBLE AS tx, (3 * (x + 7) - 5)::DOUBLE AS ty, x::DOUBLE AS back_x, y::DOUBLE AS back_y FROM points")


def sc17_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.lnglat(spark, sf_dir)
    x, y = geometry.to_metres(F.col("lng"), F.col("lat"))
    lng, lat = geometry.to_lnglat(x, y)
    return rows.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(lng, 6).alias("lng"), (F.round(lat, 6) + 0.0).alias("lat"))


SC17 = with_frames("lnglat", body=" SELECT id, round(radians(lng) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) + 0.0 AS y, lng, lat FROM lnglat")


def sc18_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, scales, proxy dots and radii of boxes (SC-18..20, 26, 27, 39)."""
    f = frames.features(spark, sf_dir)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    ring = F.array(*[F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"))])
    m = geometry.shape_metrics(geometry.ring_area(ring), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(4_004_000.0))
    dx, dy, radius = geometry.proxy_dot(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("id") % 4)
    return f.select("id", *[F.round(v, 6).alias(k) for k, v in m.items()], F.round(geometry.feature_scale(F.lit(4_004_000.0), area), 6).alias("scale"), F.round(dx, 6).alias("dot_x"), F.round(dy, 6).alias("dot_y"), F.round(radius, 6).alias("dot_r"), F.round(geometry.path_length(ring), 6).alias("length"))


SC18 = with_frames("features", body="""
, b AS (SELECT *, (x1 - x0)::DOUBLE AS w, (y1 - y0)::DOUBLE AS h FROM features)
SELECT id, round(least(w, h) / greatest(w, h), 6) AS aspect, 0.5::DOUBLE AS coverage, round(w * h / 4004000, 6) AS bbox_coverage, round(log2(sqrt(4004000 / (w * h))), 6) AS scale,
  round(CASE WHEN w >= h THEN x0 + (0.8::DOUBLE - 0.15::DOUBLE * (id % 4)) * w ELSE (x0 + x1) / 2.0::DOUBLE END, 6) AS dot_x,
  round(CASE WHEN w >= h THEN (y0 + y1) / 2.0::DOUBLE ELSE y0 + (0.8::DOUBLE - 0.15::DOUBLE * (id % 4)) * h END, 6) AS dot_y, round(least(greatest(w, h) / 16, 1000),
  6) AS dot_r, w + h AS length FROM b""")


def sc15_map_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic UUIDs; the oracle rebuilds them from the same digest by text (SC-15)."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("https://example.org/map/"), F.col("o_orderkey").cast("string"))).alias("uuid"))


SC15 = """WITH d AS (SELECT o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('https://example.org/map/' || o_orderkey)::BLOB) AS h FROM orders)
SELECT o_orderkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][instr('0123456789abcdef', h[17:17])::INTEGER % 4 + CASE
  WHEN instr('0123456789abcdef', h[17:17]) % 4 = 0 THEN 4 ELSE 0 END] || h[18:20] || '-' || h[21:32] AS uuid FROM d"""


def tl3_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile, key and stored row of each place at zoom 10 (TL-1, 2, 3, 7)."""
    rows = frames.lnglat(spark, sf_dir).select("id", tiles.tile_x(F.col("lng"), 10).alias("x"), tiles.tile_y(F.col("lat"), 10).alias("y"))
    west, south, east, north = tiles.tile_bounds(F.col("x"), F.col("y"), 10)
    return rows.select("id", "x", "y", tiles.quadkey(F.col("x"), F.col("y"), 10).alias("quadkey"), tiles.flipped(F.col("y"), F.lit(10)).alias("row"), F.round(west, 6).alias("west"), F.round(north, 6).alias("north"))


TL3 = with_frames("lnglat", body="""
, t AS (SELECT id, floor((lng + 180) / 360 * 1024)::INTEGER AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024)::INTEGER AS y FROM lnglat)
SELECT id, x, y, array_to_string(list_transform(range(9, -1, -1), lambda k: (((x >> k) & 1) + 2 * ((y >> k) & 1))::VARCHAR), '') AS quadkey, (1023 - y)::INTEGER AS row,
  round(x / 1024::DOUBLE * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 1024::DOUBLE)))), 6) AS north FROM t""")


def tl5_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places each tile has at zooms 10 down to 0 (TL-5)."""
    from ..operators.tiling import pyramid

    rows = frames.lnglat(spark, sf_dir).select(tiles.tile_x(F.col("lng"), 10).alias("x"), tiles.tile_y(F.col("lat"), 10).alias("y"))
    return pyramid(rows.groupBy("x", "y").agg(F.count("*").alias("n")), 10, 0)


TL5 = with_frames("lnglat", body="""
, t AS (SELECT floor((lng + 180) / 360 * 1024)::INTEGER AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024)::INTEGER AS y FROM lnglat)
SELECT z::INTEGER AS zoom, (x >> (10 - z))::INTEGER AS x, (y >> (10 - z))::INTEGER AS y, count(*) AS n FROM t, (SELECT unnest(range(0, 11)) AS z) GROUP BY ALL""")


def jn24_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first palette entry within the threshold of each part's colour; distinct colours are compared once."""
    from ..operators.classify import palette_join

    k = F.col("p_partkey")
    shades = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("#"), F.lpad(F.lower(F.hex(k * 7919 % 256)), 2, "0"), F.lpad(F.lower(F.hex(k % 16 * 16)), 2, "0"), F.lit("23")).alias("colour"))
    palette = spark.createDataFrame([(0, "#FF0000", "red"), (1, "#548235", "green"), (2, "#0070C0", "blue"), (3, "#EA3323", "red")], "ord int, colour string, kind string")
    return palette_join(shades, palette, "other").select("id", "kind")


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) END AS {c}"


def _root(t: str, c: str) -> str:
    return f"CASE WHEN {t} > 0.008856451679035631::DOUBLE THEN cbrt({t}) ELSE {t} * 7.787037037037035::DOUBLE + 4 / 29.0::DOUBLE END AS {c}"


_SEVENTH = "sqrt(pow({0}, 7::DOUBLE) / (pow({0}, 7::DOUBLE) + pow(25::DOUBLE, 7::DOUBLE)))"
_HUE = "CASE WHEN {a} = 0 AND {b} = 0 THEN 0 ELSE (degrees(atan2({b}, {a})) + 360) % 360 END"
JN24 = f"""WITH u AS (SELECT p_partkey AS id, (p_partkey * 7919 % 256)::DOUBLE AS r, (p_partkey % 16 * 16)::DOUBLE AS g, 35::DOUBLE AS b FROM part),
e AS (SELECT * FROM (VALUES (0, 255::DOUBLE, 0::DOUBLE, 0::DOUBLE, 'red'), (1, 84, 130, 53, 'green'), (2, 0, 112, 192, 'blue'), (3, 234, 51, 35, 'red')) t(ord, r, g, b, kind)),
k AS (SELECT DISTINCT -1 AS ord, r AS cr, g AS cg, '' AS kind, r, g, b FROM u UNION ALL SELECT ord, 0, 0, kind, r, g, b FROM e), i AS (SELECT ord, cr, cg, kind,
  {_linear('r')}, {_linear('g')}, {_linear('b')} FROM k),
x AS (SELECT *, (0.4124564::DOUBLE * r + 0.3575761::DOUBLE * g + 0.1804375::DOUBLE * b) / 0.95047::DOUBLE AS x,
  0.2126729::DOUBLE * r + 0.7151522::DOUBLE * g + 0.0721750::DOUBLE * b AS y, (0.0193339::DOUBLE * r + 0.1191920::DOUBLE * g + 0.9503041::DOUBLE * b) / 1.08883::DOUBLE AS z FROM i),
f AS (SELECT ord, cr, cg, kind, {_root('x', 'fx')}, {_root('y', 'fy')}, {_root('z', 'fz')} FROM x), lab AS (SELECT ord, cr, cg, kind, 116 * fy - 16 AS l,
  500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM f),
p AS (SELECT s.cr, s.cg, t.ord, t.kind, s.l AS l1, t.l AS l2, s.a AS a1, t.a AS a2, s.b AS b1, t.b AS b2, (sqrt(s.a ** 2 + s.b ** 2) + sqrt(t.a ** 2 + t.b ** 2)) / 2 AS m
  FROM lab s JOIN lab t ON s.ord < 0 AND t.ord >= 0),
q AS (SELECT * EXCLUDE (a1, a2), a1 * (1.5 - 0.5 * {_SEVENTH.format('m')}) AS a1, a2 * (1.5 - 0.5 * {_SEVENTH.format('m')}) AS a2 FROM p),
h AS (SELECT *, sqrt(a1 ** 2 + b1 ** 2) AS c1, sqrt(a2 ** 2 + b2 ** 2) AS c2, {_HUE.format(a='a1', b='b1')} AS h1, {_HUE.format(a='a2', b='b2')} AS h2 FROM q),
d AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, (l1 + l2) / 2 - 50 AS ml, (c1 + c2) / 2 AS mc,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh FROM h),
w AS (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63)) AS t,
  2 * sqrt(c1 * c2) * sin(radians(dh) / 2) AS big_h FROM d),
v AS (SELECT cr, cg, ord, kind, (l2 - l1) / (1 + 0.015 * ml * ml / sqrt(20 + ml * ml)) AS x, (c2 - c1) / (1 + 0.045 * mc) AS y, big_h / (1 + 0.015 * mc * t) AS z,
  -2 * sin(radians(60 * exp(-pow((mh - 275) / 25, 2::DOUBLE)))) * {_SEVENTH.format('mc')} AS r FROM w),
n AS (SELECT cr, cg, arg_min(kind, ord) AS kind FROM v WHERE sqrt(x * x + y * y + z * z + r * y * z) < 6 GROUP BY cr, cg)
SELECT id, coalesce(kind, 'other') AS kind FROM u LEFT JOIN n ON cr = u.r AND cg = u.g"""

QUERIES = {f.__name__: f for f in (sc1_markup, sc2_layer_directive, sc4_lists, sc7_identifiers, sc12_lengths, sc13_path_types, sc14_node_names, sc15_map_uuid, sc16_affine, sc17_mercator, sc18_metrics, tl3_tiles, tl5_pyramid, jn24_palette)}
ORACLE_SQL = {"sc1_markup": SC1, "sc2_layer_directive": SC2, "sc4_lists": SC4, "sc7_identifiers": SC7, "sc12_lengths": SC12, "sc13_path_types": SC13, "sc14_node_names": SC14, "sc15_map_uuid": SC15, "sc16_affine": SC16, "sc17_mercator": SC17, "sc18_metrics": SC18, "tl3_tiles": TL3, "tl5_pyramid": TL5, "jn24_palette": JN24}
