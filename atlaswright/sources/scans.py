"""Scans of the documents around maps: anatomy, annotations, proxies, groups, connectivity,
contours, logs, indexes, triples and equivalents (SRC-5, 6, 8..11, 15, 17..20)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_dir

IDENTIFIER, PREFERRED, UBERON = "Power point identifier", "Preferred ID", "UBERON ID"


def staged(df: DataFrame, kind: str, **options: str) -> str:
    """Writes ``df`` as files of a kind to a new folder of the shared one; its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/atlaswright-{uuid.uuid4().hex}"
    by = options.pop("partitionBy", None)
    writer = df.write.format(kind).options(**options)
    (writer.partitionBy(by) if by else writer).save(path)
    return path


def anatomical_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: ``(id, term)`` of a sheet; the preferred term, else the other, ``-`` being none.
    A sheet without all three headers has no rows."""
    sheet = spark.read.csv(path, header=True)
    if not {IDENTIFIER, PREFERRED, UBERON} <= set(sheet.columns):
        return spark.createDataFrame([], "id string, term string")
    given = lambda c: F.nullif(F.col(f"`{c}`"), F.lit("-"))
    return sheet.select(F.col(f"`{IDENTIFIER}`").alias("id"), F.coalesce(given(PREFERRED), given(UBERON)).alias("term")).where("term is not null")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: ``(section, name, term, parents)``; parents are split at commas, trimmed, and
    sorted without regard to case."""
    rows = spark.read.schema("section string, name string, term string, parents string").csv(path, header=True)
    parts = F.filter(F.transform(F.split("parents", ","), lambda p: F.trim(p)), lambda p: p != "")
    ordered = F.transform(F.array_sort(F.transform(parts, lambda p: F.struct(F.lower(p).alias("k"), p.alias("p")))), lambda s: s["p"])
    return rows.select("section", "name", "term", ordered.alias("parents"))


def proxies(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: ``(feature, name, seq, proxy)``."""
    return spark.read.schema("feature string, name string, proxies array<string>").json(path).select("feature", "name", F.posexplode("proxies").alias("seq", "proxy"))


def feature_groups(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: ``(layer, group_id, feature)``."""
    rows = spark.read.schema("layer string, groups array<struct<id:string,features:array<string>>>").json(path)
    return rows.select("layer", F.explode("groups").alias("g")).select("layer", F.col("g.id").alias("group_id"), F.explode("g.features").alias("feature"))


def connectivity(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: ``(uri, path, models, nodes)`` of model documents."""
    rows = spark.read.schema("id string, paths array<struct<id:string,models:string,nodes:array<string>>>").json(path)
    return rows.select(F.col("id").alias("uri"), F.explode("paths").alias("p")).select("uri", F.col("p.id").alias("path"), "p.models", "p.nodes")


#: What an identifier in a list of lines, nodes or nerves is made of; a fixed value.
NAME = r"[A-Za-z0-9][A-Za-z0-9:/_\-.]*"
_LIST = rf"^\s*{NAME}\s*(,\s*{NAME}\s*)*$"
_GROUP = rf"\(\s*{NAME}\s*(?:,\s*{NAME}\s*)*\)"
_ROUTE = rf"^\s*(?:{NAME}|{_GROUP})\s*(,\s*(?:{NAME}|{_GROUP})\s*)*$"
_MODEL = "id string, source string, network string, publications array<string>, `traced-paths` array<string>, paths array<struct<id:string,models:string,nerves:string,path:string,route:string,type:string,connects:array<string>,nodes:array<string>>>"


def model_paths(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-10 whole: of model documents a row per path, the later of an id counting, and what is wrong with them. A path has its
    type, what it models, its ``nodes`` if they are listed, the nodes it ``connects`` (in the form of centrelines; in that of pairs
    there are none), its drawn ``lines``, its ``nerves``, and its ``route``, a list of nodes or of groups of them. Lists are texts
    with commas, and brackets around groups, or JSON lists. ``traced`` says whether the document has the path traced, ``source``
    and ``publications`` are the document's. A list that does not read as one is an error and null."""
    rows = spark.read.schema(_MODEL).json(path).select("id", "source", "network", "publications", F.col("`traced-paths`").alias("traced"), F.posexplode("paths").alias("pos", "p"))
    rows = rows.groupBy("id", F.col("p.id").alias("path")).agg(F.max_by(F.struct("source", "network", "publications", "traced", "p"), "pos").alias("r")).select("id", "path", "r.*")

    def text(name: str) -> Column:
        """A JSON list as the text that says the same: lists in it become groups, the outer brackets and quotes go."""
        c = F.col(f"p.{name}")
        inner = F.translate(F.substring(c, F.lit(2), F.length(c) - 2), '[]"', "()")
        return F.when(c.startswith("["), inner).otherwise(c).alias(name)

    rows = rows.withColumns({c: text(c) for c in ("nerves", "route")} | {"drawn": text("path")})
    names = lambda c: F.regexp_extract_all(c, F.lit(f"({NAME})"), 1)
    listed = lambda c: F.when(F.col(c).rlike(_LIST), names(F.col(c)))
    route = F.when(F.col("route").rlike(_ROUTE), F.transform(F.regexp_extract_all("route", F.lit(f"({_GROUP}|{NAME})"), 1), lambda g: names(g)))
    wrong = lambda c, pattern, what: F.when(F.col(c).isNotNull() & ~F.col(c).rlike(pattern), F.concat(F.lit(f"Syntax error in {what} list: "), c))
    traced = F.coalesce(F.array_contains("traced", F.col("path")), F.lit(False)).alias("traced")
    good = rows.select(
        "id", "source", "network", "publications", "path", "p.type", "p.models", "p.nodes", "p.connects",
        listed("drawn").alias("lines"), listed("nerves").alias("nerves"), route.alias("route"), traced,
    )
    found = F.array_compact(F.array(wrong("drawn", _LIST, "path lines"), wrong("nerves", _LIST, "nerve"), wrong("route", _ROUTE, "route node")))
    return good, rows.select("id", "path", F.explode(found).alias("error"))


#: Maps that are sent to all paths at a time.
MAPS = 50_000


def resolved(sources: DataFrame, paths: DataFrame, whole: str = "NPO") -> DataFrame:
    """SRC-11: ``(map_id, path)`` of ``sources(map_id, uri)``: a model's paths by its uri, and once a
    map all of ``paths(uri, path)`` where it names the ``whole``."""
    by_uri = sources.where(F.col("uri") != whole).join(paths.select("uri", "path"), "uri").select("map_id", "path")
    wanting = sources.where(F.col("uri") == whole).select("map_id").distinct()
    known, out = paths.select("path").distinct(), by_uri
    blocks = -(-wanting.count() // MAPS)
    for k in range(blocks):  # one row of so many map ids at most, sent to all paths
        ids = wanting.where(F.pmod(F.xxhash64("map_id"), F.lit(blocks)) == k).agg(F.collect_list("map_id").alias("map_ids"))
        out = out.union(known.crossJoin(F.broadcast(ids)).select(F.explode("map_ids").alias("map_id"), "path"))
    return out.distinct()


def contours(texts: DataFrame, scale: float) -> DataFrame:
    """SRC-15: ``(id, name, term, ring)`` of contour elements in ``texts(id, xml)``: points scaled, y
    upwards, closed contours ending where they start."""
    schema = "_name string, _closed boolean, property struct<_name:string,s:string>, point array<struct<_x:double,_y:double>>"
    c = texts.select("id", F.from_xml("xml", schema).alias("c"))
    at = F.transform("c.point", lambda p: F.struct((p["_x"] * scale).alias("x"), (p["_y"] * -scale).alias("y")))
    ring = F.when(F.col("c._closed"), F.concat(at, F.slice(at, 1, 1))).otherwise(at)
    return c.select("id", F.col("c._name").alias("name"), F.when(F.col("c.property._name") == "TraceAssociation", F.col("c.property.s")).alias("term"), ring.alias("ring"))


def log_text(spark: SparkSession, path: str, phrases: dict[str, str]) -> DataFrame:
    """SRC-17: ``(kind, value)`` of log lines with one of the ``phrases``, which are patterns with a group for the value."""
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(phrases.items()):
        hit = F.col("value").rlike(pattern)
        kind, value = F.when(hit, name).otherwise(kind), F.when(hit, F.regexp_extract("value", pattern, 1)).otherwise(value)
    return spark.read.text(path).select(kind.alias("kind"), value.alias("found")).where("kind is not null")


def map_index(spark: SparkSession, path: str, least: float = 1.3) -> DataFrame:
    """SRC-18: ``(id, uuid, version)`` of index documents of a version from ``least`` on whose id or
    uuid is the name of their folder (``dir=...``)."""
    rows = spark.read.schema("id string, uuid string, version double").json(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"dir=([^/]*)/", 1)
    return rows.withColumn("folder", folder).where((F.col("version") >= least) & ((F.col("folder") == F.col("id")) | (F.col("folder") == F.col("uuid")))).select("id", "uuid", "version")


def expanded(triples: DataFrame, prefixes: DataFrame) -> DataFrame:
    """SRC-19: triples with the namespaces of ``prefixes(prefix, uri)`` written out in subject and object."""
    out = triples
    for c in ("s", "o"):
        known = F.broadcast(prefixes.select(F.col("prefix").alias(f"{c}_p"), F.col("uri").alias(f"{c}_u")))  # a few namespaces
        out = out.withColumn(f"{c}_p", F.when(F.col(c).contains(":"), F.substring_index(c, ":", 1))).join(known, f"{c}_p", "left")
        local: Column = F.expr(f"substring({c}, length({c}_p) + 2)")
        out = out.withColumn(c, F.when(F.col(f"{c}_u").isNotNull(), F.concat(f"{c}_u", local)).otherwise(F.col(c))).drop(f"{c}_p", f"{c}_u")
    return out.select("s", "p", "o")


def equivalents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: ``(id, label, aliases)`` of a term sheet without header: its columns 1, 2, and 4 and 7."""
    sheet = spark.read.schema(", ".join(f"c{k} string" for k in range(8))).csv(path)
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return sheet.select(F.col("c1").alias("id"), F.col("c2").alias("label"), F.array_compact(F.array(given("c4"), given("c7"))).alias("aliases")).where("size(aliases) > 0")
