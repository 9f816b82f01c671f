"""Scans of map documents (SRC-1..20)."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "id string, name string, models string, kind string, sources array<struct<id:string,href:string,kind:string,boundary:string,feature:string,zoom:int>>"


def trimmed(df: DataFrame) -> DataFrame:
    """SRC-3: every string of every column trimmed, however deep."""

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.trim(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: walk(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-1: valid manifests with their kind, and errors: an id, sources, and an href each are required."""
    rows = trimmed(spark.read.schema(MANIFEST).json(path, multiLine=True))
    words = F.split(F.coalesce("kind", F.lit("")), " ")
    rows = rows.withColumn("map_kind", F.when(F.array_contains(words, "functional"), "functional").when(F.array_contains(words, "centreline"), "centreline").otherwise("anatomical"))
    error = F.when(F.col("id").isNull(), "No id").when(F.coalesce(F.size("sources"), F.lit(0)) < 1, "No sources").when(F.exists("sources", lambda s: s["href"].isNull()), "Source without href")
    rows = rows.withColumn("error", error)
    return rows.where("error is null").drop("error"), rows.where("error is not null")


def ordered_sources(manifests: DataFrame) -> DataFrame:
    """SRC-2: sources of each map in order of use: bases and slides, then by kind."""
    rows = manifests.select(F.col("id").alias("map_id"), F.posexplode("sources").alias("pos", "s")).select("map_id", "pos", "s.*")
    first = F.when(F.col("kind").isin("base", "slides"), 0).otherwise(1)
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("map_id").orderBy(first, "kind", "pos")) - 1)


def property_rules(documents: DataFrame) -> DataFrame:
    """SRC-4: ``documents(map_id, seq, json)`` in the new layout ``{"classes": {...}, "features":
    {...}}`` or the old ``{"features": [{"id" or "class", "properties": {...}}]}`` as rule rows,
    of repeated properties the last."""
    d = documents.select("map_id", "seq", "json")
    new = d.select("map_id", "seq", F.from_json("json", "classes map<string,map<string,string>>, features map<string,map<string,string>>").alias("j"))
    by = lambda scope, field: new.select("map_id", "seq", F.lit(scope).alias("scope"), F.explode(f"j.{field}").alias("key", "props"))
    old = d.select("map_id", F.col("seq"), F.from_json("json", "features array<struct<id:string,class:string,properties:map<string,string>>>").alias("j")).select("map_id", "seq", F.explode("j.features").alias("f"))
    old = old.where("f.properties is not null").select("map_id", "seq", F.when(F.col("f.class").isNotNull(), "class").otherwise("id").alias("scope"), F.coalesce("f.class", "f.id").alias("key"), F.col("f.properties").alias("props"))
    rows = by("class", "classes").unionByName(by("id", "features")).unionByName(old)
    rows = rows.select("map_id", "seq", "scope", F.when(F.col("scope") == "id", F.replace("key", F.lit(" "), F.lit("_"))).otherwise(F.col("key")).alias("key"), F.explode("props").alias("prop", "value"))
    # one associated detail is a list of one; lists come as JSON
    rows = rows.withColumn("value", F.when((F.col("prop") == "associated-details") & ~F.col("value").startswith("["), F.to_json(F.array("value"))).otherwise(F.col("value")))
    return rows.groupBy("map_id", "scope", "key", "prop").agg(F.max_by("value", "seq").alias("value"))


#: Kinds of sources that go with a base map; fixed values.
BESIDES = ("details", "image", "layer", "anatomical", "functional")


def base_errors(sources: DataFrame) -> DataFrame:
    """SRC-2: what is wrong with the bases of maps in ``ordered_sources``: the first source is the base map, which details cannot
    be; any later one that does not go with a base map is a second one."""
    error = F.when((F.col("ordinal") == 0) & (F.col("kind") == "details"), "Details layer cannot be the base map").when((F.col("ordinal") > 0) & ~F.col("kind").isin(*BESIDES), "Can only have a single base map")
    return sources.select("map_id", "id", error.alias("error")).where("error is not null")


_TREE = "doc string, seq long, tag string, id string, title string, depth int, group string, fill string, stroke string, attributes map<string,string>"
_PAINT = re.compile(r"(?:^|;)\s*(fill|stroke)\s*:\s*([^;]*)")


def drawing_tree(drawings: DataFrame) -> DataFrame:
    """SRC-13 whole: of ``drawings(doc, xml)`` a row per element in document order, with its depth, the id of the nearest element
    around it that has one, its title, and its paint, from ``style`` before the attributes. ``none`` is no paint. A drawing that
    is no XML has a row with the error as ``tag``."""

    def local(name: str) -> str:
        return name.rpartition("}")[2]

    def rows(doc: str, xml: str) -> Iterator[tuple]:
        open_: list[tuple] = []
        for n, (event, e) in enumerate(ElementTree.iterparse(io.BytesIO(xml.encode()), ("start", "end"))):
            if event == "start":
                open_.append((n, e))
                continue
            start, _ = open_.pop()
            if local(e.tag) == "title":
                continue
            style = {k: v.strip() for k, v in _PAINT.findall(e.get("style") or "")}
            paint = [None if (c := style.get(k, e.get(k))) in (None, "", "none") else c for k in ("fill", "stroke")]
            title = next((c.text for c in e if local(c.tag) == "title"), None)
            group = next((a.get("id") for _, a in reversed(open_) if a.get("id")), None)
            yield doc, start, local(e.tag), e.get("id"), title, len(open_), group, *paint, list({local(k): v for k, v in e.attrib.items()}.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            for doc, xml in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = sorted(rows(doc, xml or ""), key=lambda r: r[1])
                except ElementTree.ParseError as e:
                    found = [(doc, 0, f"error: {e}", *[None] * 6, [])]
                found = [(r[0], k, *r[2:]) for k, r in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], [c.split()[0] for c in _TREE.split(", ")])

    return drawings.select(F.col("doc").cast("string"), F.col("xml").cast("string")).mapInArrow(run, _TREE)


def drawing_elements(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """SRC-13: elements of XML drawings, a row each, with the file they are in."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path).withColumn("file", F.input_file_name())


def basic_shape(tag: Column, a: dict[str, Column]) -> Column:
    """SRC-14: vertices of rect, line, polyline, polygon, circle and ellipse from their
    attributes; shapes of no size are null, negative lengths count as 0."""
    import math

    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    size = lambda c: F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    x, y, w, h = zero(a["x"]), zero(a["y"]), size(a["width"]), size(a["height"])
    rect = F.when((w > 0) & (h > 0), F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y)))
    rx, ry = size(F.coalesce(a["r"], a["rx"])), size(F.coalesce(a["r"], a["ry"]))
    turn = F.transform(F.sequence(F.lit(0), F.lit(36)), lambda k: point(zero(a["cx"]) + rx * F.cos(2 * math.pi * k / 36), zero(a["cy"]) + ry * F.sin(2 * math.pi * k / 36)))
    numbers = F.transform(F.regexp_extract_all(a["points"], F.lit(r"(-?[0-9.]+(?:[eE]-?\d+)?)"), 1), lambda n: n.cast("double"))
    listed = F.when(F.size(numbers) >= 4, F.transform(F.sequence(F.lit(0), (F.size(numbers) / 2).cast("int") - 1), lambda k: point(F.get(numbers, 2 * k), F.get(numbers, 2 * k + 1))))
    closed = F.when(F.size(listed) >= 3, F.concat(listed, F.slice(listed, 1, 1))).otherwise(listed)
    line = F.array(point(zero(a["x1"]), zero(a["y1"])), point(zero(a["x2"]), zero(a["y2"])))
    return F.when(tag == "rect", rect).when(tag == "line", line).when(tag == "polyline", listed).when(tag == "polygon", closed).when(tag.isin("circle", "ellipse") & (rx > 0) & (ry > 0), turn)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16: build logs, a JSON document a line, with the map that each file says it makes."""
    rows = spark.read.schema("timestamp timestamp, level string, msg string, type string, map string, path string, node string, name string, id string").json(path).withColumn("file", F.col("_metadata.file_path"))
    made = rows.where("msg like 'Making map%'").groupBy("file").agg(F.max(F.coalesce("map", "id")).alias("map_id"))
    return rows.join(made, "file", "left")
