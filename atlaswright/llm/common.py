"""What the training-data operators share: the shared folder, word reading, and graph components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where the session
    names none (tests on one machine) a new temporary folder, set for later calls. A cluster
    has no such default: an executor's own folder would hide data from the others."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-atlaswright-")
        sc.setCheckpointDir(at)
    return at


#: Lets Spark drop a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/atlaswright-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run in it drop their shuffle files as soon as they have ended, rather than
    when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends here,
    and a lost executor costs only the tasks that read it."""
    path = shared_path(df.sparkSession)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be none of ``df``'s columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id, mod: int) -> int:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of bytes outside \\x20 and \\x09-\\x0D.

    ``bytes.lower`` touches A-Z only and ``bytes.split`` cuts at exactly those six bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: At most so many of the most frequent keys of a join have their rows broadcast.
FREQUENT = 100_000


def join_copies(rows: DataFrame, table: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """``rows`` joined with ``table`` (one row per ``keys``; ``copies`` says how many of the
    ``total`` rows have them). Keys that more than a ``FREQUENT``-th of the rows share, no more
    than ``FREQUENT`` of them, are broadcast, so that no task gets all copies of one."""
    often = F.col(copies) > max(1000, total // FREQUENT)
    hot = table.where(often).drop(copies)
    new = [c for c in hot.columns if c not in keys]
    known = rows.join(F.broadcast(hot), keys, "left")
    rest = known.where(F.col(new[0]).isNull()).drop(*new).join(table.where(~often).drop(copies), keys)
    return known.where(F.col(new[0]).isNotNull()).unionByName(rest)


def join_left(rows: DataFrame, table: DataFrame, key: str, copies: str, spread, meant) -> DataFrame:
    """``rows`` joined to the left of ``table`` (one row per ``key``, shared by ``copies`` rows). Keys with
    more than a ``FREQUENT``-th of the rows, so no more than ``FREQUENT`` of them, are broadcast. Rows that have found theirs, or
    are not ``meant`` to find any, are dealt out by ``spread`` in the join of the rest."""
    total = table.agg(F.sum(copies)).first()[0] or 0
    often = F.col(copies) > max(1000, total // FREQUENT)
    new = [c for c in table.columns if c not in (key, copies)]
    hot = table.where(often).select(key, F.struct(*new).alias("_hot"))
    rare = table.where(~often).select(F.col(key).alias("_key"), F.struct(*new).alias("_rare"))
    known = rows.join(F.broadcast(hot), key, "left")
    open_ = F.col("_hot").isNull() & meant
    known = known.withColumn("_key", F.when(open_, F.col(key)).otherwise(spread.cast("string"))).join(rare, "_key", "left")
    found = [F.coalesce(F.when(meant, F.col(f"_hot.{c}")), F.col(f"_rare.{c}")).alias(c) for c in new]
    return known.select(*rows.columns, *found)


def placed(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``place`` from 1 in the order of ``order``: sorted by range over all tasks, numbered
    inside each, and shifted by the counts of the tasks before (one number a task). Rows come back
    from the shared folder, so a number once given stays."""
    inside = F.col("in_task").bitwiseAND((1 << 33) - 1)  # the task's own part of the id
    here = rows.orderBy(*order).select(F.struct(*rows.columns).alias("row"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("in_task"))
    here = cut(here)
    counts = here.groupBy("task").count()
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    skips = counts.select("task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    return here.join(F.broadcast(skips), "task").select("row.*", (F.col("skip") + inside + 1).alias("place"))


#: Edges that one task joins up on its own before tasks exchange any.
EDGES = 300_000


def _hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, least node reached)`` over the edges of a partition."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])


def min_label(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): rows ``(id, label)`` for every end,
    ``label`` the smallest id reachable.

    Tasks contract their own edges first, and if one task holds them all, that is the answer.
    Then alternating large-star and small-star rounds, until one changes nothing; every round is an aggregation on the
    node id followed by a join, cut through the shared folder. Hubs are pre-aggregated
    (min), and their join is an ordinary equi-join that adaptive execution may split."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = -(-edges.count() // EDGES)
    # every task first hangs the nodes it sees on the least they reach through its own edges
    edges = cut(edges.coalesce(max(1, tasks)).mapInArrow(_hung, "a long, b long"))
    if tasks <= 1:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    edges = edges.where("a <> b")
    ends, before = edges, None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours hang on the least of the neighbourhood
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours, and the node itself, hang on the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        edges = cut(large.join(least, "a").select(hung.alias("e")).select("e.*").where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "id")
    nodes = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct()
    return nodes.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
