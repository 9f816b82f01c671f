"""Alignment of names to terms: phrase candidates and on-map ancestors (TK-2, 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def phrase_candidates(scores: DataFrame, k: int) -> DataFrame:
    """TK-2: the ``k`` best nodes for each name of one or two phrases: ``scores(name, phrase,
    term, score)`` holds each phrase's best terms; a node takes one term a phrase, its score
    is their mean, and of equal nodes the best score counts."""
    n = scores.groupBy("name").agg(F.max("phrase").alias("phrases"))
    first = scores.where("phrase = 0").select("name", F.col("term").alias("t0"), F.col("score").alias("s0"))
    second = scores.where("phrase = 1").select("name", F.col("term").alias("t1"), F.col("score").alias("s1"))
    one = first.join(n.where("phrases = 0"), "name").select("name", F.col("t0").cast("string").alias("node"), F.col("s0").alias("score"))
    two = first.join(second, "name").select("name", F.when(F.col("t0") == F.col("t1"), F.col("t0").cast("string")).otherwise(F.concat_ws("/", "t0", "t1")).alias("node"), F.round((F.col("s0") + F.col("s1")) / 2, 6).alias("score"))
    best = one.union(two).groupBy("name", "node").agg(F.max("score").alias("score"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "node")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def phrases(names: DataFrame) -> DataFrame:
    """TK-2: ``(name, phrase, text)`` of names split at ``in`` and ``of`` between words, in any case, blank parts left out."""
    parts = F.filter(F.transform(F.split(F.col("name"), r"(?i)\s+(?:in|of)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return names.select("name").distinct().select("name", F.posexplode(parts).alias("phrase", "text"))


def all_phrase_candidates(scores: DataFrame, k: int) -> DataFrame:
    """TK-2 whole: the ``k`` best nodes for each name of any number of phrases: ``scores(name, phrase, term, score)`` holds the
    best terms of each phrase, from 0 on; a node takes one term a phrase, a term once, and has their mean score; of equal nodes
    the best counts. A step for each phrase joins the candidates so far with its terms (a few each)."""
    n = scores.groupBy("name").agg(F.max("phrase").alias("last"))
    most = n.agg(F.max("last")).first()[0]
    out, so_far = None, None
    for p in range((most if most is not None else -1) + 1):
        here = scores.where(F.col("phrase") == p).select("name", F.col("term").alias("t"), F.col("score").alias("s"))
        if so_far is None:
            so_far = here.select("name", F.array("t").alias("terms"), F.col("s").alias("total"))
        else:
            so_far = so_far.join(here, "name").select("name", F.when(F.array_contains("terms", F.col("t")), F.col("terms")).otherwise(F.array_append("terms", F.col("t"))).alias("terms"), (F.col("total") + F.col("s")).alias("total"))
        done = so_far.join(n.where(F.col("last") == p), "name").select("name", F.concat_ws("/", F.col("terms").cast("array<string>")).alias("node"), F.round(F.col("total") / (p + 1), 6).alias("score"))
        out = done if out is None else out.union(done)
    out = out if out is not None else scores.where("false").select("name", F.col("term").cast("string").alias("node"), "score")
    best = out.groupBy("name", "node").agg(F.max("score").alias("score"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "node")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ancestor_choice(ancestors: DataFrame, on_map: DataFrame, scores: DataFrame, cutoff: float) -> DataFrame:
    """TK-3: for each child the ancestor on the map whose similarity reaches the cutoff, of
    least score plus level."""
    rows = ancestors.join(on_map.toDF("ancestor").distinct(), "ancestor", "left_semi").join(scores, ["child", "ancestor"]).where(F.col("score") >= cutoff)
    return rows.groupBy("child").agg(F.min(F.struct((F.col("score") + F.col("level")).alias("o"), "ancestor", "level")).alias("m")).select("child", "m.ancestor", "m.level")
