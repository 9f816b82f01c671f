"""Data-quality rules: each gives rows of one issue schema (QA-1..26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issue(rows: DataFrame, kind: str, code: str, location: Column, text: Column) -> DataFrame:
    map_id = F.col("map_id") if "map_id" in rows.columns else F.lit(0)
    return rows.select(map_id.cast("long").alias("map_id"), F.lit(kind).alias("type"), F.lit(code).alias("code"), location.cast("string").alias("location"), text.alias("issue"))


def repeated(rows: DataFrame, key: str, kind: str, code: str, message: str) -> DataFrame:
    """QA-3, 5, 9, 17, 19, 26: keys that occur more than once."""
    many = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return issue(many, kind, code, F.col(key), F.concat(F.lit(f"{message}: "), F.col("n").cast("string")))


def several(rows: DataFrame, key: str, value: str, kind: str, code: str, message: str) -> DataFrame:
    """QA-5, 19: keys with more than one value."""
    many = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("v")).where(F.size("v") > 1)
    return issue(many, kind, code, F.col(key), F.concat(F.lit(f"{message}: "), F.array_join(F.col("v").cast("array<string>"), ", ")))


def unknown(rows: DataFrame, key: str, known: DataFrame, kind: str, code: str, message: str) -> DataFrame:
    """QA-1, 2, 4, 6..15: keys that no row of ``known`` (one column) has."""
    lost = rows.select(key).where(F.col(key).isNotNull()).distinct().join(known.toDF(key).distinct(), key, "left_anti")
    return issue(lost, kind, code, F.col(key), F.lit(message))


def out_of_sequence(nodes: DataFrame, code: str = "QA-18") -> DataFrame:
    """QA-18: nodes whose position along their line is before that of the node they follow."""
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("pos")
    bad = nodes.withColumn("before", F.lag("along").over(w)).where("along < before")
    return issue(bad, "centreline", code, F.concat_ws("/", "line", "node"), F.lit("Node is out of sequence"))


def flagged(rows: DataFrame, key: str, message: str, kind: str, code: str) -> DataFrame:
    """QA-20..22: rows whose ``message`` column is set."""
    return issue(rows.where(F.col(message).isNotNull()), kind, code, F.col(key), F.col(message))


def ordered(issues: DataFrame) -> DataFrame:
    """TK-4."""
    return issues.orderBy("location", "issue")
