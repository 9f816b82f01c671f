"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlaswright.llm import decontam, jaccard, langid, lines, packing
from atlaswright.llm.common import cut, documents


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without text or any letter (``und``) go.

    A null ``doc_id`` counts as empty text where ids are hashed; repeated rows have the same answer; ties go to the language first in the alphabet;
    null labels are not learned; very long texts are parsed whole; an empty table gives none; columns of any name pass unchanged."""
    return langid.accepted(docs, langid.fit(langid.training_sample(docs)))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near an earlier line go, and documents that have nothing else.

    Rows without ``doc_id`` have no place in the order and stay as they are; rows that repeat an id lose the same lines; of equal lines the
    first by id and number stays; documents that had no text stay; very long lines are compared whole; an empty table gives none; columns of any
    name pass unchanged but for ``text`` and, where there is one, ``n_chars``."""
    left = lines.without(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else left


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of the smallest id.

    Rows without ``doc_id`` are in no group and stay; rows that repeat an id stay or go together; documents without words are in no group;
    very long texts count whole; an empty table gives none; columns of any name pass unchanged."""
    others = jaccard.join(docs, width=5, threshold=(4, 5)).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows without ``doc_id`` cannot be named by a match and stay; rows that repeat an id go together; items without text match nothing;
    every window of very long texts is looked up; an empty table, or benchmark, removes nothing; columns of any name pass unchanged."""
    found = decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, placed in sequences.

    A null or empty text is one piece of id 0; a null ``doc_id`` stays null; repeated rows are packed as often as they occur; pieces of equal
    length are placed by id and start; very long texts are cut into as many pieces as it takes; an empty table gives none; other columns are ignored."""
    return packing.pack(docs)


STAGES = [
    ("language", identified),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: Language identification and tokenization are beyond SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
