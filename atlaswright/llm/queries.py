"""The registered queries of the training-data operators: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, importance, jaccard, langid, lines, lm, media, negatives, packing, quality, substrings, warc
from .common import documents


def op1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.per_document(documents(spark, sf_dir)).withColumn("removed", F.array_join("removed", ","))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = quality.featured(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["quality", "toxic"])
    return quality.score(feats, quality.learn(feats, ["quality", "toxic"]))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media(documents(spark, sf_dir)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(documents(spark, sf_dir))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("mask", chat.spans(F.col("mask")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(langid.training_sample(docs)))
    return found.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.read(warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


QUERIES = {f.__name__: f for f in (op1_scores, op2_lines, op3_jaccard, op4_quality, op5_media, op6_decontamination, op7_substrings, op8_chat, op9_language, op10_packing, op11_negatives, op12_importance, op13_warc)}
ORACLE_SQL: dict[str, str] = {"op2_lines": lines.SQL, "op6_decontamination": decontam.SQL, "op8_chat": chat.SQL, "op11_negatives": negatives.SQL, "op12_importance": importance.SQL, "op13_warc": warc.SQL}
