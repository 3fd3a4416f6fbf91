"""Contract queries that learn from labels: toxicity and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality, toxicity


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    held_out = common.doc_hash_mod("doc_id", 5) == 0
    sample = toxicity.labelled_sample(common.read(spark, sf_dir, "labels"), "toxic", held_out, toxicity.MAX_LABELLED)
    return toxicity.fit(common.read(spark, sf_dir, "documents"), sample)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    held_out = common.doc_hash_mod("doc_id", 3) == 1
    sample = toxicity.labelled_sample(common.read(spark, sf_dir, "labels"), "quality", held_out, quality.MAX_LABELLED)
    return quality.fit(common.read(spark, sf_dir, "documents"), sample)


def _predictions(scored: DataFrame, held_out: Column) -> DataFrame:
    more = [c for c in scored.columns if c not in ("id", "score")]
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return scored.withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "score", predicted, *more)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(common.read(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return _predictions(scored, common.doc_hash_mod("doc_id", 5) == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(common.read(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return _predictions(scored, common.doc_hash_mod("doc_id", 3) == 1)


QUERIES = {"op6_toxicity": op6_toxicity, "op9_quality": op9_quality}
