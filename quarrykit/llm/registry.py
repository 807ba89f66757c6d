"""The queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, kneser_ney, language, toxicity, warc
from .common import fold, table
from .decontaminate import leaks
from .html_text import main_text
from .mixing import mixed
from .near_dups import near_duplicates
from .sharding import proportional_shards


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, learn=fold("doc_id") != 0)
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(fold("doc_id") != 1))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proportional_shards(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "position")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.train(docs, learn=fold("doc_id") != 0)
    return language.languages(docs, net).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    near = fingerprints.resemblance
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.to_text(F.col("sketch")).alias("fingerprint"), fingerprints.to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        near(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), near(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_count(F.col("sketch")).alias("n_distinct"), fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
        fingerprints.distinct_count(fingerprints.merge(F.col("sketch"), F.col("next_sketch"))).alias("n_distinct_with_next"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
