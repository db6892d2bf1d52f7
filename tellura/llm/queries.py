"""Thin queries: each applies its operator, as it is set up for production, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellura.llm import embeddings, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, substring_dedup, toxicity, urls
from tellura.llm.common import table

N_SHARDS = 40
RULES = (
    urls.rule("block", "com/en/"), urls.rule("allow", "example.com/en/7"), urls.rule("allow", "net/de/"),
    urls.rule("block", "example.net/de/8"), urls.rule("block", "org/es/"),
)
#: Hosts whose single URLs are listed: the six families of advertising and spam among the pages.
LISTED_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"), ngram_join.Likeness(words=3, num=90, den=100))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_words(table(spark, sf_dir, "documents"), 35)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.split_of(F.col("doc_id"), 5) == 0
    machine = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality_classifier.score(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the URLs of all hosts of ``LISTED_HOSTS``, as a list of single URLs would name them."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(urls.host_of(F.col("url")).rlike("|".join(LISTED_HOSTS)))
    return urls.judge_urls(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict", "canonical_url")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.split_of(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, repeated towards the sources' target shares and shuffled."""
    return mixing.replicate(table(spark, sf_dir, "documents")).withColumnsRenamed({"_copy": "copy", "_rate": "rate", "_shuffle_key": "shuffle_key"}).withColumn("rate", F.round("rate", 6))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_ngram_jaccard_join, op3_quality_rules, op4_substring_dedup, op5_quality_classifier, op6_embedding_near_dedup, op7_url_filters, op8_toxicity, op9_best_fit_packing, op10_source_mixing)}
