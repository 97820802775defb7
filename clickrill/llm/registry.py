"""Queries of the training-data operators: thin adapters from the operators' outputs to the columns asked for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, hamming, licenses, mixing, neardup, quality, sharding, substrings, warc
from .common import read, shared_dir
from .oracle import ORACLES


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


#: Target shares of expected tokens by domain.
WEIGHTS = {"clean": 0.9, "low": 0.06, "toxic": 0.04}


def domain_labels(labels: DataFrame) -> DataFrame:
    """The labelled table as doc_id, domain."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, domain_labels(read(spark, sf_dir, "labels")), sorted(WEIGHTS))
    return mixing.mix(mixing.memberships(docs, model).drop("text"), WEIGHTS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(read(spark, sf_dir, "pages"), out)
    return warc.read(spark, out).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda x: x["start"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        joined(F.transform("base", lambda x: x["label"])).alias("base_labels"), joined(F.col("labels")).alias("labels"), "score",
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(read(spark, sf_dir, "documents"), length=3, percent=85)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return hamming.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=10)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality.train(docs, read(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "text", F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard(narrow, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_mixing, op3_warc, op4_quality, op5_licenses, op6_exact_topk, op7_decontaminate, op8_main_text, op9_near_duplicates, op10_sharding)}

__all__ = ["ORACLES", "QUERIES"]
