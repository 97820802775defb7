"""The corpus pipeline: quality, near-duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last adds the shard
and the slot of each record. run() hands each stage's Parquet output to the next.

A document is an id and a text, and stages decide on documents: rows with one id and different texts are several, and so
are rows without an id; a null text is one of its own, other than an empty one. They are told apart by a 64-bit hash of
both. Rows that repeat a document are one document, of which the near-duplicates stage keeps one row; the other stages
decide alike on all of them. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickrill.llm import decontaminate, mixing, neardup, quality, sharding
from clickrill.llm.common import read, remove, renamed, scratch, shared_dir, stored, unused

#: Shares of expected tokens among what is left after the filters. Toxic documents are thinned out to theirs.
WEIGHTS = {"clean": 0.95, "toxic": 0.05}
#: Fits of the rates at most.
ROUNDS = 6
SHARDS = 8


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _whatever_names(stage: Stage) -> Stage:
    """The stage on documents whose other columns have names that clash with none, and the names that they had. Columns that
    a stage adds replace those of the same name."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = renamed(docs, "doc_id", "text")
        out = stage(spark, plain, sf_dir)
        added = [c for c in out.columns if c not in plain.columns]
        old = dict(zip(plain.columns, docs.columns, strict=True))
        kept = [c for c in out.columns if c in added or old[c].lower() not in [a.lower() for a in added]]
        return out.select(*kept).toDF(*[old.get(c, c) for c in kept])

    return run


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash that tells documents apart, and that column's name."""
    (key,) = unused(docs, "_document")
    return docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")), key


@_whatever_names
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the classifier finds good on the whole. Null texts are scored as empty ones. A row is judged by
    its own text, whatever its id; rows that repeat a document stay or go together."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality.train(docs, read(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs, model, docs.columns).where("score >= 0.5").drop("score")


@_whatever_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest id, null
    last (of equal ids, the smallest hash). Documents without words link with nothing and stay. One row of each document."""
    keyed, key = _keyed(docs)
    rows = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("id"), "text")
    linked = stored(neardup.link(rows, length=5, percent=80, id_col="k").select("k", F.col("component_id").alias("c"), "kept"), "linked")
    others = linked.where(~F.col("kept")).select("k", "c").distinct()
    members = others.unionByName(others.select(F.col("c").alias("k"), "c").distinct())
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k")
    ranked = stored(members.join(rows.select("k", "id").distinct(), "k").select("c", "k", order.alias("o")), "members")
    first = ranked.groupBy("c").agg(F.min("o")["k"].alias("first"))
    gone = ranked.join(first, "c").where("k != first").select(F.col("k").alias(key)).distinct()
    left = keyed.join(gone, key, "left_anti")
    again = stored(linked.groupBy("k").count().where("count > 1").select(F.col("k").alias(key)), "repeated")
    if not again.isEmpty():
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
    return left.select(*docs.columns)


@_whatever_names
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in a benchmark window. Each is judged by its own text,
    also without an id; rows that repeat a document stay or go together."""
    keyed, key = _keyed(docs)
    found = decontaminate.find(keyed.select(key, "text"), read(spark, sf_dir, "benchmark"), doc_col=key)
    bad = found.where("n_hit > 0 AND 20 * n_hit >= n_words").select(F.col("id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


@_whatever_names
def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned out to WEIGHTS: each stays with the chance of its fitted rate, by a hash. A document isn't
    repeated, so rates over 1 count as 1, and the shares are fitted to what is left then. The expected clean tokens stay
    what they are but for that; a domain below its share stays whole. Documents without an id are drawn one by one; rows
    that repeat a document stay or go together."""
    model = mixing.train(docs, read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain")), sorted(WEIGHTS))
    keyed, key = _keyed(docs)
    members = stored(mixing.memberships(keyed.select(key, "text"), model).drop("text"), "members")
    gone = members.where(mixing.copies(_rates(members), F.col(key), snap=0.0) < 1).select(key).distinct()
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def _rates(members: DataFrame) -> Column:
    """Chances to stay, 0 to 1, that bring the expected tokens to WEIGHTS. Capping at 1 takes some clean tokens, so the
    other targets are fitted again until they have their shares of the capped ones."""

    def tokens(rate: Column) -> dict[str, float]:
        return members.agg(*[F.coalesce(F.sum(rate * F.col("n_tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in WEIGHTS]).first().asDict()

    now = tokens(F.lit(1.0))
    ratio = {d: w / WEIGHTS["clean"] for d, w in WEIGHTS.items()}
    targets, best, least = {d: min(now[d], now["clean"] * x) for d, x in ratio.items()}, F.lit(1.0), float("inf")
    for _ in range(ROUNDS):
        rate = F.least(F.lit(1.0), mixing.fit_rates(members, targets)[0])
        kept = tokens(rate)
        wanted = {d: min(now[d], kept["clean"] * x) for d, x in ratio.items()}
        off = sum(abs(kept[d] - wanted[d]) for d in ratio if d != "clean") / max(1.0, kept["clean"])
        if off < least:
            best = rate
        if off <= 1e-4 or off > 0.9 * least:  # met, or not to be met
            break
        least = off
        targets = {d: t if d == "clean" or not kept[d] else min(now[d], t * wanted[d] / kept[d]) for d, t in targets.items()}
    return best


@_whatever_names
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the record's size, shard and slot in it."""
    return sharding.shard(docs, SHARDS)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_domains), ("sharding", shard)]

#: The classifier and the fitted rates are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's documents. What the stages store on the way goes when they are done, and so does the output of each
    but the last."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if i:
            remove(spark, f"{folder}/{STAGES[i - 1][0]}")
    return docs
