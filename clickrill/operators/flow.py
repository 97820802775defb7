"""Traffic by day and location: uv, pv, nu, sn and on (sessions of one event)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import day_of
from ..schema import ALL

LEVELS = [("country",), ("country", "province"), ("country", "province", "city")]


def location_levels(events: DataFrame) -> DataFrame:
    """Each row three times: for its country, its province and its city, `all` below."""
    levels = [F.struct(*[(F.col(c) if c in level else F.lit(ALL)).alias(c) for c in LEVELS[-1]]) for level in LEVELS]
    rest = [c for c in events.columns if c not in LEVELS[-1]]
    return events.select(*rest, F.explode(F.array(*levels)).alias("_l")).select(*rest, "_l.*")


def leaves(events: DataFrame) -> DataFrame:
    """The smallest table that still has every metric: counts for each day, city, session and visitor."""
    return events.withColumn("day", day_of(F.col("s_time"))).groupBy("day", *LEVELS[-1], "sid", "uid").agg(F.count("*").alias("n"), F.count_if(F.col("en") == "e_pv").alias("pv"), F.count_if(F.col("en") == "e_l").alias("nu"))


def metrics(leaf: DataFrame) -> DataFrame:
    """day, country, province, city, uv, pv, nu, sn, on from leaves. Sessions and visitors are brought together one by one
    before they are counted, so no group is ever collected."""
    key = ["day", *LEVELS[-1]]
    rows = location_levels(leaf)
    sessions = rows.groupBy(*key, "sid").agg(F.sum("n").alias("n"), F.sum("pv").alias("pv"), F.sum("nu").alias("nu"))
    counted = sessions.groupBy(*key).agg(F.sum("pv").alias("pv"), F.sum("nu").alias("nu"), F.count("sid").alias("sn"), F.count_if((F.col("n") == 1) & F.col("sid").isNotNull()).alias("on"))
    visitors = rows.where("uid IS NOT NULL").groupBy(*key, "uid").agg(F.lit(1)).groupBy(*key).agg(F.count("*").alias("uv"))
    same = [counted[c].eqNullSafe(visitors[c]) for c in key]
    joined = counted.join(visitors, same[0] & same[1] & same[2] & same[3], "left")
    return joined.select(*[counted[c] for c in key], F.coalesce("uv", F.lit(0)).cast("bigint").alias("uv"), "pv", "nu", "sn", "on")


def flow_stats(events: DataFrame) -> DataFrame:
    return metrics(leaves(events))
