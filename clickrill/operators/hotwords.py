"""Hot search words: counts in panes, and the top words of a trailing hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import day_of

PANE_MS, TRAIL_MS = 4_000, 3_600_000


def panes(events: DataFrame, pane_ms: int = PANE_MS) -> DataFrame:
    """Searches in each pane of time: pane (its end in ms), day, country, province, city, keyword, count. The sums of panes
    stand for the long sliding window, in which every event would be counted hundreds of times."""
    end = ((F.floor(F.col("s_time") / pane_ms) + 1) * pane_ms).cast("bigint")
    return events.where("kw IS NOT NULL").groupBy(end.alias("pane"), day_of(F.col("s_time")).cast("string").alias("day"), "country", "province", "city", F.col("kw").alias("keyword")).agg(F.count("*").alias("count"))


def trailing(pane_counts: DataFrame, as_of_ms: int, trail_ms: int = TRAIL_MS) -> DataFrame:
    """Counts of the panes that end in (as_of - trail, as_of]."""
    inside = pane_counts.where((F.col("pane") > as_of_ms - trail_ms) & (F.col("pane") <= as_of_ms))
    return inside.groupBy("day", "country", "province", "city", "keyword").agg(F.sum("count").alias("count"))


def top_words(counts: DataFrame, k: int = 3) -> DataFrame:
    """The k largest rows of each day, country and province (a word may take several, through its cities)."""
    order = Window.partitionBy("day", "country", "province").orderBy(F.desc("count"), "keyword", "city")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("rank", "day", "country", "province", "city", "keyword", "count")
