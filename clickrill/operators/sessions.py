"""Sessions: roll-up, visit and step length buckets, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, round_half_up
from ..schema import STEP_BUCKETS, VISIT_BUCKETS

#: The largest visit length (s) and step length (pages) of each bucket but the last.
VISIT_LIMITS = [3, 6, 9, 30, 60, 180, 600, 1800]
STEP_LIMITS = [3, 6, 9, 30, 60]


def in_range(events: DataFrame, start_ms: int | Column, end_ms: int | Column, day: str | None = None) -> DataFrame:
    """Events with start <= s_time < end. day: the partition column, which gets the range as well so that files are pruned."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (start_ms, end_ms))
    out = events.where((F.col("s_time") >= lo) & (F.col("s_time") < hi))
    if day:
        out = out.where(F.col(day).between(F.date_from_unix_date(F.floor(lo / 86_400_000).cast("int")), F.date_from_unix_date(F.floor((hi - 1) / 86_400_000).cast("int"))))
    return out


def roll_up(events: DataFrame) -> DataFrame:
    """sid, uid (of the last event), gids (in time order, comma-joined), step_length (page views), visit_length (whole
    seconds). Rows without a sid are one session. Ties in time: by row_key."""
    order = F.struct("s_time", "row_key")
    gids = F.sort_array(F.collect_list(F.when(~is_blank(F.col("gid").cast("string")), F.struct("s_time", "row_key", F.col("gid").cast("string").alias("gid")))))
    return events.groupBy("sid").agg(
        F.max_by("uid", order).alias("uid"), F.array_join(F.transform(gids, lambda x: x["gid"]), ",").alias("gids"), F.count_if(F.col("en") == "e_pv").alias("step_length"),
        F.floor((F.max("s_time") - F.min("s_time")) / 1000).cast("bigint").alias("visit_length"),
    )


def _bucket(x: Column, names: list[str], limits: list[int]) -> Column:
    out = F.lit(names[-1])
    for name, limit in reversed(list(zip(names, limits, strict=False))):
        out = F.when(x <= limit, name).otherwise(out)
    return out


def visit_bucket(seconds: Column) -> Column:
    return F.when(seconds >= 0, _bucket(seconds, VISIT_BUCKETS, VISIT_LIMITS))


def step_bucket(pages: Column) -> Column:
    """Null for sessions without a page view; they still count as sessions."""
    return F.when(pages >= 1, _bucket(pages, STEP_BUCKETS, STEP_LIMITS))


def histogram(sessions: DataFrame) -> DataFrame:
    """One row: session_count and the sessions in each bucket."""
    x = sessions.select(visit_bucket(F.col("visit_length")).alias("v"), step_bucket(F.col("step_length")).alias("s"))
    return x.agg(F.count("*").alias("session_count"), *[F.count_if(F.col("v") == b).alias(b) for b in VISIT_BUCKETS], *[F.count_if(F.col("s") == b).alias(b) for b in STEP_BUCKETS])


def ratios(counts: DataFrame) -> DataFrame:
    """The row of histogram with buckets as shares of the sessions, to 2 digits; 0 without any session."""
    share = lambda b: round_half_up(F.coalesce(F.col(f"`{b}`") / F.nullif(F.col("session_count"), F.lit(0)), F.lit(0.0)))
    return counts.select("session_count", *[share(b).alias(b) for b in VISIT_BUCKETS + STEP_BUCKETS])


def session_stat(events: DataFrame, task_id: int) -> DataFrame:
    return ratios(histogram(roll_up(events))).select(F.lit(task_id).cast("bigint").alias("task_id"), "*")


def packed_histogram(counts: DataFrame) -> DataFrame:
    """The row of histogram as one `name=count|name=count` string."""
    names = ["session_count", *VISIT_BUCKETS, *STEP_BUCKETS]
    return counts.select(F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.col(f"`{n}`").cast("string")) for n in names]).alias("packed"))
