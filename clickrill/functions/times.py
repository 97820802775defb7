"""Dates and times; epoch milliseconds are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ["year", "season", "month", "week", "day"]


def to_millis(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Null where the text doesn't fit."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(pattern)))


def from_millis(ms: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.timestamp_millis(ms), pattern)


def day_of(ms: Column) -> Column:
    """The UTC date of epoch milliseconds, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(86_400_000)).cast("int"))


def yesterday() -> Column:
    return F.date_sub(F.current_date(), 1)


def is_run_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_timestamp(text, F.lit("y-M-d")).isNotNull(), F.lit(False))


def first_day_of_week(d: Column) -> Column:
    """The Sunday on or before d."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def week_of_year(d: Column) -> Column:
    """Weeks begin on Sunday and week 1 holds January 1; December days of the next year's week 1 are in week 53."""
    offset = F.dayofweek(F.trunc(d, "year")) - 1
    week = F.floor((F.dayofyear(d) + offset - 1) / 7).cast("int") + 1
    return F.least(F.lit(53), week)


def date_dimension(d: Column, grain: str) -> Column:
    """struct(year, season, month, week, day, calendar, type) at a grain; finer parts are 0."""
    part = {"year": F.year(d), "season": F.quarter(d), "month": F.month(d), "week": week_of_year(d), "day": F.dayofmonth(d)}
    zero = F.lit(0)
    sunday = first_day_of_week(d)
    # the rewrite to 53 looks at the day itself: a January day whose Sunday lies in December is in week 1
    week = F.when((F.month(d) == 1) & (F.month(sunday) == 12), F.lit(1)).otherwise(week_of_year(sunday))
    start = {"year": F.trunc(d, "year"), "season": F.trunc(d, "quarter"), "month": F.trunc(d, "month"), "week": sunday, "day": d}[grain]
    shown = {"year": ["year"], "season": ["year", "season"], "month": ["year", "season", "month"], "week": ["year", "season", "month", "week"], "day": ["year", "season", "month", "week", "day"]}[grain]
    values = {k: part[k] if k in shown else zero for k in GRAINS}
    if grain == "week":
        values["week"] = week
    return F.struct(*[v.cast("int").alias(k) for k, v in values.items()], start.alias("calendar"), F.lit(grain).alias("type"))
