"""Dimensions with surrogate keys, upserts, unions and word counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import GRAINS, date_dimension
from ..schema import ALL


def date_rows(dates: DataFrame, date: str = "day", grains: list[str] = GRAINS) -> DataFrame:
    """The distinct date dimension rows of a date column at each grain."""
    return dates.select(F.explode(F.array(*[date_dimension(F.col(date), g) for g in grains])).alias("d")).select("d.*").distinct()


def location_rows(places: DataFrame) -> DataFrame:
    """The distinct location dimension rows: (country,all,all), (country,province,all), (country,province,city)."""
    c, p, city, every = F.col("country"), F.col("province"), F.col("city"), F.lit(ALL)
    levels = F.array(F.struct(c.alias("country"), every.alias("province"), every.alias("city")), F.struct(c.alias("country"), p.alias("province"), every.alias("city")), F.struct(c.alias("country"), p.alias("province"), city.alias("city")))
    return places.select(F.explode(levels).alias("l")).select("l.*").distinct()


def get_or_create(dimension: DataFrame, wanted: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """The dimension with rows for all natural keys wanted; new ones get the next ids, in the order of their keys."""
    known = dimension.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    new = wanted.select(*keys).distinct().join(known, same, "left_anti")
    last = dimension.agg(F.max(id_col)).first()[0] or 0
    # new members of a dimension are few: their order is global
    numbered = new.withColumn(id_col, (F.row_number().over(Window.orderBy(*keys)) + last).cast("int"))
    return dimension.select(id_col, *keys).unionByName(numbered.select(id_col, *keys))


def with_ids(facts: DataFrame, dimension: DataFrame, keys: list[str], name: str) -> DataFrame:
    """facts with the dimension's id as `name`, in one join in place of a lookup for each row."""
    d = dimension.select(F.col("id").alias(name), *[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [facts[k].eqNullSafe(d[f"_{k}"]) for k in keys])
    return facts.join(d, same, "left").drop(*[f"_{k}" for k in keys])


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], add: list[str] | None = None) -> DataFrame:
    """Rows of target with those of updates laid over them by key: replaced, or for the columns `add` added up. One
    aggregate over the union; updates have a row for each key."""
    sides = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    values = [c for c in target.columns if c not in keys]
    add = add or []
    return sides.groupBy(*keys).agg(*[(F.sum(c) if c in add else F.max_by(c, "_new")).alias(c) for c in values]).select(*target.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def words(lines: DataFrame, column: str = "value") -> DataFrame:
    """A row for each part between single spaces, as a line splitter gives them (empty parts at the end left out)."""
    return lines.select(F.explode(F.split(F.rtrim(F.col(column)), " ")).alias("word"))


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    return words(lines, column).groupBy("word").agg(F.count("*").alias("count"))
