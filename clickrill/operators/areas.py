"""Areas: the most clicked products of each province, with their cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import city_count


def clicks(events: DataFrame, names: list[str] | None = None) -> DataFrame:
    """province, city, gid of events that have a product; names: only these events."""
    out = events.where("gid IS NOT NULL")
    return (out.where(F.col("en").isin(names)) if names else out).select("province", "city", "gid")


def with_name(area_clicks: DataFrame, goods: DataFrame) -> DataFrame:
    return area_clicks.join(goods.select("goods_id", "goods_name"), F.col("gid") == F.col("goods_id")).select("province", "city", F.col("gid").alias("goods_id"), "goods_name")


def city_counts(named: DataFrame) -> DataFrame:
    return named.groupBy("province", "city", "goods_id", "goods_name").agg(F.count("*").alias("click_count"))


def product_counts(by_city: DataFrame) -> DataFrame:
    """Clicks of a product in a province, and its cities as `city:count`, comma-joined, in order."""
    cities = F.sort_array(F.collect_list(F.struct(F.col("city"), city_count(F.col("city"), F.col("click_count")).alias("text"))))
    return by_city.groupBy("province", "goods_id", "goods_name").agg(F.array_join(F.transform(cities, lambda x: x["text"]), ",").alias("city_infos"), F.sum("click_count").alias("click_count"))


def top_per_area(products: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("province").orderBy(F.desc("click_count"), "goods_id")
    return products.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def area_top(events: DataFrame, goods: DataFrame, task_id: int, k: int = 3, names: list[str] | None = None) -> DataFrame:
    """task_id, area, product_id, product_name, city_infos, click_count. Events are counted by product before they meet the
    products' names, so the join carries a row for each city and product."""
    by_city = clicks(events, names).groupBy("province", "city", "gid").agg(F.count("*").alias("click_count"))
    named = by_city.join(goods.select("goods_id", "goods_name"), F.col("gid") == F.col("goods_id")).drop("gid")
    best = top_per_area(product_counts(named), k)
    return best.select(F.lit(task_id).cast("bigint").alias("task_id"), F.col("province").alias("area"), F.col("goods_id").alias("product_id"), F.col("goods_name").alias("product_name"), "city_infos", "click_count")
