"""Categories: clicks and carts, and the five with the most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_category(events: DataFrame, goods: DataFrame) -> DataFrame:
    """Events that have a product, with its category."""
    return events.where("gid IS NOT NULL").join(goods.select("goods_id", "cat_id"), F.col("gid") == F.col("goods_id")).drop("goods_id")


def distinct_categories(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("cat_id").alias("category_id")).distinct()


def counts(joined: DataFrame, count_orders: bool = False) -> DataFrame:
    """category_id, click_count (page views), cart_count, pay_count (0, or the orders if asked for): one shuffle, counted
    before it."""
    pay = F.count_if(F.col("en") == "e_sod") if count_orders else F.lit(0).cast("bigint")
    return joined.groupBy(F.col("cat_id").alias("category_id")).agg(F.count_if(F.col("en") == "e_pv").alias("click_count"), F.count_if(F.col("en") == "e_cart").alias("cart_count"), (pay if count_orders else F.max(pay)).alias("pay_count"))


def by_category(events: DataFrame, goods: DataFrame, count_orders: bool = False) -> DataFrame:
    """counts() of all events, counted by product before they meet the products' categories."""
    each = {"click_count": "e_pv", "cart_count": "e_cart", "pay_count": "e_sod"}
    products = events.where("gid IS NOT NULL").groupBy("gid").agg(*[F.count_if(F.col("en") == en).alias(c) for c, en in each.items()])
    joined = products.join(goods.select("goods_id", "cat_id"), F.col("gid") == F.col("goods_id"))
    pay = F.sum("pay_count") if count_orders else F.max(F.lit(0).cast("bigint"))
    return joined.groupBy(F.col("cat_id").alias("category_id")).agg(F.sum("click_count").alias("click_count"), F.sum("cart_count").alias("cart_count"), pay.alias("pay_count"))


def top(table: DataFrame, k: int = 5) -> DataFrame:
    """By clicks, then carts, then orders, then the smaller id."""
    return table.orderBy(F.desc("click_count"), F.desc("cart_count"), F.desc("pay_count"), "category_id").limit(k)


def top_categories(events: DataFrame, goods: DataFrame, task_id: int, k: int = 5) -> DataFrame:
    return top(by_category(events, goods), k).select(F.lit(task_id).cast("bigint").alias("task_id"), "*")
