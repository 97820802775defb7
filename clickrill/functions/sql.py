"""Functions and views for SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, parameters, result and body of each function (fixed values: the first two names).
FUNCTIONS = [
    ("concat_city_clickCount", "city STRING, n BIGINT", "STRING", "concat(coalesce(city, 'null'), ':', CAST(n AS STRING))"),
    ("group_concat", "parts ARRAY<STRING>", "STRING", "array_join(array_sort(parts), ',')"),
    ("group_concat_distinct", "parts ARRAY<STRING>", "STRING", "array_join(array_sort(array_distinct(parts)), ',')"),
    ("ip_to_long", "ip STRING", "BIGINT", "CASE WHEN ip RLIKE r'^[0-9]{1,3}(\\.[0-9]{1,3}){3}$' THEN aggregate(split(ip, r'\\.'), 0L, (n, part) -> n * 256 + CAST(part AS BIGINT)) END"),
    ("packed_value", "packed STRING, name STRING", "STRING", "try_element_at(filter(transform(split(packed, r'\\|'), f -> split(f, '=')), p -> size(p) = 2 AND p[0] = name AND p[1] <> ''), 1)[1]"),
]

#: The three most clicked products of each province with their cities; events are counted before they meet the names.
AREA_TOP3 = """
WITH by_city AS (SELECT province, city, gid, count(*) AS n FROM event_log WHERE gid IS NOT NULL GROUP BY province, city, gid),
named AS (SELECT province, city, goods_id, goods_name, n FROM by_city JOIN goods ON gid = goods_id),
products AS (SELECT province, goods_id, goods_name, group_concat(collect_list(concat_city_clickCount(city, n))) AS city_infos, sum(n) AS click_count FROM named GROUP BY province, goods_id, goods_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY province ORDER BY click_count DESC, goods_id) AS nth FROM products)
SELECT CAST(:task AS BIGINT) AS task_id, province AS area, goods_id AS product_id, goods_name AS product_name, city_infos, click_count FROM ranked WHERE nth <= 3
"""


def register(spark: SparkSession) -> None:
    """The functions, for this session. group_concat takes what collect_list makes: group_concat(collect_list(x))."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def views(events: DataFrame, goods: DataFrame) -> None:
    """The inputs under the names that SQL text uses: event_log and goods."""
    events.createOrReplaceTempView("event_log")
    goods.createOrReplaceTempView("goods")
