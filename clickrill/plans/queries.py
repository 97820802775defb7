"""Every query by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, sql, text, times
from ..operators import areas, categories, flow, geo, hotwords, sessions, tables
from ..session import work_dir
from ..sources import readers, sinks
from ..streaming import jobs
from . import adapter

TASK = 2
#: The moments at which the queries look: a week of the test events, and the end of an hour.
START_MS, END_MS = 1_704_412_800_000, 1_705_017_600_000  # 2024-01-05 .. 2024-01-12
AS_OF_MS = 1_705_017_600_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rolled(spark: SparkSession, d: str) -> DataFrame:
    return sessions.roll_up(adapter.event_log(spark, d))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return categories.with_category(adapter.event_log(spark, d), adapter.goods(spark, d))


def _by_city(spark: SparkSession, d: str) -> DataFrame:
    return areas.city_counts(areas.with_name(areas.clicks(adapter.event_log(spark, d)), adapter.goods(spark, d)))


@query
def area_top3_product(spark, d):
    return areas.area_top(adapter.event_log(spark, d), adapter.goods(spark, d), TASK)


@query
def area_click_count(spark, d):
    return _by_city(spark, d)


@query
def area_city_concat(spark, d):
    return areas.product_counts(_by_city(spark, d))


@query
def goods_join(spark, d):
    return areas.with_name(areas.clicks(adapter.event_log(spark, d)), adapter.goods(spark, d)).groupBy("goods_id", "goods_name").agg(F.count("*").alias("n"))


@query
def event_filter_range(spark, d):
    return sessions.in_range(adapter.event_log(spark, d), START_MS, END_MS).select("row_key", "en", "uid", "sid", "s_time", "gid")


@query
def session_aggregate(spark, d):
    return _rolled(spark, d)


@query
def session_stats_histogram(spark, d):
    return sessions.histogram(_rolled(spark, d))


@query
def session_ratio(spark, d):
    return sessions.session_stat(adapter.event_log(spark, d), TASK)


@query
def distinct_categories(spark, d):
    return categories.distinct_categories(_joined(spark, d))


@query
def category_click_cart(spark, d):
    return categories.by_category(adapter.event_log(spark, d), adapter.goods(spark, d))


@query
def top5_category(spark, d):
    return categories.top_categories(adapter.event_log(spark, d), adapter.goods(spark, d), TASK)


@query
def location_levels(spark, d):
    return flow.location_levels(adapter.event_log(spark, d).select("country", "province", "city", "en")).groupBy("country", "province", "city").agg(F.count("*").alias("n"))


@query
def flow_stats(spark, d):
    return flow.flow_stats(adapter.event_log(spark, d))


def _dates(spark, d, grain):
    days = adapter.event_log(spark, d).select(times.day_of(F.col("s_time")).alias("day")).distinct()
    # a fortnight around each turn of the year as well
    orders = adapter.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return tables.date_rows(days.unionByName(orders), grains=[grain])


for _grain in times.GRAINS:
    QUERIES[f"date_dimension_{_grain}"] = lambda spark, d, g=_grain: _dates(spark, d, g)


@query
def dimension_ids(spark, d):
    """Flow rows with the surrogate keys of their location, over a dimension that already has the countries."""
    stats = flow.flow_stats(adapter.event_log(spark, d))
    keys = ["country", "province", "city"]
    known = tables.get_or_create(spark.createDataFrame([], "id int, country string, province string, city string"), stats.where("province = 'all'"), keys)
    return tables.with_ids(stats, tables.get_or_create(known, stats, keys), keys, "location_dimension_id").select("day", "location_dimension_id", "pv")


@query
def hot_words_window(spark, d):
    return hotwords.trailing(hotwords.panes(adapter.event_log(spark, d)), AS_OF_MS, 7 * 86_400_000)


@query
def hot_words_top3(spark, d):
    return hotwords.top_words(hotwords.trailing(hotwords.panes(adapter.event_log(spark, d)), AS_OF_MS, 7 * 86_400_000))


@query
def word_count(spark, d):
    return tables.word_count(adapter.read(spark, d, "documents"), "text")


@query
def union_streams(spark, d):
    docs = adapter.read(spark, d, "documents").select(F.col("text").alias("value"))
    items = adapter.read(spark, d, "benchmark").select(F.col("text").alias("value"))
    return tables.word_count(tables.union_all([docs, items, items]))


def _sides(spark, d):
    """Page views of each visitor before and in the week."""
    e = adapter.event_log(spark, d).where("en = 'e_pv'")
    count = lambda x: x.groupBy("uid").agg(F.count("*").alias("pv"), F.max("s_time").alias("seen"))
    return count(e.where(F.col("s_time") < START_MS)), count(sessions.in_range(e, START_MS, END_MS))


@query
def upsert_set(spark, d):
    return tables.upsert(*_sides(spark, d), ["uid"])


@query
def upsert_increment(spark, d):
    return tables.upsert(*_sides(spark, d), ["uid"], add=["pv"])


@query
def packed_kv_get_set(spark, d):
    packed = sessions.packed_histogram(sessions.histogram(_rolled(spark, d)))
    new = text.packed_set(text.packed_set(F.col("packed"), "4s_6s", F.lit("100")), "absent", F.lit("1"))
    return packed.select("packed", text.packed_get(F.col("packed"), "session_count").alias("sessions"), text.packed_get(F.col("packed"), "absent").alias("absent"), new.alias("changed"))


@query
def task_param_json(spark, d):
    tasks = spark.createDataFrame([(1, '{"startDate":"2024-01-05 00:00:00","endDate":"2024-01-05 23:59:59"}'), (2, '{"startDate":"2024-01-05 00:00:00","endDate":"2024-01-12 00:00:00"}')], "task_id bigint, task_param string")
    span = readers.task_params(tasks, TASK)
    return sessions.in_range(adapter.event_log(spark, d), span["start_ms"], span["end_ms"]).groupBy("en").agg(F.count("*").alias("n"))


@query
def etl_parse_log(spark, d):
    parsed = parse.parse_lines(adapter.log_lines(spark, d))
    return parsed.select("line", "ip", "s_time", "en", "uid", "sid", "url", "kw", "gid", "c_id", "reject")


@query
def etl_url_params(spark, d):
    params = parse.url_params(F.get(F.split("value", " "), F.lit(3)))
    lines = adapter.log_lines(spark, d).where(F.size(F.split(F.trim("value"), " ")) == 4)
    return lines.select("event_id", params.alias("p")).select("event_id", F.explode("p").alias("name", "value"))


@query
def etl_goods_category_id(spark, d):
    parsed = parse.parse_lines(adapter.log_lines(spark, d)).where("reject IS NULL")
    return parsed.groupBy("gid", "c_id").agg(F.count("*").alias("n"))


@query
def etl_keyword(spark, d):
    return parse.parse_lines(adapter.log_lines(spark, d)).where("reject IS NULL").groupBy("kw").agg(F.count("*").alias("n"))


@query
def etl_rejects(spark, d):
    return parse.parse_lines(adapter.log_lines(spark, d)).groupBy("reject").agg(F.count("*").alias("n"))


@query
def etl_ip_to_long(spark, d):
    return adapter.event_log(spark, d).select("ip").distinct().select("ip", geo.ip_to_long(F.col("ip")).alias("n"))


@query
def geo_range_join(spark, d):
    located = geo.locate(adapter.event_log(spark, d).select("row_key", "ip"), adapter.ip_rules(spark, d))
    return located.select("row_key", "country", "province", "city")


@query
def etl_store(spark, d):
    """Lines parsed, located, written to the store by day and read back."""
    parsed = parse.parse_lines(adapter.log_lines(spark, d)).where("reject IS NULL").drop("line", "reject")
    path = work_dir(spark, "event-log")
    sinks.write_events(geo.locate(parsed, adapter.ip_rules(spark, d)), path)
    return readers.event_log(spark, path, ["en", "country", "day"], START_MS, END_MS).groupBy("en", "country", "day").agg(F.count("*").alias("n"))


@query
def row_key_crc32(spark, d):
    return adapter.event_log(spark, d).select("event_id", parse.row_key(F.col("s_time"), F.col("uid"), F.lit(None).cast("string"), F.col("en")).alias("key"))


@query
def user_agent(spark, d):
    agents = adapter.user_agents(spark, d)
    return agents.select("event_id", "agent", *[c.alias(k) for k, c in parse.user_agent(F.col("agent")).items()])


@query
def area_top3_sql(spark, d):
    """The areas' report in SQL, over views and registered functions."""
    sql.register(spark)
    sql.views(adapter.event_log(spark, d), adapter.goods(spark, d))
    return spark.sql(sql.AREA_TOP3, {"task": TASK})


@query
def geo_stream_join(spark, d):
    """The streams' join, over rules that overlap: each nation's and a wide one below all."""
    wide = spark.createDataFrame([(0, (1 << 32) - 1, "all", "all", "all")], "start_ip bigint, end_ip bigint, country string, province string, city string")
    rules = adapter.ip_rules(spark, d).unionByName(wide)
    return geo.locate_stream(adapter.event_log(spark, d).select("row_key", "ip"), rules).select("row_key", "country", "province", "city")


@query
def stats_location_flow(spark, d):
    """The flow stream's final table: metrics under the ids of their day and place."""
    path = work_dir(spark, "flow-results")
    jobs.flow_results(_event_stream(spark, d), f"{path}/rows", f"{path}/checkpoint", lateness=_SPAN).awaitTermination()
    return jobs.flow_report(spark, f"{path}/rows")


@query
def search_hot_keyword(spark, d):
    """The hot-word stream's final table: the top words of the hour up to the last search."""
    path = work_dir(spark, "hot-results")
    jobs.hot_words_results(_event_stream(spark, d), f"{path}/rows", f"{path}/checkpoint", lateness=_SPAN).awaitTermination()
    return jobs.hot_words_report(spark, f"{path}/rows")


#: The stored tables come in any order, so no event is late.
_SPAN = "3650 days"


def _event_stream(spark, d):
    return adapter.as_events(readers.parquet_stream(spark, f"{d}/events.parquet"), spark, d)


@query
def streaming_flow_stats(spark, d):
    path = work_dir(spark, "flow")
    jobs.flow_stream(_event_stream(spark, d), f"{path}/rows", f"{path}/checkpoint", lateness=_SPAN).awaitTermination()
    return jobs.flow_table(spark, f"{path}/rows")


@query
def streaming_hot_words(spark, d):
    path = work_dir(spark, "hot")
    jobs.hot_words_stream(_event_stream(spark, d), f"{path}/rows", f"{path}/checkpoint", lateness=_SPAN).awaitTermination()
    return hotwords.top_words(hotwords.trailing(jobs._latest(spark, f"{path}/rows", jobs.PANE), AS_OF_MS, 7 * 86_400_000))


@query
def streaming_word_count(spark, d):
    path = work_dir(spark, "words")
    lines = readers.parquet_stream(spark, f"{d}/documents.parquet").select(F.col("text").alias("value"))
    jobs.word_count_stream(lines, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return jobs.word_count_table(spark, f"{path}/table")


