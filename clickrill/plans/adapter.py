"""The test tables as the inputs of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_events(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_log rows of a batch or stream of test events. The ip is a number of the visitor's nation."""
    # by parts: the same in any session time zone
    millis = F.expr("unix_date(CAST(ts AS DATE)) * 86400000L + (hour(ts) * 60L + minute(ts)) * 60000L + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT)")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    en = F.when(kind == "signup", "e_l").when(kind == "view", "e_pv").when(kind == "click", "e_cart").when(kind == "purchase", "e_sod").otherwise("e_e")
    place = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    place = place.select("c_custkey", "c_nationkey", F.col("r_name").alias("country"), F.col("n_name").alias("province"), F.col("c_mktsegment").alias("city"))
    x = events.join(place, F.col("user_id") == F.col("c_custkey"), "left").withColumn("s_time", millis)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("s_time") / 86_400_000).cast("int"))
    return x.select(
        F.format_string("%013d_%d", "s_time", "event_id").alias("row_key"), en.alias("en"), F.col("user_id").cast("string").alias("uid"), F.concat(F.col("user_id").cast("string"), F.lit("_"), F.replace(day.cast("string"), F.lit("-"), F.lit(""))).alias("sid"),
        "s_time", "country", "province", "city", F.when(kind.isin("view", "click", "purchase"), k).alias("gid"), F.when(kind == "view", F.concat(F.lit("w"), (k % 20).cast("string"))).alias("kw"),
        F.concat_ws(".", (F.coalesce("c_nationkey", F.lit(200)) + 10).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("0"), (F.col("event_id") % 256).cast("string")).alias("ip"), "event_id",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(read(spark, sf_dir, "events"), spark, sf_dir)


def goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("goods_id"), F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("bigint").alias("cat_id"), F.col("p_name").alias("goods_name"))


def ip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each nation: the addresses whose first number is its key and 10; the upper half of the /8 isn't covered."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    start = ((F.col("n_nationkey") + 10) * (1 << 24)).cast("bigint")
    return n.select(start.alias("start_ip"), (start + (1 << 22) - 1).alias("end_ip"), F.col("r_name").alias("country"), F.col("n_name").alias("province"), F.lit("main").alias("city"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log lines of the events, some of them broken."""
    e = event_log(spark, sf_dir)
    seconds = F.concat((F.floor(F.col("s_time") / 1000)).cast("string"), F.lit("."), F.lpad((F.col("s_time") % 1000).cast("string"), 3, "0"))
    url = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("http%3A%2F%2Fshop%2Fgoods.php%3Fid%3D"), F.coalesce(F.col("gid").cast("string"), F.lit("x")))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("http%3A%2F%2Fshop%2Fcategory.php%3Fid%3D"), (F.col("event_id") % 25).cast("string"), F.lit("%26a"))).otherwise(F.lit("http%3A%2F%2Fshop%2Fsearch.php"))
    request = F.concat(F.lit("/log.gif?en="), F.col("en"), F.lit("&ver=1&pl=website&uid="), F.col("uid"), F.lit("&sid="), F.col("sid"), F.lit("&url="), url, F.lit("&tt=find_"), F.coalesce("kw", F.lit("")), F.lit("_page&&a=&=b"))
    line = F.concat_ws(" ", "ip", seconds, F.lit("host1"), request)
    return e.select("event_id", F.when(F.col("event_id") % 97 == 0, F.lit("  ")).when(F.col("event_id") % 89 == 0, F.concat(line, F.lit(" more"))).when(F.col("event_id") % 83 == 0, F.replace(line, F.lit("en=e_"), F.lit("en=q_"))).otherwise(line).alias("value"))


def user_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-agent string for each event, of eight kinds by its number."""
    n = F.col("event_id")
    version = F.concat((n % 90 + 10).cast("string"), F.lit(".0."), (n % 7).cast("string"))
    kinds = [
        ("Mozilla/5.0 (Windows NT 6.1; Win64; x64) Engine/1 Chrome/", " Safari/537"), ("Mozilla/5.0 (Linux; Android 9; Tablet) Engine/1 Chrome/", " Safari/537"),
        ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Engine/2 Version/", " Safari/605"), ("Mozilla/5.0 (X11; Linux x86_64; rv:9) Firefox/", ""),
        ("Mozilla/5.0 (Windows NT 10.0) Engine/1 Chrome/90 Safari/537 Edg/", ""), ("Mozilla/4.0 (compatible; MSIE ", "; Windows NT 5.1)"), ("spider/", " (+http://crawl.example)"), ("plain tool ", ""),
    ]
    agent = F.lit(None).cast("string")
    for i, (before, after) in enumerate(kinds):
        agent = F.when(n % 8 == i, F.concat(F.lit(before), version, F.lit(after))).otherwise(agent)
    return read(spark, sf_dir, "events").select("event_id", agent.alias("agent"))
