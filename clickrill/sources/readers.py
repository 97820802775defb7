"""Sources: log files, IP rules, the event store, relational tables, tasks and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_param
from ..functions.times import to_millis
from ..operators.sessions import in_range
from ..schema import IP_RULE


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def log_path(root: str, date: dt.date) -> str:
    """<root>/yyyy/MM/dd: reading one day reads one folder."""
    return f"{root.rstrip('/')}/{date:%Y/%m/%d}"


def log_lines(spark: SparkSession, root: str, date: dt.date) -> DataFrame:
    path = log_path(root, date)
    if not exists(spark, path):
        raise FileNotFoundError(f"no logs at {path}")
    return spark.read.text(path)


def ip_rules(spark: SparkSession, path: str) -> DataFrame:
    """`start|end|start number|end number|continent|country|province|city|...` lines."""
    return spark.read.csv(path, sep="|", schema=IP_RULE).select("start_ip", "end_ip", "country", "province", "city")


def event_log(spark: SparkSession, path: str, columns: list[str], start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Columns of the events in [start, end), from a store partitioned by `day`; range and columns reach the scan."""
    events = spark.read.parquet(path)
    if start_ms is not None and end_ms is not None:
        events = in_range(events, start_ms, end_ms, "day" if "day" in events.columns else None)
    return events.select(*columns)


def table(spark: SparkSession, url: str, name: str, properties: dict[str, str], key: str | None = None, lower: int = 0, upper: int = 1_000_000, partitions: int = 2, bounded: bool = False) -> DataFrame:
    """A relational table, whole; with `key`, read in strides of it. bounded: keys outside [lower, upper] are left out."""
    if key is None:
        return spark.read.jdbc(url, name, properties=properties)
    out = spark.read.jdbc(url, name, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties)
    return out.where(F.col(key).between(lower, upper)) if bounded else out


def task_params(tasks: DataFrame, task_id: int) -> dict[str, int]:
    """start_ms and end_ms of a task's JSON parameters. A task that is missing or has no dates raises."""
    found = tasks.where(F.col("task_id") == task_id).select(*[to_millis(json_param(F.col("task_param"), k), "yyyy-MM-dd HH:mm:ss").alias(k) for k in ("startDate", "endDate")]).take(1)
    if not found:
        raise LookupError(f"task {task_id} doesn't exist")
    if found[0]["startDate"] is None or found[0]["endDate"] is None:
        raise ValueError(f"task {task_id} has no startDate or endDate")
    return {"start_ms": found[0]["startDate"], "end_ms": found[0]["endDate"]}


def kafka_lines(spark: SparkSession, servers: str, topics: str, starting: str = "latest", **options: str) -> DataFrame:
    """A Kafka stream's values as text. starting: latest, earliest, or JSON offsets, for the first start; afterwards the
    checkpoint decides. Offsets that the brokers have dropped are skipped, not fatal."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting).option("failOnDataLoss", "false")
    return reader.options(**options).load().selectExpr("CAST(value AS STRING) AS value")


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of a Parquet table, be it one file or a folder of files."""
    schema = spark.read.parquet(path).schema
    folder, glob = (path, "*.parquet") if is_folder(spark, path) else path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)
