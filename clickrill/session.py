"""The session, and the folder for tables that must outlive a task."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(app: str = "clickrill", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; master and sizes come from spark-submit or conf."""
    builder = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def quiet(spark: SparkSession, level: str = "WARN") -> None:
    spark.sparkContext.setLogLevel(level)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a local master's below
    /tmp/checkpoints; on a cluster that's an error, as executors wouldn't see each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base}/{name}-{uuid.uuid4().hex}"
