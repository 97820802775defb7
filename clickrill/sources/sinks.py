"""Sinks: the event store, task results, relational tables, and versioned tables for upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import day_of
from .readers import exists


def write_events(events: DataFrame, path: str) -> None:
    """Append to the store: a row for each row_key, the last by time, in folders by day; a day that is written again
    replaces itself, so reruns don't double it. A large day is dealt to several tasks, by the size of what is shuffled."""
    order = F.struct(*[c for c in sorted(events.columns) if c != "row_key"])
    one = events.groupBy("row_key").agg(F.max_by(F.struct(*events.columns), order).alias("e")).select("e.*")
    one.withColumn("day", day_of(F.col("s_time"))).hint("rebalance", "day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_task_result(result: DataFrame, path: str) -> None:
    """Results by task_id; those of a task that ran before are replaced."""
    result.write.partitionBy("task_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_table(df: DataFrame, url: str, name: str, properties: dict[str, str], batch_size: int = 1000) -> None:
    df.write.option("batchsize", batch_size).jdbc(url, name, mode="append", properties=properties)


def overwrite_table(df: DataFrame, url: str, name: str, properties: dict[str, str], keep_layout: bool = True) -> None:
    df.write.option("truncate", str(keep_layout).lower()).jdbc(url, name, mode="overwrite", properties=properties)


def execute(spark: SparkSession, url: str, statement: str, values: list, properties: dict[str, str]) -> int:
    """One statement on the database, in a transaction of its own; errors are raised after a rollback."""
    info = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        info.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, info)
    try:
        connection.setAutoCommit(False)
        prepared = connection.prepareStatement(statement)
        for i, v in enumerate(values, 1):
            prepared.setObject(i, v)
        changed = prepared.executeUpdate()
        connection.commit()
        return changed
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def delete_task(spark: SparkSession, url: str, name: str, task_id: int, properties: dict[str, str]) -> int:
    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier("task_id")
    return execute(spark, url, f"DELETE FROM {name} WHERE {column} = ?", [task_id], properties)


def replace_task(result: DataFrame, url: str, name: str, task_id: int, properties: dict[str, str]) -> None:
    """Results of a task in a table, in place of those that it has there; a table that doesn't exist is made."""
    spark = result.sparkSession
    if table_exists(spark, url, name, properties):
        delete_task(spark, url, name, task_id, properties)
    append_table(result, url, name, properties)


def table_exists(spark: SparkSession, url: str, name: str, properties: dict[str, str]) -> bool:
    found = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).getTableExistsQuery(name)
    try:
        spark.read.jdbc(url, f"({found}) probe", properties=properties)
        return True
    except Exception as e:  # a missing table, or a database that can't be reached
        if "exist" in str(e).lower():
            return False
        raise


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class VersionedTable:
    """A Parquet table in numbered versions. A writer makes the next version from the last and never overwrites what it
    reads; a version counts once its folder has the writer's success mark, so a batch that is repeated changes nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def folder(self, version: int) -> str:
        return f"{self.path}/v={version:010d}"

    def versions(self) -> list[int]:
        return self._versions()

    def _versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self, upto: int | None = None) -> DataFrame:
        found = [v for v in self._versions() if upto is None or v < upto]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1]:010d}")

    def write(self, version: int, make: Callable[[DataFrame], DataFrame], keep: int = 3) -> None:
        """Write version as make(the one before it), and drop all but the last `keep`."""
        make(self.read(upto=version)).write.mode("overwrite").parquet(f"{self.path}/v={version:010d}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for old in self._versions()[:-keep]:
            fs.delete(path(f"{self.path}/v={old:010d}"), True)
