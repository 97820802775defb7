"""Streaming queries. Each gives the same answer as its batch operator over the same events.

Grouped counts live in Spark's state store (evicted by watermark); foreachBatch lays the changed rows under the batch's
number, so a repeated batch replaces itself, and readers take the latest row of each key. Every COMPACT batches the log is
folded into one table. flow_results and hot_words_results keep the final tables as well. A batch without rows changes
nothing, but for the first, which leaves empty tables.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import GRAINS, day_of
from ..operators import flow, hotwords, tables
from ..schema import DATE_DIMENSION, HOT_KEYWORD, LOCATION_DIMENSION, LOCATION_FLOW, as_layout
from ..sources.readers import exists
from ..sources.sinks import VersionedTable, remove

LEAF = ["day", "country", "province", "city", "sid", "uid"]
PANE = ["pane", "day", "country", "province", "city", "keyword"]


def _start(stream: DataFrame, batch, checkpoint: str, mode: str, interval: str | None) -> StreamingQuery:
    """interval None: work off what is there and stop."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


#: Batches between two foldings of a change log.
COMPACT = 32


def _changes(path: str, keys: list[str] | None = None):
    """Lays a batch's rows under its number; with keys, the log is folded from time to time."""

    def batch(df: DataFrame, number: int) -> None:
        if number and df.isEmpty():
            return
        df.write.mode("overwrite").parquet(f"{path}/batch={number:010d}")
        if keys and number % COMPACT == COMPACT - 1:
            compact(df.sparkSession, path, keys, number)

    return batch


def _folded(spark: SparkSession, path: str, schema: str | None = None) -> VersionedTable:
    return VersionedTable(spark, f"{path}-folded", schema or "batch int")


def _written(spark: SparkSession, path: str) -> list[str]:
    """The folders of batches that are written to their ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [f"{path}/{n}" for n in sorted(names) if n.startswith("batch=") and exists(spark, f"{path}/{n}/_SUCCESS")]


def _latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key, over the batches that are done."""
    changes, folded = spark.read.option("basePath", path).parquet(*_written(spark, path)), _folded(spark, path)
    values = [c for c in changes.columns if c not in [*keys, "batch"]]
    if versions := folded.versions():
        base = spark.read.parquet(folded.folder(versions[-1])).withColumn("batch", F.lit(versions[-1]))
        changes = changes.where(F.col("batch") > versions[-1]).unionByName(base)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def compact(spark: SparkSession, path: str, keys: list[str], upto: int) -> None:
    """Fold the batches up to `upto` into one table, and drop those that a folding before it has. Batches of the last
    folding stay, as they may be read now or repeated."""
    folded = _folded(spark, path)
    before = folded.versions()
    folded.write(upto, lambda _: _latest(spark, path, keys))
    for n in range(max(0, upto - 2 * COMPACT + 1), (before[-1] if before else -1) + 1):
        remove(spark, f"{path}/batch={n:010d}")


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_millis("s_time"))


def _flow_rows(events: DataFrame, lateness: str) -> DataFrame:
    timed = with_event_time(events).withWatermark("event_time", lateness)
    counted = timed.groupBy(F.window("event_time", "1 day").alias("w"), "country", "province", "city", "sid", "uid").agg(F.count("*").alias("n"), F.count_if(F.col("en") == "e_pv").alias("pv"), F.count_if(F.col("en") == "e_l").alias("nu"))
    return counted.select(day_of(F.unix_millis(F.col("w.start"))).alias("day"), *LEAF[1:], "n", "pv", "nu")


def flow_stream(events: DataFrame, path: str, checkpoint: str, interval: str | None = None, lateness: str = "2 days") -> StreamingQuery:
    """Counts by day, city, session and visitor. Events later than `lateness` behind the newest one are dropped."""
    return _start(_flow_rows(events, lateness), _changes(path, LEAF), checkpoint, "update", interval)


def flow_table(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of all events so far."""
    return flow.metrics(_latest(spark, path, LEAF))


def _hot_rows(events: DataFrame, lateness: str) -> DataFrame:
    timed = with_event_time(events.where("kw IS NOT NULL")).withWatermark("event_time", lateness)
    counted = timed.groupBy(F.window("event_time", f"{hotwords.PANE_MS} milliseconds").alias("w"), "country", "province", "city", F.col("kw").alias("keyword")).agg(F.count("*").alias("count"))
    return counted.select(F.unix_millis(F.col("w.end")).alias("pane"), day_of(F.unix_millis(F.col("w.start"))).cast("string").alias("day"), *PANE[2:], "count")


def hot_words_stream(events: DataFrame, path: str, checkpoint: str, interval: str | None = None, lateness: str = "2 hours") -> StreamingQuery:
    return _start(_hot_rows(events, lateness), _changes(path, PANE), checkpoint, "update", interval)


def hot_words_table(spark: SparkSession, path: str, as_of_ms: int, k: int = 3) -> DataFrame:
    return hotwords.top_words(hotwords.trailing(_latest(spark, path, PANE), as_of_ms), k)


def word_count_stream(lines: DataFrame, path: str, checkpoint: str, interval: str | None = None, running: bool = True) -> StreamingQuery:
    """running: counts over all batches, kept in the state store, of which a batch writes those that it changes; else each
    batch's own, below batch=<number>."""
    if not running:
        return _start(lines, lambda df, n: _changes(path)(tables.word_count(df), n), checkpoint, "append", interval)
    return _start(tables.word_count(lines), _changes(path, ["word"]), checkpoint, "update", interval)


def word_count_table(spark: SparkSession, path: str) -> DataFrame:
    """The counts so far; empty before the first batch."""
    return _latest(spark, path, ["word"]) if _written(spark, path) else spark.createDataFrame([], "word string, count bigint")


class FlowTables:
    """The final tables of the flow stream below a folder: both dimensions and stats_location_flow."""

    def __init__(self, spark: SparkSession, path: str):
        self.dates = VersionedTable(spark, f"{path}/dimension_date", DATE_DIMENSION)
        self.places = VersionedTable(spark, f"{path}/dimension_location", LOCATION_DIMENSION)
        self.stats = VersionedTable(spark, f"{path}/stats_location_flow", LOCATION_FLOW)

    def update(self, number: int, metrics: DataFrame) -> None:
        """Lay metrics over the table as its version `number`, with new days and places in the dimensions. A batch that is
        repeated finds the versions before it and makes the same ones again."""
        keys = [*GRAINS, "calendar", "type"]
        self.dates.write(number, lambda old: tables.get_or_create(old, tables.date_rows(metrics, grains=["day"]), keys))
        self.places.write(number, lambda old: tables.get_or_create(old, metrics, PANE[2:5]))
        days = self.dates.read(number + 1).where("type = 'day'").select(F.col("id").alias("date_dimension_id"), F.col("calendar").alias("day"))
        rows = tables.with_ids(metrics.join(days, "day"), self.places.read(number + 1), PANE[2:5], "location_dimension_id").withColumn("created", F.current_date())
        self.stats.write(number, lambda old: tables.upsert(old, as_layout(rows, LOCATION_FLOW), ["date_dimension_id", "location_dimension_id"]))


def flow_results(events: DataFrame, path: str, checkpoint: str, interval: str | None = None, lateness: str = "2 days", publish: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """flow_stream with its final tables below <path>-tables. Each batch recounts the days that it changes and lays them over
    stats_location_flow by both ids; publish gets that table after each batch."""
    spark = events.sparkSession
    out, log = FlowTables(spark, f"{path}-tables"), _changes(path, LEAF)

    def batch(df: DataFrame, number: int) -> None:
        df.persist()  # written, and its days looked at
        try:
            log(df, number)
            if number and df.isEmpty():
                return
            days = F.broadcast(df.select("day").distinct())  # days of one batch
            out.update(number, flow.metrics(_latest(spark, path, LEAF).join(days, "day", "left_semi")))
            if publish:
                publish(out.stats.read())
        finally:
            df.unpersist()

    return _start(_flow_rows(events, lateness), batch, checkpoint, "update", interval)


def flow_report(spark: SparkSession, path: str) -> DataFrame:
    """stats_location_flow with the days and places of its ids."""
    out = FlowTables(spark, f"{path}-tables")
    days = out.dates.read().where("type = 'day'").select(F.col("id").alias("date_dimension_id"), "calendar")
    places = out.places.read().withColumnRenamed("id", "location_dimension_id")
    return out.stats.read().join(days, "date_dimension_id").join(places, "location_dimension_id").select(F.col("calendar").alias("day"), "country", "province", "city", "uv", "pv", "nu", "sn", "on")


def hot_words_results(events: DataFrame, path: str, checkpoint: str, interval: str | None = None, lateness: str = "2 hours", k: int = 3, publish: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """hot_words_stream with its final table below <path>-tables: the top words of the hour up to the newest pane, made anew by
    each batch that has searches; publish gets it too."""
    spark = events.sparkSession
    log, out = _changes(path, PANE), VersionedTable(spark, f"{path}-tables/search_hot_keyword", HOT_KEYWORD)

    def batch(df: DataFrame, number: int) -> None:
        log(df, number)
        if df.isEmpty():
            return
        panes = _latest(spark, path, PANE)
        newest = panes.agg(F.max("pane")).first()[0]
        top = hotwords.top_words(hotwords.trailing(panes, newest), k)
        out.write(number, lambda _: as_layout(top, HOT_KEYWORD))
        if publish:
            publish(out.read())

    return _start(_hot_rows(events, lateness), batch, checkpoint, "update", interval)


def hot_words_report(spark: SparkSession, path: str) -> DataFrame:
    return VersionedTable(spark, f"{path}-tables/search_hot_keyword", HOT_KEYWORD).read()


def batch_counts_stream(lines: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """The number of rows of each batch, empty ones too, below batch=<number>."""

    def batch(df: DataFrame, number: int) -> None:
        df.agg(F.count("*").alias("count")).write.mode("overwrite").parquet(f"{path}/batch={number:010d}")

    return _start(lines, batch, checkpoint, "append", interval)


def several(*batches: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch function of many; the batch is computed once and kept until the last is done."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            for b in batches:
                b(df, number)
        finally:
            df.unpersist()

    return batch


def console_stream(stream: DataFrame, checkpoint: str, interval: str | None = None, rows: int = 10, mode: str = "append") -> StreamingQuery:
    """Print the first rows of each batch."""
    writer = stream.writeStream.format("console").outputMode(mode).option("numRows", rows).option("truncate", "false").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def offset_ranges(query: StreamingQuery) -> list[dict]:
    """Of each batch that the query still remembers: its number, rows, and each source's first and last offsets, as JSON."""
    return [{"batch": p.batchId, "rows": p.numInputRows, "sources": [{"source": s.description, "from": s.startOffset, "to": s.endOffset} for s in p.sources]} for p in query.recentProgress]


def await_stop(query: StreamingQuery, stop_file: str | None = None, every: float = 5.0) -> None:
    """Wait for the query's end, or stop it, after its running batch, once the stop file exists."""
    if stop_file is None:
        query.awaitTermination()
        return
    pause = threading.Event()
    while not query.awaitTermination(every):
        if exists(query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active(), stop_file):
            while query.status["isTriggerActive"] and query.isActive:
                pause.wait(0.2)
            query.stop()
            return
