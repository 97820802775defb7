"""Sources, sinks, streams and jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from clickrill import jobs
from clickrill.operators import flow, tables
from clickrill.plans import adapter
from clickrill.sources import readers, sinks
from clickrill.streaming import jobs as streams

DERBY = "jdbc:derby:memory:shop;create=true"
DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
SF = "/root/testdata/sf0.001"


def test_relational_tables(spark):
    goods = spark.createDataFrame([(i, i % 3, f"g{i}") for i in (*range(1, 9), 2_000_000)], "goods_id bigint, cat_id bigint, goods_name string")
    sinks.overwrite_table(goods, DERBY, "goods", DRIVER)
    assert readers.table(spark, DERBY, "goods", DRIVER).count() == 9
    strided = readers.table(spark, DERBY, "goods", DRIVER, "goods_id", bounded=True)
    assert strided.count() == 8 and strided.rdd.getNumPartitions() == 2
    result = spark.createDataFrame([(1, 5), (2, 6)], "task_id bigint, n bigint")
    sinks.overwrite_table(result, DERBY, "result", DRIVER)
    sinks.append_table(result, DERBY, "result", DRIVER)
    assert sinks.delete_task(spark, DERBY, "result", 2, {}) == 2
    assert readers.table(spark, DERBY, "result", DRIVER).count() == 2
    with pytest.raises(Exception, match="(?i)nothing"):
        sinks.execute(spark, DERBY, "DELETE FROM nothing", [], {})


def test_tasks(spark):
    tasks = spark.createDataFrame([(1, '{"endDate":"2021-03-05 06:30:00","startDate":"2021-03-04 12:00:00"}'), (2, '{"x":1}')], "task_id bigint, task_param string")
    assert readers.task_params(tasks, 1) == {"start_ms": 1614859200000, "end_ms": 1614925800000}
    with pytest.raises(LookupError):
        readers.task_params(tasks, 7)
    with pytest.raises(ValueError):
        readers.task_params(tasks, 2)


def test_event_store_upserts_and_prunes(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    log = adapter.event_log(spark, SF).drop("event_id")
    sinks.write_events(log.unionByName(log), path)
    assert spark.read.parquet(path).count() == log.count()
    sinks.write_events(log.where(F.col("s_time") < 1_704_153_600_000), path)  # a day again: the others stay
    assert spark.read.parquet(path).count() == log.count()
    part = readers.event_log(spark, path, ["en"], 1_704_153_600_000, 1_704_240_000_000)
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "ReadSchema: struct<en:string,s_time:bigint>" in plan
    assert part.count() == log.where("s_time >= 1704153600000 AND s_time < 1704240000000").count()


def test_task_results_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    for task, n in ((1, 3), (2, 4), (1, 5)):
        sinks.write_task_result(spark.range(n).select(F.lit(task).cast("bigint").alias("task_id"), "id"), path)
    assert {r[0]: r[1] for r in spark.read.parquet(path).groupBy("task_id").count().collect()} == {1: 5, 2: 4}


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, f"file://{tmp_path}/t", "word string, count bigint")
    add = lambda old: tables.upsert(old, spark.createDataFrame([("a", 1)], "word string, count bigint"), ["word"], add=["count"])
    for version in (0, 1, 1, 2, 3, 4):  # a batch that is repeated counts once
        t.write(version, add)
    assert [tuple(r) for r in t.read().collect()] == [("a", 5)]
    assert len(t._versions()) == 3


def split_events(spark, tmp_path, n=4):
    """The events in n files, in time order."""
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts")
    step = -(-len(rows) // n)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    for i in range(n):
        spark.createDataFrame(rows.iloc[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in{i}")
    return [tmp_path / f"in{i}" for i in range(n)]


def test_streams_equal_batches_across_restarts(spark, tmp_path):
    """The stream stops and starts again from its checkpoint as files arrive."""
    source, out = tmp_path / "source", f"file://{tmp_path}/flow"
    source.mkdir()
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    for k, part in enumerate(split_events(spark, tmp_path)):
        for f in part.glob("*.parquet"):
            (source / f"{k}.parquet").write_bytes(f.read_bytes())
        stream = adapter.as_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), spark, SF)
        streams.flow_stream(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
        streams.hot_words_stream(stream, f"{out}/hot", f"{out}/hot-checkpoint").awaitTermination()
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    log = adapter.event_log(spark, SF)
    assert same(flow.flow_stats(log), streams.flow_table(spark, f"{out}/rows"))
    from clickrill.operators import hotwords

    last = (log.agg(F.max("s_time")).first()[0] // 4000 + 1) * 4000
    assert same(hotwords.top_words(hotwords.trailing(hotwords.panes(log), last)), streams.hot_words_table(spark, f"{out}/hot", last))


def test_word_streams(spark, tmp_path):
    source = tmp_path / "lines"
    source.mkdir()
    for k, text in enumerate(["a b a", "b c"]):
        (source / f"{k}.txt").write_text(text)
        streams.word_count_stream(readers.file_lines(spark, str(source)), f"file://{tmp_path}/w", f"file://{tmp_path}/c").awaitTermination()
        streams.word_count_stream(readers.file_lines(spark, str(source)), f"file://{tmp_path}/w2", f"file://{tmp_path}/c2", running=False).awaitTermination()
    assert {r["word"]: r["count"] for r in streams.word_count_table(spark, f"file://{tmp_path}/w").collect()} == {"a": 2, "b": 2, "c": 1}
    assert {(r["batch"], r["word"]): r["count"] for r in spark.read.parquet(f"file://{tmp_path}/w2").collect()} == {(0, "a"): 2, (0, "b"): 1, (1, "b"): 1, (1, "c"): 1}


def test_jobs(spark, tmp_path):
    day = tmp_path / "logs/2021/03/04"
    day.mkdir(parents=True)
    lines = [f"1.0.1.{i % 9} {1614816000 + 40 * i}.000 h /log.gif?en={'e_pv' if i % 3 else 'e_cart'}&uid=u{i % 5}&sid=s{i % 7}&url=http%3A%2F%2Fx%2Fgoods.php%3Fid%3D{i % 4}" for i in range(60)]
    (day / "a.log").write_text("\n".join([*lines, "broken"]))
    (tmp_path / "rules").write_text("1.0.1.0|1.0.3.255|16777472|16778239|Nowhere|Atlantis|North|Harbour||net|1|Atlantis|AT|1.5|2.5\n")
    (tmp_path / "tasks.json").write_text(json.dumps({"task_id": 3, "task_param": '{"startDate":"2021-03-04 00:00:00","endDate":"2021-03-05 00:00:00"}'}))
    spark.createDataFrame([(i, i % 2, f"g{i}") for i in range(4)], "goods_id bigint, cat_id bigint, goods_name string").write.parquet(f"file://{tmp_path}/goods")
    run = lambda *a: jobs.run(jobs.arguments(list(a)), spark)
    run("etl", "-d", "2021-03-04", "--logs", f"file://{tmp_path}/logs", "--rules", f"file://{tmp_path}/rules", "--store", f"file://{tmp_path}/store")
    for job in ("sessions", "categories", "areas"):
        run(job, "-d", "3", "--store", f"file://{tmp_path}/store", "--tasks", f"file://{tmp_path}/tasks.json", "--goods", f"file://{tmp_path}/goods", "--out", f"file://{tmp_path}/{job}")
    assert spark.read.parquet(f"file://{tmp_path}/sessions").first()["session_count"] == 7
    assert spark.read.parquet(f"file://{tmp_path}/categories").count() == 2
    assert {r["area"] for r in spark.read.parquet(f"file://{tmp_path}/areas").collect()} == {"North"}
    run("flow", "--lines", f"file://{day}", "--rules", f"file://{tmp_path}/rules", "--out", f"file://{tmp_path}/flow", "--checkpoint", f"file://{tmp_path}/cp")
    assert streams.flow_table(spark, f"file://{tmp_path}/flow").where("city = 'Harbour'").first()["sn"] == 7
    with pytest.raises(FileNotFoundError):
        run("etl", "-d", "2021-03-05", "--logs", f"file://{tmp_path}/logs", "--rules", "x", "--store", "y")
    with pytest.raises(SystemExit):
        jobs.arguments(["sessions", "--store", "x"])
    assert jobs.arguments(["etl", "--logs", "a", "--rules", "b", "--store", "c"]).date == dt.datetime.now(dt.timezone.utc).date() - dt.timedelta(days=1)


def test_jobs_on_a_database(spark, tmp_path):
    """Tasks and goods from a database that a settings file names, results into it; a task that runs again replaces its own."""
    url = "jdbc:derby:memory:jobs;create=true"
    (tmp_path / "conf").write_text(f"# settings\njdbc.url={url}\njdbc.driver={DRIVER['driver']}\n")
    start = 1614816000000
    events = [(f"{i}", "e_pv" if i % 3 else "e_cart", f"u{i % 5}", f"s{i % 7}", start + 40_000 * i, "C", "P", "X", i % 4) for i in range(60)]
    log = spark.createDataFrame(events, "row_key string, en string, uid string, sid string, s_time bigint, country string, province string, city string, gid bigint")
    sinks.write_events(log, f"file://{tmp_path}/store")
    sinks.overwrite_table(spark.createDataFrame([(3, '{"startDate":"2021-03-04 00:00:00","endDate":"2021-03-05 00:00:00"}')], "task_id bigint, task_param string"), url, "spark_task", DRIVER)
    sinks.overwrite_table(spark.createDataFrame([(i, i % 2, f"g{i}") for i in range(4)], "goods_id bigint, cat_id bigint, goods_name string"), url, "ecs_goods", DRIVER)
    for job in ("sessions", "categories", "areas", "areas"):
        jobs.run(jobs.arguments([job, "-d", "3", "--store", f"file://{tmp_path}/store", "--config", str(tmp_path / "conf")]), spark)
    read = lambda name: readers.table(spark, url, name, DRIVER)
    assert read("session_aggr_stat").first()["session_count"] == 7
    assert read("top5_category").count() == 2 and read("area_top3_product").count() == 3
    day = tmp_path / "in"
    day.mkdir()
    (day / "a").write_text("\n".join(f"1.0.1.{i} 1614816000.000 h /log.gif?en=e_pv&uid=u{i}&sid=s{i}" for i in range(5)))
    (tmp_path / "rules").write_text("a|b|16777472|16778239|x|C|P|X\n")
    jobs.run(jobs.arguments(["flow", "--lines", f"file://{day}", "--rules", f"file://{tmp_path}/rules", "--out", f"file://{tmp_path}/flow", "--config", str(tmp_path / "conf")]), spark)
    assert sorted(r["pv"] for r in read("stats_location_flow").collect()) == [5, 5, 5]


def test_job_sources(spark, tmp_path):
    made = []

    class Reader:
        def __getattr__(self, name):
            def call(*a, **k):
                made.append((name, *a, *sorted(k.items())))
                return self

            return call

    class Session:
        readStream = Reader()

    conf = tmp_path / "conf"
    conf.write_text("kafka.broker.list=b1:9092,b2:9092\nkafka.topics=logs\nstreaming.interval=4\n")
    args = jobs.arguments(["console", "--out", "o", "--config", str(conf), "--starting", '{"logs":{"0":7}}'])
    jobs.stream_lines(args, Session())
    assert ("format", "kafka") in made and ("option", "kafka.bootstrap.servers", "b1:9092,b2:9092") in made and ("option", "subscribe", "logs") in made
    assert ("option", "startingOffsets", '{"logs":{"0":7}}') in made and ("option", "failOnDataLoss", "false") in made
    made.clear()
    jobs.stream_lines(jobs.arguments(["words", "--out", "o", "--socket", "h:99"]), Session())
    assert ("format", "socket") in made and ("option", "port", 99) in made
    for bad in (["flow", "--out", "o", "--lines", "x"], ["areas", "-d", "1", "--store", "s", "--tasks", "t", "--out", "o"]):
        with pytest.raises(SystemExit):
            jobs.arguments(bad)


def test_socket_lines(spark, tmp_path):
    """A stream of lines from a socket, printed and counted."""
    import socketserver
    import threading
    import time

    class Handler(socketserver.BaseRequestHandler):
        def handle(self):
            self.request.sendall(b"a b\nb c\n")
            time.sleep(20)

    server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    out, seen = f"file://{tmp_path}/w", {}
    query = streams.word_count_stream(readers.socket_lines(spark, "127.0.0.1", server.server_address[1]), out, f"file://{tmp_path}/c", "200 milliseconds")
    for _ in range(100):
        seen = {r["word"]: r["count"] for r in streams.word_count_table(spark, out).collect()}
        if seen:
            break
        time.sleep(0.2)
    query.stop()
    server.shutdown()
    assert seen == {"a": 1, "b": 2, "c": 1}


def test_stream_events_equal_batch_events_where_rules_overlap(spark, tmp_path):
    source = tmp_path / "lines"
    source.mkdir()
    (source / "a").write_text("\n".join(f"{ip} 1614816000.000 h /log.gif?en=e_pv&uid=u{i}" for i, ip in enumerate(["10.0.0.9", "10.0.1.7", "10.255.255.255", "192.168.1.1", "11.0.0.1", "9.255.255.255", "12.0.0.0", "x"])))
    rules = spark.createDataFrame([(167772160, 184549375, "A", "wide", "x"), (167772416, 167772671, "A", "narrow", "y"), (167772160, 201326591, "A", "wider", "z"), (9, 3, "bad", "bad", "bad")], "start_ip bigint, end_ip bigint, country string, province string, city string")
    batch = jobs.parsed_events(spark.read.text(f"file://{source}"), rules)
    got = []
    query = jobs.stream_events(readers.file_lines(spark, f"file://{source}"), rules).writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, got)) == sorted(map(str, batch.select(*got[0].__fields__).collect()))
    assert len(got) == 8 and {r["province"] for r in got} == {"wide", "narrow", "wider", "unknown"}


def test_final_tables_of_streams(spark, tmp_path):
    """Batches lay their days over the tables; ids stay; what is published is the table; a quiet batch changes nothing."""
    source, out, published = tmp_path / "source", f"file://{tmp_path}/flow", []
    source.mkdir()
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    ids = {}
    for k, part in enumerate(split_events(spark, tmp_path, 3)):
        for f in part.glob("*.parquet"):
            (source / f"{k}.parquet").write_bytes(f.read_bytes())
        stream = adapter.as_events(spark.readStream.schema(schema).parquet(str(source)), spark, SF)
        streams.flow_results(stream, out, f"{out}-checkpoint", publish=lambda t: published.append(t.count())).awaitTermination()
        streams.hot_words_results(stream, f"{out}-hot", f"{out}-hot-checkpoint").awaitTermination()
        places = {tuple(r)[1:]: r["id"] for r in streams.FlowTables(spark, f"{out}-tables").places.read().collect()}
        assert all(places[x] == i for x, i in ids.items()) and len(set(places.values())) == len(places)
        ids = places
    log = adapter.event_log(spark, SF)
    same = lambda a, b: sorted(str(tuple(r)) for r in a.collect()) == sorted(str(tuple(r)) for r in b.select(*a.columns).collect())
    assert same(flow.flow_stats(log), streams.flow_report(spark, out))
    assert published == sorted(published) and len(published) == 3
    from clickrill.operators import hotwords

    last = (log.where("kw IS NOT NULL").agg(F.max("s_time")).first()[0] // 4000 + 1) * 4000
    assert same(hotwords.top_words(hotwords.trailing(hotwords.panes(log), last)), streams.hot_words_report(spark, f"{out}-hot"))
    tables_ = streams.FlowTables(spark, f"{out}-tables")
    versions = tables_.stats.versions()
    tables_.update(versions[-1], flow.flow_stats(log).limit(5))  # the last batch again
    assert tables_.stats.versions() == versions


def test_change_logs_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT", 2)
    path = f"file://{tmp_path}/log"
    batch = streams._changes(path, ["k"])
    for n in range(9):
        batch(spark.createDataFrame([(n % 3, n), (7, n)], "k int, v int"), n)
    batch(spark.createDataFrame([], "k int, v int"), 9)
    assert {r["k"]: r["v"] for r in streams._latest(spark, path, ["k"]).collect()} == {0: 6, 1: 7, 2: 8, 7: 8}
    left = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "log").glob("batch=*"))
    assert left[0] >= 4 and left[-1] == 8


def test_stream_lifecycle(spark, tmp_path):
    """Counts of each batch, offsets, printing, several outputs of one batch, and the stop file."""
    source = tmp_path / "lines"
    source.mkdir()
    (source / "a").write_text("one\ntwo\nthree")
    lines = readers.file_lines(spark, str(source))
    query = streams.batch_counts_stream(lines, f"file://{tmp_path}/n", f"file://{tmp_path}/c1")
    query.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/n").collect()] == [(3, 0)]
    ranges = streams.offset_ranges(query)
    assert ranges[0]["batch"] == 0 and ranges[0]["rows"] == 3 and ranges[0]["sources"][0]["to"]
    query = streams.console_stream(lines, f"file://{tmp_path}/c2")
    query.awaitTermination()
    assert "Console" in query.lastProgress.sink.description and query.lastProgress.numInputRows == 3
    seen = []
    both = streams.several(lambda df, n: seen.append(df.count()), lambda df, n: seen.append(df.storageLevel.useMemory))
    lines.writeStream.foreachBatch(both).option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start().awaitTermination()
    assert seen == [3, True]
    stop = tmp_path / "stop"
    query = streams.word_count_stream(lines, f"file://{tmp_path}/w", f"file://{tmp_path}/c4", "100 milliseconds")
    stop.write_text("")
    streams.await_stop(query, str(stop), 0.5)
    assert not query.isActive
