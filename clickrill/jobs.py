"""Command-line jobs.

python -m clickrill.jobs etl -d 2017-07-16 --logs DIR --rules FILE --store DIR
python -m clickrill.jobs sessions|categories|areas -d TASK --store DIR (--tasks FILE --goods DIR --out DIR | --config FILE)
python -m clickrill.jobs flow|hotwords (--lines DIR | --kafka SERVERS --topics T | --socket HOST:PORT) --rules FILE --out DIR
    [--config FILE] [--interval "10 seconds"] [--stop FILE] [--starting latest|earliest|JSON]
python -m clickrill.jobs words|console (--lines DIR | --kafka ... | --socket ...) --out DIR

--config names a file of key=value lines. jdbc.url, .user, .password, .driver: tasks (spark_task) and goods (ecs_goods) are
read from that database, and results go to its tables, those of a task that ran before being replaced.
streaming.interval, streaming.stop.path, kafka.broker.list, kafka.topics stand in for the options.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .functions.parse import parse_lines
from .operators import areas, categories, geo, sessions
from .schema import AREA_TOP3, EVENT_LOG, SESSION_STAT, TASK, TOP5_CATEGORY, as_layout
from .session import quiet, session
from .sources import readers, sinks
from .streaming import jobs as streams


#: Tables of a --config database, of each batch job's results, and of the streams'.
TABLES = {"sessions": "session_aggr_stat", "categories": "top5_category", "areas": "area_top3_product", "flow": "stats_location_flow", "hotwords": "search_hot_keyword"}
LAYOUTS = {"sessions": SESSION_STAT, "categories": TOP5_CATEGORY, "areas": AREA_TOP3}


def run_date(text: str) -> dt.date:
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"{text} isn't a date like 2017-07-16") from e


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="clickrill")
    sub = p.add_subparsers(dest="job", required=True)
    etl = sub.add_parser("etl")
    etl.add_argument("-d", dest="date", type=run_date, default=dt.datetime.now(dt.timezone.utc).date() - dt.timedelta(days=1))
    for name in ("logs", "rules", "store"):
        etl.add_argument(f"--{name}", required=True)
    for job in ("sessions", "categories", "areas"):
        s = sub.add_parser(job)
        s.add_argument("-d", dest="task", type=int, required=True)
        s.add_argument("--store", required=True)
        for name in ("tasks", "goods", "out", "config"):
            s.add_argument(f"--{name}")
    for job in ("flow", "hotwords", "words", "console"):
        s = sub.add_parser(job)
        for name in ("lines", "kafka", "topics", "socket", "config", "rules", "stop"):
            s.add_argument(f"--{name}")
        s.add_argument("--out", required=True)
        s.add_argument("--starting", default="latest", help="where Kafka topics are read from when there is no checkpoint")
        s.add_argument("--checkpoint", help="<out>-checkpoint, if not given")
        s.add_argument("--interval", help="work off what is there and stop, if not given")
    found = p.parse_args(args)
    found.settings = Config.read(found.config) if getattr(found, "config", None) else Config()
    if found.job in ("sessions", "categories", "areas") and not found.settings.values:
        wanted = ["tasks", "out"] + ["goods"] * (found.job != "sessions")
        if missing := [f"--{x}" for x in wanted if getattr(found, x) is None]:
            p.error(f"{found.job} needs {', '.join(missing)}, or --config")
    if found.job in ("flow", "hotwords") and found.rules is None:
        p.error(f"{found.job} needs --rules")
    return found


def stream_lines(args: argparse.Namespace, spark: SparkSession) -> DataFrame:
    """The lines of the source that the options or the settings name."""
    if args.lines:
        return readers.file_lines(spark, args.lines)
    if args.socket:
        host, _, port = args.socket.rpartition(":")
        return readers.socket_lines(spark, host, int(port))
    servers = args.kafka or args.settings.text("kafka.broker.list")
    return readers.kafka_lines(spark, servers, args.topics or args.settings.text("kafka.topics"), args.starting)


def parsed_events(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Located events of good lines."""
    return geo.locate(parse_lines(lines).where("reject IS NULL").drop("line", "reject"), rules)


def stream_events(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """As parsed_events for a stream: the same rows."""
    return geo.locate_stream(parse_lines(lines).where("reject IS NULL").drop("line", "reject"), rules)


def run_stream(args: argparse.Namespace, spark: SparkSession) -> None:
    settings = args.settings
    interval = args.interval or (f"{settings.integer('streaming.interval')} seconds" if "streaming.interval" in settings.values else None)
    lines, checkpoint = stream_lines(args, spark), args.checkpoint or f"{args.out}-checkpoint"
    if args.job == "console":
        query = streams.console_stream(lines, checkpoint, interval)
    elif args.job == "words":
        query = streams.word_count_stream(lines, args.out, checkpoint, interval)
    else:
        publish = None
        if "jdbc.url" in settings.values:
            url, properties = settings.jdbc()
            publish = lambda table: sinks.overwrite_table(table, url, TABLES[args.job], properties)
        start = streams.flow_results if args.job == "flow" else streams.hot_words_results
        query = start(stream_events(lines, readers.ip_rules(spark, args.rules)), args.out, checkpoint, interval, publish=publish)
    streams.await_stop(query, args.stop or settings.values.get("streaming.stop.path"))


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.job == "etl":
        sinks.write_events(as_layout(parsed_events(readers.log_lines(spark, args.logs, args.date), readers.ip_rules(spark, args.rules)), EVENT_LOG), args.store)
        return
    if args.job in ("flow", "hotwords", "words", "console"):
        run_stream(args, spark)
        return
    database = args.settings.jdbc() if "jdbc.url" in args.settings.values else None
    tasks = spark.read.schema(TASK).json(args.tasks) if args.tasks else readers.table(spark, database[0], "spark_task", database[1])
    span = readers.task_params(tasks, args.task)
    columns = {"sessions": ["row_key", "uid", "sid", "s_time", "gid", "en"], "categories": ["gid", "en"], "areas": ["en", "gid", "province", "city"]}[args.job]
    events = readers.event_log(spark, args.store, columns, span["start_ms"], span["end_ms"])
    if args.job == "sessions":
        result = sessions.session_stat(events, args.task)
    else:
        goods = spark.read.parquet(args.goods) if args.goods else readers.table(spark, database[0], "ecs_goods", database[1], "goods_id")
        result = (categories.top_categories if args.job == "categories" else areas.area_top)(events, goods, args.task)
    result = as_layout(result, LAYOUTS[args.job])
    if args.out:
        sinks.write_task_result(result, args.out)
    else:
        sinks.replace_task(result, database[0], TABLES[args.job], args.task, database[1])


def main() -> None:
    args = arguments()
    spark = session(f"clickrill-{args.job}")
    quiet(spark)
    run(args, spark)


if __name__ == "__main__":
    main()
