"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and the master is local (tests), one of our own, which is
    then set; on a cluster that's an error, as executors and driver wouldn't see each other's files."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(found)
    return found


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for all that is stored inside the `with`; it is removed at its end, so what is wanted of
    the results must be written by then."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors.
    instead: a stored table that nobody reads any more, which is removed."""
    spark = df.sparkSession
    path = f"{_scratch.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if instead is not None:
        remove(spark, instead._stored_at)
    return out


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function for mapInArrow, which gives unused memory back when its task ends: the Python worker lives on, and several
    that wait for tasks would hold what their largest ones took."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)

    return tidied


#: Rows of numbers that may be sent to every task.
BROADCAST_ROWS = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A stored table of numbers, marked for broadcast if it is counted to have BROADCAST_ROWS rows at most; a larger one is
    left to be joined by shuffling."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


#: Hot keys that spread_join sends to every task, at most.
HOT_KEYS = 20_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, most: int, total: int) -> DataFrame:
    """rows joined to table (stored; a row for each key, n: how many of `rows` have it, of `total` in all), without any
    key's rows in one task if they are more than `most`, or more than one in HOT_KEYS of all. Keys with more are fewer than
    HOT_KEYS, whatever the input, and meet their rows in a broadcast."""
    most = max(most, -(-total // HOT_KEYS))
    hot = table.where(F.col(n) > most)
    if hot.isEmpty():
        return rows.join(table, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(n) <= most), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, changed until none of them is a column of df (extra columns may clash)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def rank_in(sorted_keys: list, key: Column, kind: str = "bigint") -> Column:
    """How many of the sorted literals are <= key: a binary search inside one expression. kind: the keys' type; structs are
    given as tuples of numbers. A null key: 0."""
    bits = max(1, len(sorted_keys).bit_length())
    plain = [list(x) if isinstance(x, tuple) else x for x in sorted_keys]
    if plain and isinstance(plain[0], list):
        names = [f.split(":")[0] for f in kind.removeprefix("struct<").removesuffix(">").split(",")]
        plain = [dict(zip(names, x, strict=True)) for x in plain]
    # one literal of text, not one for each key
    padded = F.from_json(F.lit(json.dumps(plain + [None] * (2**bits - 1 - len(plain)))), f"array<{kind}>")
    steps = F.array(*[F.lit(2**b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(padded, at + step - 1) <= key, step).otherwise(0))


def renamed(df: DataFrame, *keep: str) -> DataFrame:
    """df with the columns `keep` under these names (the exact name first, else in any case) and all others under names that
    nobody uses, in order; toDF with the old names brings them back."""
    at = {}
    for k in keep:
        same = [i for i, c in enumerate(df.columns) if c == k] or [i for i, c in enumerate(df.columns) if c.lower() == k.lower()]
        at[same[0]] = k
    return df.toDF(*[at.get(i, f"_column{i}_") for i in range(len(df.columns))])
