"""Sharding by sampled splitters.

Records have a total order: by a hash of their text (equal texts side by side), then by id, then by a hash of all columns.
Records are sampled with a chance in proportion to their weight, quantiles of the sample become the boundaries of many
more ranges than shards, ranges that turn out overfull are subdivided by a sample of their own, and a running sum of
sizes over the ordered ranges cuts the shards. A boundary lies between two texts, or, in a text that a third of
all rows share, say, between two of its records. Only rows for ranges and shards reach the driver; no task gets more
than about two ranges' worth of rows, unless whole rows are repeated so often.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, rank_in, stored, unused

#: A range of more records or bytes than these is too much for one task.
ROWS_PER_RANGE = 500_000
BYTES_PER_RANGE = 512 << 20
#: Boundaries of the first sample, which every row is compared with; ranges beyond them come from subdivision.
MAX_RANGES = 4096
SAMPLE_PER_RANGE = 32
#: A group of equal texts stays in one shard unless it is more than this part of one.
WHOLE = 100


def _draw(narrow: DataFrame, weight: str, per: Column) -> Column:
    """Whether a row is drawn, with chance min(1, weight * per), by a hash of the row: the same input gives the same rows,
    however it is partitioned."""
    u = (F.pmod(F.xxhash64(*quoted(narrow.columns), F.lit("draw")), F.lit(2**52)) + 0.5) / float(2**52)
    return u < F.col(weight) * per


def splitters(narrow: DataFrame, key: str, weight: str, total: float, n_ranges: int) -> list:
    """Quantile boundaries (at most n_ranges - 1) of a Poisson sample of about SAMPLE_PER_RANGE * n_ranges rows: values of
    the column key, which may be a struct. A row heavier than a step of the sample is certain to be drawn and counts with
    its weight. Null keys are no boundaries."""
    if total <= 0 or n_ranges < 2:
        return []
    per = SAMPLE_PER_RANGE * n_ranges / total
    rows = narrow.where(_draw(narrow, weight, F.lit(per))).select(key, F.greatest(F.col(weight) * per, F.lit(1.0)).alias("w")).groupBy(key).agg(F.sum("w").alias("w")).sort(key).collect()
    step, done, out = sum(r["w"] for r in rows) / n_ranges, 0.0, []
    for r in rows:
        if done >= (len(out) + 1) * step and len(out) < n_ranges - 1 and r[0] is not None:
            out.append(r[0])
        done += r["w"]
    return list(dict.fromkeys(out))


def ranges(narrow: DataFrame, key: str, weight: str, total: float, wanted: int) -> list:
    """Boundaries of about `wanted` ranges: sampled splitters, MAX_RANGES at most, and those of a sample of each overfull
    range's own. Sorted; null keys come first."""
    cuts = splitters(narrow, key, weight, total, min(wanted, MAX_RANGES))
    (cell,) = unused(narrow, "_cell")
    celled = narrow.withColumn(cell, rank_in(cuts, F.col(key), narrow.schema[key].dataType.simpleString()))
    target, parts = total / wanted, {}
    for c, w in celled.groupBy(cell).agg(F.sum(weight)).collect():
        if w > 2 * target:
            parts[c] = math.ceil(w / target)
    if not parts:
        return cuts
    drawn = celled.where(F.col(cell).isin(*parts) & _draw(narrow, weight, F.lit(SAMPLE_PER_RANGE / target))).where(F.col(key).isNotNull())
    of_cell = drawn.groupBy(cell).agg(F.sort_array(F.collect_list(key)).alias("keys"), F.count("*").alias("n"))
    n = F.get(F.array(*[F.lit(parts.get(c, 1)) for c in range(max(parts) + 1)]), F.col(cell))
    quantiles = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda j: F.get("keys", F.floor(j * F.col("n") / n).cast("int")))
    found = of_cell.where(n > 1).select(F.explode(quantiles).alias(key)).where(F.col(key).isNotNull()).distinct()
    more = found.unionByName(_literals(narrow, key, cuts)).distinct().sort(key).collect()
    return [r[0] for r in more]


def _literals(narrow: DataFrame, key: str, values: list) -> DataFrame:
    return narrow.sparkSession.createDataFrame([(v,) for v in values], narrow.select(key).schema)


def shard(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with `size` (long, UTF-8 bytes of the text plus 1), `shard` (int) and `slot` (long), under the law `bytes`.

    Records are ordered by a hash of their text, then by id. A group of equal texts goes to the shard in whose n-th of
    the total its middle lies; the records of a group of more than a WHOLE-th of a shard are placed each by its own
    middle. So a shard's bytes differ from an equal share by less than a WHOLE-th of a share or by its first and last
    record, and a hot text is split over as many shards as it fills.
    Null text: size 1, in the group of empty texts. Null ids come first in their group. Empty table: no rows, same columns.
    Repeated rows: each is placed by itself; which of two equal rows gets which slot is immaterial. Columns of df named
    like a result are replaced.
    """
    spark, held = df.sparkSession, df.drop("shard", "slot", "size")
    key, weight, cell, run, nth, group = unused(held, "_key", "_weight", "_cell", "_run", "_nth", "_group")
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.struct(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint").alias("h"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(*quoted([f.name for f in held.schema if "map<" not in f.dataType.simpleString()])).alias("tie"))
    keyed = held.select("*", (F.octet_length(text) + 1).cast("bigint").alias("size"), order.alias(key))
    narrow = stored(keyed.select(key, "size"), "shard-keys")
    n, total = narrow.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return held.select("*", F.lit(0).cast("bigint").alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    wanted = max(16 * n_shards, math.ceil(n / ROWS_PER_RANGE), math.ceil(total / BYTES_PER_RANGE))
    #: A range is full by its bytes or by its rows, so many tiny records fill one as well.
    weighed = narrow.withColumn(weight, F.col("size") / float(total) + 1.0 / n)
    # fewer than WHOLE * n_shards groups have more than total / WHOLE / n_shards bytes
    split = sorted(r[0] for r in narrow.groupBy(F.col(key)["h"]).agg(F.sum("size").alias("b")).where(F.col("b") * (WHOLE * n_shards) > total).collect())
    large = F.col(key)["h"].isin(*split) if split else F.lit(False)
    cuts = ranges(weighed, key, weight, 2.0, wanted)
    inside = set(split)
    #: Boundaries inside a group that stays whole move to its beginning.
    starts = list(dict.fromkeys((c["h"], c["id"], c["tie"]) if c["h"] in inside else (c["h"], None, None) for c in cuts))
    at = rank_in(starts, F.col(key), narrow.schema[key].dataType.simpleString())

    def celled(x: DataFrame) -> DataFrame:
        return x.withColumn(cell, at)

    before, b, r = [], 0, 0
    for c, size, rows in sorted(map(tuple, celled(narrow).groupBy(cell).agg(F.sum("size"), F.count("*")).collect())):
        before.append((c, b, r))
        b, r = b + size, r + rows
    base = F.broadcast(spark.createDataFrame(before, f"{cell} int, {run} bigint, {nth} bigint"))  # a row for each range
    along = Window.partitionBy(cell).orderBy(key, "size")
    mates = Window.partitionBy(cell, group)

    def placed(x: DataFrame) -> DataFrame:
        """Ranges are joined to their offsets after the window: the rows of a range are summed once, in one task."""
        x = celled(x).withColumn("slot", F.row_number().over(along).cast("bigint")).withColumn("shard", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        # groups that are split need no sum: their rows don't wait for each other
        x = x.withColumn(group, F.struct(F.col(key)["h"], F.when(large, F.col(key)["id"]), F.when(large, F.col(key)["tie"])))
        twice = F.when(large, 2 * F.col("shard") - F.col("size")).otherwise(2 * F.max("shard").over(mates) - F.sum("size").over(mates))
        x = x.withColumn("shard", twice).join(base, cell).withColumn("slot", F.col("slot") + F.col(nth) - 1)
        return x.withColumn("shard", (F.col("shard") + 2 * F.col(run)) * n_shards).withColumn("shard", F.expr(f"least({n_shards - 1}, shard div {2 * total})").cast("int"))

    least = placed(narrow).groupBy("shard").agg(F.min("slot").alias("slot")).collect()
    zero = [0] * n_shards
    for x in least:
        zero[x["shard"]] = x["slot"]
    out = placed(keyed).withColumn("slot", F.col("slot") - F.get(F.array(*[F.lit(x).cast("bigint") for x in zero]), F.col("shard")))
    return out.select(*quoted(held.columns), "size", "shard", "slot")
