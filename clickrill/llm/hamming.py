"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments of about log2(rows) - 2 bits (4 to 16), so a list holds a few codes. Two codes that differ in
fewer than m * (r + 1) bits agree to within r bits in at least one segment, so probing every segment's inverted lists up to
radius r finds every code nearer than that. The radius grows, ring by ring, until more than k rows nearer than m * (r + 1)
are verified, for each query by itself; finished queries leave the search.
A list is stored in rows of up to LIST codes; a probe meets list rows, and only the codes within the query's best distance
so far leave them. Equal codes are one class with their k + 1 smallest ids: enough for the exact answer under the order
(distance, id), and a vector that a third of the rows share stays one entry.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LIST = 256


def _bits(embedding: Column, dims: int, width: int, one: Column) -> Column:
    """Array of numbers of `width` bits: bit i is set if component i is above 0 (missing, null, NaN: not set)."""
    x = lambda i: F.get(embedding, F.lit(i))
    bit = lambda i: F.when((x(i) > 0) & ~F.isnan(x(i)), F.shiftleft(one, i % width)).otherwise(one - one)
    out = []
    for at in range(0, dims, width):
        number = bit(at)
        for i in range(at + 1, min(at + width, dims)):
            number = number.bitwiseOR(bit(i))
        out.append(number)
    return F.array(*out)


def sign_code(embedding: Column, dims: int) -> Column:
    """The code as array<bigint>, 64 components in each."""
    return _bits(embedding, dims, 64, F.lit(1).cast("bigint"))


def distance(a: Column, b: Column, dims: int) -> Column:
    out = F.lit(0)
    for i in range(-(-dims // 64)):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, dims: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance (bits): each query's k nearest other rows by (distance, id).

    Codes have a bit for each component of the longest vector, or `dims` bits; a vector with more than dims components raises.
    queries: rows of the same layout. Rows with a null id or a null or empty vector are no neighbours and get none. Fewer
    than k others: all of them. A row with the query's own id isn't its neighbour; repeated rows count once. Empty: no rows.
    """
    usable = lambda df: df.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0))
    n, longest = usable(vectors).agg(F.count("*"), F.max(F.size(vector_col))).first()
    longest = max(longest or 1, usable(queries).agg(F.max(F.size(vector_col))).first()[0] or 1)
    if dims is not None and longest > dims:
        raise ValueError(f"a vector has {longest} components, not {dims}")
    dims = dims or longest
    size = max(4, min(16, round(math.log2(n + 1)) - 2))
    m = -(-dims // size)
    coded = lambda df: usable(df).select(F.col(id_col).cast("bigint").alias("id"), sign_code(F.col(vector_col), dims).alias("code"), _bits(F.col(vector_col), dims, size, F.lit(1)).alias("segs"))
    rows, asked = stored(coded(vectors).distinct(), "codes"), stored(coded(queries).distinct(), "asked")
    #: The smallest ids of each code: in parts first, then merged, so a hot code sends a few ids from each part.
    order = Window.partitionBy("code", "part").orderBy("id")
    few = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    classes = few.groupBy("code", "segs").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    classes = stored(classes.select("code", "segs", "ids", F.size("ids").alias("n"), F.col("ids")[0].alias("least")), "classes")
    entries = classes.select("code", F.posexplode("segs").alias("seg", "val"))
    # lists of more than LIST codes are dealt out, and so are their probes
    long = stored(entries.groupBy("seg", "val").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts")).where("parts > 1"), "long")
    cut = not long.isEmpty()

    def part(own: DataFrame, at: Column) -> DataFrame:
        """own with the part of its list that the row goes to; at: one of 0 .. parts - 1, or an array of all."""
        return own.join(long, ["seg", "val"], "left").withColumn("part", at).drop("parts") if cut else own.withColumn("part", F.lit(0))

    parts = F.coalesce("parts", F.lit(1))
    dealt = part(entries, F.pmod(F.xxhash64("code"), parts).cast("int"))
    index = stored(dealt.groupBy("seg", "val", "part").agg(F.collect_list("code").alias("codes")), "lists")
    open_ = stored(asked.select(F.col("code").alias("q"), "segs", F.lit(dims).alias("within")).distinct(), "open")
    best, found, done = Window.partitionBy("q").orderBy("d", "least"), None, []
    for radius in range(size + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(size), radius)]
        probes = open_.select("q", "within", F.posexplode("segs").alias("seg", "own")).select("q", "within", "seg", "own", F.explode(F.array(*[F.lit(x) for x in masks])).alias("mask"))
        probes = probes.select("q", "within", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("val"))
        # probes are many times the rows that they come from, which size estimates miss: no broadcast
        met = part(probes, F.explode(F.sequence(F.lit(0), parts - 1))).hint("merge").join(index, ["seg", "val", "part"])
        near = F.filter(F.transform("codes", lambda c: F.struct(distance(F.col("q"), c, dims).alias("d"), c.alias("code"))), lambda x: x["d"] <= F.col("within"))
        new = met.select("q", F.explode(near).alias("x")).select("q", "x.code", "x.d").distinct().join(classes.drop("segs"), "code").select("q", "code", "d", "ids", "n", "least")
        old = new.limit(0) if found is None else found.join(open_.select("q"), "q")
        kept = old.unionByName(new).dropDuplicates(["q", "code"]).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
        found = stored(kept, "found")
        covered = m * (radius + 1)
        sums = found.groupBy("q").agg(F.sum(F.when(F.col("d") < covered, F.col("n")).otherwise(0)).alias("sure"), F.sum("n").alias("all"), F.max("d").alias("far"))
        state = open_.join(sums, "q", "left")
        left = state.where(F.coalesce("sure", F.lit(0)) <= k).select("q", "segs", F.when(F.col("all") > k, F.col("far")).otherwise(F.lit(dims)).cast("int").alias("within"))
        left = stored(left, "open")
        done.append(found.join(left.select("q"), "q", "left_anti"))
        open_ = left
        if radius == size or left.isEmpty():
            done.append(found.join(left.select("q"), "q"))
            break
    answers = done[0]
    for x in done[1:]:
        answers = answers.unionByName(x)
    pairs = asked.select("id", F.col("code").alias("q")).join(answers, "q").select(F.col("id").alias("query_id"), "d", F.explode("ids").alias("neighbor_id")).where("query_id != neighbor_id")
    nearest = Window.partitionBy("query_id").orderBy("d", "neighbor_id")
    ranked = pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "neighbor_id", F.col("d").cast("int").alias("distance"))
