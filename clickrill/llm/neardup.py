"""Near-duplicate detection by bottom-k sketches from one hash function.

1. A text's set is its distinct word shingles, hashed once to 64 bits under a key drawn for each call, so nobody can write
   texts whose shingles share hashes. Its sketch is the SKETCH smallest; texts with equal sets are one class from here on.
2. Inverted lists of the LISTED smallest values bring classes together. Of the LISTED smallest values of a union, each lies
   in the intersection with chance J, so a pair of similarity t shares no listed value with chance (1 - t) ** LISTED
   (2.6e-7 at 0.85, 2.6e-6 at 0.8, falling fast above). Long lists are dealt into cells by set size, as sets whose sizes
   differ by more than the threshold can't be linked, and by hash; a cell has a bounded number of sets and of values;
   cells meet in pairs, so no task gets an unbounded list and no list is capped.
3. In each cell pair the union sketch estimates the similarity; pairs far below the threshold go. A pair at the threshold
   goes with chance MISS at most, by the binomial distribution of shared values.
4. Full sets of the classes that are left confirm links. Each cell pair reports only a spanning forest of its links.
5. Components come from alternating large-star and small-star steps over the forest edges.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, spread_join, stored, tidy
from .tokens import SPACED_LOWER, Words, chunks, mix

SKETCH = 32
LISTED = 8
#: Classes in a cell, and values of their sets, at most (but one set is never cut).
CELL = 512
CELL_VALUES = 4 << 20
#: Pairs whose sketches are compared at once.
PAIRS = 8192
#: Chance that the sketches let a pair at the threshold go.
MISS = 1e-7
#: Edges of one node in one task, from which on they are spread.
HUB = 1_000


def least_shared(percent: int) -> int:
    """Of the SKETCH smallest values of a union, fewer are shared by a pair at the threshold with chance MISS at most."""
    t, below = percent / 100, 0.0
    for c in range(SKETCH):
        below += math.comb(SKETCH, c) * t**c * (1 - t) ** (SKETCH - c)
        if below > MISS:
            return max(1, c)
    return SKETCH


def _sets(words: Words, i: int, length: int, shingles: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of the i-th text; fewer words than a shingle: the whole sequence as one."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    if b - a >= length:
        return np.unique(shingles[a : b - length + 1])
    if b == a:
        return np.zeros(0, np.uint64)
    out = np.zeros(1, np.uint64)
    for h in words.hashes[a:b]:
        out = mix(out * np.uint64(31) + h)
    return mix(out + np.uint64(b - a))


def _sketcher(length: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sig, sketch, low = [], [], [], []
            for i, j, words in chunks(b.column(1), SPACED_LOWER, key):
                shingles = words.windows(length)
                for t in range(j - i):
                    s = _sets(words, t, length, shingles)
                    n.append(len(s))
                    sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sketch.append(s[:SKETCH].tobytes())
                    low.append(s[:LISTED].astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary()), pa.array(low, pa.list_(pa.int64()))], names=["id", "n", "sig", "sketch", "low"])

    return run


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of two padded sketch matrices (pad: 2**64 - 1): the union sketch's estimate, and the smallest common value."""
    top = np.uint64(2**64 - 1)
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
    nth = np.cumsum(~same, axis=1)  # of the distinct values
    k = np.minimum((a != top).sum(1), (b != top).sum(1)).clip(1)
    # a set of fewer than SKETCH values is whole, so the union is known as far as the other sketch reaches
    full = np.maximum((a != top).sum(1), (b != top).sum(1)).clip(1)
    k = np.where(k < a.shape[1], full, k)
    shared = (same & (nth <= k[:, None])).sum(1)
    least = np.where(same, both, top).min(1)
    return shared / k, least


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows sorted by g, a group at a time."""
    held: dict[str, list] = {}
    for b in batches:
        cols = {f: b.column(f).to_pylist() for f in b.schema.names}
        g = cols["g"]
        cuts = [i for i in range(1, len(g)) if g[i] != g[i - 1]]
        for s, e in zip([0, *cuts], [*cuts, len(g)], strict=True):
            if e == s:
                continue
            if held and held["g"][-1] != g[s]:
                yield held
                held = {}
            part = {f: v[s:e] for f, v in cols.items()}
            held = {f: held[f] + v for f, v in part.items()} if held else part
    if held:
        yield held


def _flagger(num: int):
    floor = least_shared(num)
    top = np.uint64(2**64 - 1)

    def matrix(sketches: list[bytes]) -> np.ndarray:
        out = np.full((len(sketches), SKETCH), top, np.uint64)
        for i, s in enumerate(sketches):
            x = np.frombuffer(s, np.uint64)
            out[i, : len(x)] = x
        return out

    def near(n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(n[p], n[q]) >= num * np.maximum(n[p], n[q])

    def flush(todo: list[dict[str, list]]) -> Iterator[pa.RecordBatch]:
        """Small groups together: pairs of all of them in one go."""
        if not todo:
            return
        g = [x for d in todo for x in d["g"]]
        m, n = matrix([x for d in todo for x in d["sketch"]]), np.array([x for d in todo for x in d["n"]])
        v = np.array([x for d in todo for x in d["v"]], np.int64).view(np.uint64)
        sig, at, ps, qs = [x for d in todo for x in d["sig"]], 0, [], []
        for d in todo:
            p, q = np.triu_indices(len(d["g"]), 1)
            ps.append(p + at)
            qs.append(q + at)
            at += len(d["g"])
        hit = flags(m, n, v, np.concatenate(ps), np.concatenate(qs))
        yield result(g, sig, hit)

    def flags(m, n, v, p, q) -> np.ndarray:
        hit = np.zeros(len(n), bool)
        for s in range(0, len(p), PAIRS):
            a, b = p[s : s + PAIRS], q[s : s + PAIRS]
            ok = near(n, a, b)
            a, b = a[ok], b[ok]
            est, least = estimate(m[a], m[b])
            whole = (m[a, -1] != top) & (m[b, -1] != top)  # smaller sets are all there, and left to the full comparison
            ok = np.where(whole, est * SKETCH >= floor - 0.5, est > 0) & (least == v[a])  # a pair is looked at where its smallest common value is listed
            hit[a[ok]] = hit[b[ok]] = True
        return hit

    def result(g, sig, hit) -> pa.RecordBatch:
        on = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([pa.array([g[i] for i in on], pa.int64()), pa.array([sig[i] for i in on], pa.binary())], names=["g", "sig"])

    def large(d: dict[str, list]) -> Iterator[pa.RecordBatch]:
        m, n, v = matrix(d["sketch"]), np.array(d["n"]), np.array(d["v"], np.int64).view(np.uint64)
        shared = _shared([x[x != top] for x in m])
        whole = m[:, -1] != top
        p, q = np.nonzero(np.triu(shared >= np.where(whole[:, None] & whole[None, :], floor, 1), 1))
        yield result(d["g"], d["sig"], flags(m, n, v, p, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo, pairs = [], 0
        for d in _groups(batches):
            if len(d["g"]) > 64:
                yield from large(d)
            elif len(d["g"]) > 1:
                todo.append(d)
                pairs += len(d["g"]) ** 2 // 2
                if pairs > PAIRS:
                    yield from flush(todo)
                    todo, pairs = [], 0
        yield from flush(todo)

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the values that occur more than once."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    new = np.cumsum(often) - 1
    keep = often[value]
    owner, value = owner[keep], new[value[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    for s in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(value, [s, s + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], value[a:b] - s] = 1
        out += m @ m.T
    return out


def _setter(length: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, sig, gs) -> a row (g, sig, set) for each g."""
        for b in batches:
            gs, sigs = b.column(2), b.column(1)
            for i, j, words in chunks(b.column(0), SPACED_LOWER, key):
                shingles = words.windows(length)
                g, sig, sets, held = [], [], [], 0
                for t in range(j - i):
                    s = _sets(words, t, length, shingles).tobytes()
                    own = sigs[i + t].as_py()
                    if hashlib.blake2b(s, digest_size=16).digest() != own:
                        continue  # another row with the same id
                    for x in gs[i + t].as_py():
                        g.append(x)
                        sig.append(own)
                        sets.append(s)
                        held += len(s)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], names=["g", "sig", "set"])
                            g, sig, sets, held = [], [], [], 0
                if g:
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], names=["g", "sig", "set"])

    return run


def _confirmer(num: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of each group's exact links."""
        for d in _groups(batches):
            sets = dict(zip(d["sig"], d["set"], strict=True))
            sigs, sets = list(sets), [np.frombuffer(s, np.uint64) for s in sets.values()]
            if len(sigs) < 2:
                continue
            n = np.array([len(s) for s in sets])
            if len(sigs) <= 6:
                shared = np.zeros((len(sigs), len(sigs)))
                for p in range(len(sigs)):
                    for q in range(p):
                        shared[p, q] = shared[q, p] = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            else:
                shared = _shared(sets)
            linked = 100 * shared >= num * (n[:, None] + n[None, :] - shared)
            left, a, b = np.ones(len(sigs), bool), [], []
            for root in range(len(sigs)):
                if not left[root]:
                    continue
                left[root] = False
                open_ = [root]
                while open_:
                    p = open_.pop()
                    new = np.flatnonzero(linked[p] & left)
                    left[new] = False
                    open_.extend(new)
                    a += [sigs[p]] * len(new)
                    b += [sigs[q] for q in new]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node of the component; only nodes that have an edge. Large-star and small-star
    steps alternate until the edges stay as they are. Minima are aggregated before the shuffle, and the edges of a node that
    has very many meet its minimum in a broadcast of such nodes."""
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    before = None

    def met(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
        if n <= HUB:  # so few edges are a task's work in any case
            return rows.join(least, "u")
        return spread_join(rows, stored(least, "least"), "u", "n", HUB, n)

    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before, n = mark, mark[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = met(both.where("v > u"), least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = met(large, least, n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges", instead=now)
        remove(large.sparkSession, large._stored_at)


def link(df: DataFrame, length: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: the classes of texts linked by 100 * |A & B| >= percent * |A | B|.

    Sets: distinct shingles of `length` words after lower-casing A-Z; fewer words: the whole sequence. A null or wordless
    text has an empty set, links with nothing and is its own component. component_id: the smallest id reachable;
    kept: id = component_id. Rows with the same id and text get equal results (both kept, if it is the smallest); a null
    id counts as no id, and is kept if its component has none. Empty table: no rows. Other columns are left out.
    """
    rows, secret = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), secrets.randbits(64)
    schema = "id bigint, n bigint, sig binary, sketch binary, low array<bigint>"
    sketched = stored(rows.mapInArrow(tidy(_sketcher(length, secret)), schema), "sketches")
    best = F.min(F.struct("id", "n", "sketch", "low"))
    classes = sketched.where("n > 0 AND id IS NOT NULL").groupBy("sig").agg(best.alias("x")).select("sig", F.col("x.id").alias("rep"), "x.n", "x.sketch", "x.low")
    classes = stored(classes, "classes")
    bucket = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100) + 1e-9).cast("int")
    listed = classes.select("sig", "n", bucket.alias("b"), F.explode("low").alias("v"))
    # classes of a bucket in a cell: fewer, where their sets are large
    fit = F.least(F.lit(CELL), F.greatest(F.lit(1), F.floor(F.lit(float(CELL_VALUES)) / F.pow(F.lit(100 / percent), F.col("b") + 1)))).cast("int")
    cells = listed.groupBy("v", "b").agg(F.count("*").alias("c")).withColumn("fit", fit)
    lists = cells.groupBy("v").agg(F.sum("c").alias("total"), F.sum(F.col("c") / F.col("fit")).alias("full"), F.map_from_entries(F.collect_list(F.struct("b", F.ceil(F.col("c") / F.col("fit")).cast("int")))).alias("salts")).where("total > 1")
    entries = classes.agg(F.sum(F.size("low").cast("bigint"))).first()[0] or 0
    met = spread_join(listed, stored(lists, "lists"), "v", "total", CELL, entries)
    salts = lambda d: F.coalesce(F.try_element_at("salts", F.col("b") + d), F.lit(0))
    own = F.pmod(F.xxhash64("sig"), salts(0)).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda *x: F.xxhash64("v", *x)
    pairs = F.concat(
        F.transform(upto(salts(0)), lambda s: key("b", F.least(own, s), F.col("b"), F.greatest(own, s))),
        F.transform(upto(salts(1)), lambda s: key("b", own, F.col("b") + 1, s)),
        F.transform(upto(salts(-1)), lambda s: key(F.col("b") - 1, s, F.col("b"), own)),
    )
    dealt = met.select("sig", "v", F.explode(F.when(F.col("full") <= 1, F.array(F.xxhash64("v"))).otherwise(pairs)).alias("g"))
    dealt = dealt.join(classes.select("sig", "n", "sketch"), "sig").repartition("g").sortWithinPartitions("g")
    flagged = stored(dealt.select("g", "v", "sig", "n", "sketch").mapInArrow(tidy(_flagger(percent)), "g bigint, sig binary"), "flagged")
    wanted = flagged.groupBy("sig").agg(F.collect_set("g").alias("gs")).join(classes.select("sig", F.col("rep").alias("id")), "sig")
    sets = rows.join(wanted, "id").select("text", "sig", "gs").mapInArrow(tidy(_setter(length, secret)), "g bigint, sig binary, set binary")
    edges = sets.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(_confirmer(percent)), "a binary, b binary")
    found = components(edges)
    of_class = classes.select("sig", "rep").join(found.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
    least = of_class.groupBy("root").agg(F.min("rep").alias("component"))
    named = of_class.join(least, "root").select("sig", "component")
    out = sketched.select("id", "n", "sig").join(named, "sig", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").eqNullSafe(component)).alias("kept"))
