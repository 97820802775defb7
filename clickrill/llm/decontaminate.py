"""Benchmark decontamination over a distributed positional inverted index.

1. index(): the postings of every word of the training texts, a stored table with a row for each term and segment of texts
   (the documents and positions in which it occurs there). It doesn't depend on the test items and serves any number of them.
2. Each test window (13 consecutive item words; all words of a shorter item) picks its rarest terms by their postings;
   windows with a term that the corpus lacks are dropped.
3. Offset-adjusted lists: position in the document less position in the item. Where all picked terms of a window agree on
   that shift, the window is an exact candidate; where they lie within a few words of each other, one of proximity.
4. Candidates are verified on the documents' whole texts, word by word, by bytes. Hashes of words only name terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored, tidy
from .tokens import ALNUM_LOWER, chunks

WINDOW = 13
#: Rarest terms of a window whose lists are intersected.
PICKED = 3
#: Bytes of texts whose lists are rows of the index together.
SEGMENT = 8 << 20
#: Occurrences of a term in one row of the index, at most; a list of more is several rows, so none is too long for a task.
LIST = 100_000
#: Occurrences of a term that one task joins to its windows.
SHARE = 500_000


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (term, ids, positions), an entry for each occurrence, in order."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False) if not b.column(0).null_count else None
        for i, _, words in chunks(b.column(1), ALNUM_LOWER, size=SEGMENT):
            h = words.hashes.view(np.int64)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            term = h[order]
            cut = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            size = np.diff(np.r_[cut, len(term)])
            if size.max() > LIST:
                cut = np.concatenate([np.arange(a, a + n, LIST) for a, n in zip(cut, size, strict=True)])
            doc = (np.searchsorted(words.first, np.arange(len(h)), "right") - 1)[order]
            at = pa.array(np.r_[cut, len(term)].astype(np.int32))
            own = pa.array(ids[i + doc]) if ids is not None else b.column(0).take(pa.array(i + doc))
            yield pa.RecordBatch.from_arrays([pa.array(term[cut]), pa.ListArray.from_arrays(at, own), pa.ListArray.from_arrays(at, pa.array((order - words.first[doc]).astype(np.int32)))], names=["term", "ids", "positions"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored positional index of docs: (term, ids, positions), an entry of both lists for each occurrence."""
    return stored(_plain(docs, id_col, text_col, "id").mapInArrow(tidy(_postings), "term bigint, ids array<bigint>, positions array<int>"), "postings")


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (item, words, terms): the words with one space between, and their hashes."""
    for b in batches:
        joined, terms = [], []
        for i, j, words in chunks(b.column(1), ALNUM_LOWER):
            h = words.hashes.view(np.int64)
            raw, begin, end = words.joined()
            for t in range(j - i):
                a, e = words.first[t], words.first[t + 1]
                terms.append(h[a:e])
                joined.append(raw[begin[a] : end[e - 1]] if e > a else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(joined, pa.binary()).cast(pa.string()), pa.array(terms, pa.list_(pa.int64()))], names=["item", "words", "terms"])


def _windower(window: int, picked: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, words, terms, counts by position) -> a row for each window that may occur."""
        types = {"item": pa.int64(), "start": pa.int32(), "words": pa.string(), "at": pa.list_(pa.int32()), "term": pa.list_(pa.int64())}
        for b in batches:
            for k in range(b.num_rows):
                out: dict[str, list] = {f: [] for f in types}
                words, terms, counts = b.column(1)[k].as_py().split(" "), np.asarray(b.column(2)[k].values), np.asarray(b.column(3)[k].values)
                length = min(window, len(terms))
                for s in range(len(terms) - length + 1 if length else 0):
                    own = counts[s : s + length]
                    if own.min() == 0:
                        continue
                    at = s + np.sort(np.argsort(own, kind="stable")[:picked])
                    for f, v in (("item", b.column(0)[k].as_py()), ("start", s), ("words", " ".join(words[s : s + length])), ("at", at.tolist()), ("term", terms[at].tolist())):
                        out[f].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types.values(), strict=True)], names=list(out))

    return run


def windows(postings: DataFrame, items: DataFrame, window: int = WINDOW, picked: int = PICKED) -> tuple[DataFrame, DataFrame]:
    """(windows, counts): the windows of items (item, text) that may occur, each with its words, its rarest terms and their
    positions; and the occurrences of each test term that there is."""
    listed = stored(items.dropDuplicates(["item", "text"]).mapInArrow(tidy(_item_words), "item bigint, words string, terms array<bigint>"), "items")
    vocabulary = stored(listed.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = stored(postings.join(small(vocabulary), "term").groupBy("term").agg(F.sum(F.size("positions").cast("bigint")).alias("n")), "frequencies")
    at = listed.select("item", "words", "terms", F.posexplode("terms").alias("pos", "term"))
    priced = at.join(counts, "term", "left").groupBy("item", "words", "terms").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
    priced = priced.select("item", "words", "terms", F.transform("x", lambda v: v["n"]).alias("counts"))
    return stored(priced.mapInArrow(tidy(_windower(window, picked)), "item bigint, start int, words string, at array<int>, term array<bigint>"), "windows"), counts


def _agreeing(postings: DataFrame, found: DataFrame, counts: DataFrame, slop: int) -> DataFrame:
    """(id, item, shift, start, words) where all picked terms of a window lie in the document, at one shift or, with slop,
    at shifts in one cell. A term with many occurrences is dealt out by document to several tasks."""
    parts = F.ceil(F.col("n") / SHARE).cast("int")
    least = F.min(F.size("at")).over(Window.partitionBy("item")).alias("least")  # no window of the item agrees with fewer
    picks = found.select("item", least, F.explode(F.arrays_zip("at", "term")).alias("x")).select("item", "least", F.col("x.at").alias("at"), F.col("x.term").alias("term")).distinct()
    picks = stored(picks.join(counts.select("term", parts.alias("parts")), "term"), "picks")
    wanted = small(stored(picks.select("term", "parts").distinct(), "picked"))
    occurrences = postings.join(wanted, "term").select("term", "parts", F.explode(F.arrays_zip("ids", "positions")).alias("x"))
    occurrences = occurrences.select("term", F.col("x.ids").alias("id"), F.col("x.positions").alias("p"), F.pmod(F.xxhash64("x.ids"), F.col("parts")).cast("int").alias("part"))
    dealt = stored(picks.select("term", "item", "least", "at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "dealt")
    hits = occurrences.join(small(dealt), ["term", "part"]).select("id", "item", (F.col("p") - F.col("at")).alias("shift"), "at", "least")
    if slop:
        cell = F.floor(F.col("shift") / (slop + 1)).cast("int")
        hits = hits.select("id", "item", F.explode(F.array(cell, cell - 1)).alias("shift"), "at", "least")
    lines = hits.groupBy("id", "item", "shift").agg(F.collect_set("at").alias("ats"), F.first("least").alias("least")).where(F.size("ats") >= F.col("least")).select("id", "shift", "ats", F.col("item").alias("_item"))
    return lines.join(found, lines["_item"].eqNullSafe(found["item"])).where(F.size(F.array_except("at", "ats")) == 0)


def _plain(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias(name), F.col(text_col).alias("text"))


def _spread(words: list[bytes], window: list[bytes], lo: int, hi: int, slop: int) -> tuple[int, int] | None:
    """The first stretch of words beginning in [lo, hi) that has the window's words in order, with `slop` others at most."""
    for s in range(max(0, lo), min(hi, len(words) - len(window) + 1)):
        if words[s] != window[0]:
            continue
        at, left = s, iter(window[1:])
        want, stop = next(left, None), min(len(words), s + len(window) + slop)
        while want is not None and at + 1 < stop:
            at += 1
            if words[at] == want:
                want = next(left, None)
        if want is None:
            return s, at + 1
    return None


def _verifier(slop: int):
    match = pa.struct([("item", pa.int64()), ("position", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text, candidates) -> the words of the text, those hit, the items whose windows occur, and the matches."""
        for b in batches:
            n, hit, items, matches, near = [], [], [], [], []
            for i, j, found in chunks(b.column(1), ALNUM_LOWER):
                for t in range(j - i):
                    size = int(found.first[t + 1] - found.first[t])
                    covered, exact, loose = np.zeros(size + 1, np.int64), [], {}
                    asked = b.column(2)[i + t].as_py()
                    words = ALNUM_LOWER.split(b.column(1)[i + t].as_py()) if asked else []
                    for c in asked or ():
                        window, p = c["words"].encode().split(b" "), c["p"]
                        if not c["near"]:
                            if p >= 0 and words[p : p + len(window)] == window:
                                covered[p] += 1
                                covered[p + len(window)] -= 1
                                exact.append({"item": c["item"], "position": p, "length": len(window)})
                        elif (at := _spread(words, window, p - slop, p + 2 * slop + 2, slop)) and at[1] - at[0] > len(window):
                            loose[(c["item"], at)] = {"item": c["item"], "position": at[0], "length": at[1] - at[0]}
                    n.append(size)
                    hit.append(int((np.cumsum(covered) > 0).sum()) if exact else 0)
                    items.append(sorted({m["item"] for m in exact if m["item"] is not None}, key=str))
                    matches.append(sorted(exact, key=lambda m: (m["position"], str(m["item"]))))
                    near.append(sorted(loose.values(), key=lambda m: (m["position"], str(m["item"]))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(matches, pa.list_(match)), pa.array(near, pa.list_(match))], names=["id", "n_words", "n_hit", "items", "matches", "near"])

    return run


def find(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, picked: int = PICKED, slop: int = 0, postings: DataFrame | None = None) -> DataFrame:
    """id, n_words, n_hit, items (sorted as strings), matches, near (arrays of item, position, length).

    A row for each row of docs, with or without matches. Words: runs of 0-9, a-z and characters beyond ASCII, A-Z
    lower-cased. matches: exact phrases, every place of every window. near: with slop > 0, places where a window's words
    stand in order with 1 to `slop` other words among them (the first such stretch about each candidate place); they
    count in no other column. postings: the index of docs, if there is one already.
    Null texts have no words; an item without words has no window; repeated or overlapping windows count a word once.
    Rows with equal ids are looked at each by itself; a null item id is found but not listed. Empty tables: no rows, or
    rows without matches. Other columns are left out.
    """
    docs, items = _plain(docs, doc_col, text_col, "id"), _plain(items, item_col, text_col, "item")
    postings = index(docs, "id") if postings is None else postings
    found, counts = windows(postings, items, window, picked)

    def candidates(slop: int) -> DataFrame:
        base = F.col("shift") * (slop + 1) if slop else F.col("shift")
        return _agreeing(postings, found, counts, slop).select("id", _candidate(base, slop > 0).alias("c"))

    each = candidates(0).unionByName(candidates(slop)) if slop else candidates(0)
    of_id = each.groupBy("id").agg(F.collect_set("c").alias("candidates")).withColumnRenamed("id", "_id")
    joined = docs.join(of_id, docs["id"].eqNullSafe(of_id["_id"]), "left").select("id", "text", "candidates")
    match = "array<struct<item:bigint,position:int,length:int>>"
    return joined.mapInArrow(tidy(_verifier(slop)), f"id bigint, n_words bigint, n_hit bigint, items array<bigint>, matches {match}, near {match}")


def _candidate(shift: Column, near: bool) -> Column:
    return F.struct("item", (shift + F.col("start")).cast("int").alias("p"), "words", F.lit(near).alias("near"))
