"""Repeated word windows (substring dedup) by level-wise doubling.

Rung 1 looks at windows of half the wanted length. Only sampled ones are needed: every wanted window contains the window
that has the smallest hash of those inside it, its anchor, and equal windows have equal anchors, so a wanted window can
repeat only if its anchor does. Rung 2 extends the repeated anchors to twice the length, all positions, and finds for
each window whether it starts earlier. That settles which words go: longer repeats cover no word that the wanted length
doesn't, so dedup() stops there. ladder() climbs on for the lengths of repeats: windows whose two halves both repeated are
named by their halves' names, those that repeat again are kept, and so on until no candidates survive.

Hashes of words only choose candidates. Two windows count as equal if the 128-bit BLAKE2b digests of their bytes are equal
(words joined by one space), in one chunk of texts as well as between chunks.

Occurrences inside one chunk of texts are aggregated before they are shuffled, and an anchor that a task has met twice is
known to repeat and sends only a count at the task's end. Windows meet by their anchor; those of an anchor with more
than a bounded number of places (boilerplate beside ever different words) meet by their own name, all over the cluster.
Documents are told apart by (id, 64-bit hash of the text). Texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .tokens import SPACED, Words, chunks, mix

WORDS = 20
#: An anchor with more places than this is a hot one; in large corpora it takes more, so that HOT_ANCHORS is never passed.
HOT_PLACES = 20_000
#: Hot anchors, at most: they are sent to all tasks, 8 bytes each. A text has at most an anchor for each 2 bytes.
HOT_ANCHORS = 4_000_000
#: Repeated anchors that a task remembers (24 bytes each).
KNOWN = 500_000
_RUNG1 = ["h", "id", "t", "pos", "n", "more"]
_RUNG1_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
#: Position of a row that only counts places.
_COUNT = -(2**31)
_NAME = np.dtype([("o", "u1"), ("h", "<u8"), ("g", "<u8")])
_ZSTD = pa.Codec("zstd", 3)


def _valid(words: Words, length: int) -> np.ndarray:
    """Which window starts have their whole window in one text."""
    n = max(0, len(words.hashes) - length + 1)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    return doc[:n] == doc[length - 1 : length - 1 + n]


def _anchors(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of `length` words, the anchor (window of half as many) of each, and all anchor hashes."""
    half = length // 2
    h, valid = words.windows(half), _valid(words, length)
    if not len(valid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    starts = np.flatnonzero(valid)
    view = np.lib.stride_tricks.sliding_window_view(h, length - half + 1)
    return starts, (np.argmin(view, axis=1)[: len(valid)] + np.arange(len(valid)))[starts], h


class _Known:
    """Anchors that a task has met twice, with the places met since; and those of the chunk before."""

    def __init__(self):
        self.hashes, self.places, self.before = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def which(self, h: np.ndarray) -> np.ndarray:
        """Where in `hashes` each of h is; -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.searchsorted(self.hashes, h).clip(max=len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def add(self, sent: np.ndarray, twice: np.ndarray) -> None:
        """sent: sorted hashes of the chunk that were sent; twice: those that it has more than once."""
        new = np.union1d(sent[twice], np.intersect1d(sent, self.before, assume_unique=True))
        self.before = sent
        if len(self.hashes) + len(new) <= KNOWN:
            hashes = np.concatenate([self.hashes, new])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.places = hashes[order], np.concatenate([self.places, np.zeros(len(new), np.int64)])[order]


def _rung1(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, t, text) -> (h, id, t, pos, n, more): a row for each anchor hash of a chunk, at its first place there, with n
        places in all, and pos as -1 - pos if there are more. Places that are known to repeat need no meeting: they
        come packed by document (more: int32 positions) under a key of the document's own, and are counted at the end."""
        known = _Known()

        def row(h, ids, ts, pos, n, more=None) -> pa.RecordBatch:
            cols = [h, ids, ts, pos, n, more if more is not None else pa.nulls(len(h), pa.binary())]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, _RUNG1_TYPES, strict=True)], names=_RUNG1)

        for b in batches:
            ids, ts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for i, _, words in chunks(b.column(2), SPACED):
                _, anchor, h = _anchors(words, length)
                if not len(anchor):
                    continue
                at = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
                at = at[np.argsort(h[at], kind="stable")]
                key = h[at]
                new = np.r_[True, key[1:] != key[:-1]]
                first = np.flatnonzero(new)
                n = np.diff(np.r_[first, len(at)])
                old = known.which(key[first])
                known.places[old[old >= 0]] += n[old >= 0]
                doc = np.searchsorted(words.first, at, "right") - 1
                pos = (at - words.first[doc]).astype(np.int32)
                sent, twice = first[old < 0], n[old < 0] > 1
                known.add(key[sent], twice)
                d = i + doc[sent]
                yield row(key[sent].view(np.int64), ids[d], ts[d], np.where(twice, -1 - pos[sent], pos[sent]), n[old < 0])
                alone = np.zeros(len(at), bool)
                alone[sent] = True
                rest = np.flatnonzero(~alone)
                if len(rest):
                    rest = rest[np.argsort(doc[rest], kind="stable")]
                    d, p = doc[rest], pos[rest]
                    cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                    more = [x.tobytes() for x in np.split(p, cut[1:])]
                    d = i + d[cut]
                    own = mix(ids[d].view(np.uint64) ^ mix(ts[d].view(np.uint64))).view(np.int64)
                    yield row(own, ids[d], ts[d], p[cut], np.zeros(len(d), np.int64), pa.array(more, pa.binary()))
        met = known.places > 0
        for s in range(0, int(met.sum()), 10_000):
            h, n = known.hashes[met][s : s + 10_000].view(np.int64), known.places[met][s : s + 10_000]
            yield row(h, np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.full(len(h), _COUNT, np.int32), n)

    return run


def _repeated(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of _rung1 sorted by h -> the places (id, t, pos) of the hashes that have more than one, and (h, h, -1) for
        those with more than `hot`."""
        last, so_far = None, 0  # the hash of the row before, and its places
        place, waiting = None, None  # the hash of the place before, and the place itself if it stands alone so far

        def places(ids, ts, pos) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ts), pa.array(pos.astype(np.int32))], names=["id", "t", "pos"])

        for b in batches:
            packed = b.column("more").is_valid()
            known = b.filter(packed)
            if known.num_rows:
                more = [np.frombuffer(x.as_py(), np.int32) for x in known.column("more")]
                n = [len(x) for x in more]
                yield places(np.repeat(known.column("id").to_numpy(), n), np.repeat(known.column("t").to_numpy(), n), np.concatenate(more))
            b = b.filter(pc.invert(packed))
            if not b.num_rows:
                continue
            h, n = b.column("h").to_numpy(), b.column("n").to_numpy()
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            upto = np.add.reduceat(n, first)
            before = so_far if h[0] == last else 0
            upto[0] += before
            passed = upto > hot
            passed[0] &= before <= hot
            so_far = int(upto[-1])
            if passed.any():
                x = h[first[passed]]
                yield places(x, x, np.full(len(x), -1))
            last = h[-1]
            real = b.column("pos").to_numpy() != _COUNT
            if not real.any():
                continue
            h, ids, ts, pos = (b.column(f).to_numpy()[real] for f in _RUNG1[:4])
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            on = (pos < 0) | same
            on[:-1] |= same[1:]
            pos = np.where(pos < 0, -1 - pos, pos)
            if h[0] == place:
                on[0] = True
                if waiting is not None:
                    yield places(*waiting)
            yield places(ids[on], ts[on], pos[on])
            place, waiting = h[-1], None if on[-1] else (ids[-1:].copy(), ts[-1:].copy(), pos[-1:].copy())

    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k, t, text) -> (id, k, t, size, z): the text's UTF-8 as zstd, for the way."""
    for b in batches:
        z, size, held, done = [], [], 0, 0
        for i, x in enumerate(b.column(3)):
            raw = x.as_buffer() if x.is_valid else None
            size.append(raw.size if raw is not None else None)
            z.append(_ZSTD.compress(raw, asbytes=True) if raw is not None and raw.size else None)
            held += len(z[-1] or b"")
            if held > 8 << 20 or i == b.num_rows - 1:
                part = b.slice(done, i + 1 - done)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(size, pa.int64()), pa.array(z, pa.binary())], names=["id", "k", "t", "size", "z"])
                z, size, held, done = [], [], 0, i + 1


def _texts(size: pa.Array, z: pa.Array) -> pa.Array:
    raw = [None if n is None else _ZSTD.decompress(x.as_buffer(), n, asbytes=True) if n else b"" for n, x in zip(size.to_pylist(), z, strict=True)]
    return pa.array(raw, pa.large_binary()).cast(pa.large_string())


def _candidates(words: Words, length: int, sent: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and anchors of the windows whose anchors are among those sent to their texts (from the i-th on), and all hashes."""
    starts, anchor, h = _anchors(words, length)
    hot = np.zeros(len(words.hashes) + 1, bool)
    for t in range(len(words.first) - 1 if len(starts) else 0):
        p = np.asarray(sent[i + t].values)
        a, e = words.first[t], words.first[t + 1]
        hot[a + p[p < e - a]] = True
    on = hot[anchor]
    return starts[on], anchor[on], h


def _rung2(length: int, hot):
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, t, size, z, anchors) -> (key, id, t, start, mask, windows): the candidate windows of each repeated anchor.

        windows: (offset from start, name) of those that are first in the chunk; mask: those that another precedes there.
        """
        for b in batches:
            ids, ts, sent = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(4)
            for i, _, words in chunks(_texts(b.column(2), b.column(3)), SPACED):
                starts, anchor, h = _candidates(words, length, sent, i)
                if not len(starts):
                    continue
                name = np.frombuffer(b"".join(words.digests(starts, length)), "<u8").reshape(-1, 2)
                doc = np.searchsorted(words.first, starts, "right") - 1
                order = np.lexsort((starts - words.first[doc], ts[i + doc], ids[i + doc], name[:, 1], name[:, 0]))
                later = np.zeros(len(starts), bool)
                later[order[1:]] = (name[order[1:]] == name[order[:-1]]).all(1)
                _same_place(later, order, ids[i + doc], ts[i + doc], starts - words.first[doc], name)
                # a row for each run of windows of one anchor, and for each window of a hot one
                many = np.isin(h[anchor].view(np.int64), hot.value) if len(hot.value) else np.zeros(len(starts), bool)
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | many[1:]])
                stop = np.r_[new[1:], len(starts)]
                offset = (starts - np.repeat(starts[new], stop - new)).astype(np.int64)
                mask = np.bitwise_or.reduceat(np.where(later, np.int64(1) << offset, 0), new)
                open_ = ~later
                count = np.add.reduceat(open_.astype(np.int64), new)
                packed = np.empty(int(open_.sum()), _NAME)
                packed["o"], packed["h"], packed["g"] = offset[open_], name[open_, 0], name[open_, 1]
                ends = np.cumsum(count) * packed.dtype.itemsize
                windows = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
                d, s = doc[new], starts[new]
                # rows without open windows only pass through: any task will do
                own = mix(ids[i + d].view(np.uint64) + s.astype(np.uint64))
                key = np.where(count > 0, np.where(many[new], mix(name[new, 0]), h[anchor[new]]), own).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[i + d]), pa.array(ts[i + d]), pa.array((s - words.first[d]).astype(np.int32)), pa.array(mask), windows], names=["key", "id", "t", "start", "mask", "windows"])

    assert length - half < 63, "a mask has 63 bits"
    return run


def _named(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, t, size, z, anchors) -> (id, t, pos, name): the candidate windows by place, with a 128-bit name."""
        for b in batches:
            ids, ts, sent = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(4)
            for i, _, words in chunks(_texts(b.column(2), b.column(3)), SPACED):
                starts, _, _ = _candidates(words, length, sent, i)
                doc = np.searchsorted(words.first, starts, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + doc]), pa.array(ts[i + doc]), pa.array((starts - words.first[doc]).astype(np.int32)), pa.array(words.digests(starts, length), pa.binary())], names=["id", "t", "pos", "name"])

    return run


def _same_place(later: np.ndarray, order: np.ndarray, ids: np.ndarray, ts: np.ndarray, pos: np.ndarray, name: np.ndarray) -> None:
    """Rows that repeat a document whole are no earlier occurrences of each other."""
    a, b = order[:-1], order[1:]
    twin = (name[a] == name[b]).all(1) & (ids[a] == ids[b]) & (ts[a] == ts[b]) & (pos[a] == pos[b])
    for k in np.flatnonzero(twin):
        later[b[k]] = later[a[k]]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _rung2 sorted by (key, id, t, start) -> (id, t, start, mask): mask now has every window that starts earlier too.

    A key's rows may fill a few batches: what goes from one to the next is the first place of each name under the last key.
    """
    last, carry = None, None
    for b in batches:
        if not b.num_rows:
            continue
        key, ids, ts, start = (b.column(f).to_numpy() for f in ("key", "id", "t", "start"))
        w = b.column("windows")
        at = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + len(w) + 1] // _NAME.itemsize
        raw = np.frombuffer(w.buffers()[2], _NAME, count=at[-1])[at[0] :] if at[-1] else np.zeros(0, _NAME)
        row = np.repeat(np.arange(len(w)), np.diff(at))
        offset = raw["o"].astype(np.int64)
        names = np.empty(len(raw), [("key", "<i8"), ("h", "<u8"), ("g", "<u8"), ("id", "<i8"), ("t", "<i8"), ("pos", "<i8")])
        names["g"], names["key"], names["h"], names["id"], names["t"], names["pos"] = raw["g"], key[row], raw["h"], ids[row], ts[row], start[row] + offset
        old = carry if carry is not None and last == key[0] else names[:0]
        both = np.concatenate([old, names])
        order = np.lexsort((both["g"], both["h"]))  # stable: places of one name keep their order
        x = both[order]
        new = np.r_[True, (x["h"][1:] != x["h"][:-1]) | (x["g"][1:] != x["g"][:-1])] if len(x) else np.zeros(0, bool)
        f = x[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))] if len(x) else x
        later = np.zeros(len(both), bool)
        later[order] = (x["id"] != f["id"]) | (x["t"] != f["t"]) | (x["pos"] != f["pos"])
        later = later[len(old) :]
        last = key[-1]
        carry = x[new & (x["key"] == last)]
        mask = b.column("mask").to_numpy().copy()
        np.bitwise_or.at(mask, row[later], np.int64(1) << offset[later])
        keep = mask != 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ts[keep]), pa.array(start[keep]), pa.array(mask[keep])], names=["id", "t", "start", "mask"])


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, size, z, spans) -> the words without those that a repeated window covers."""
        for b in batches:
            texts = _texts(b.column(1), b.column(2))
            n, gone, text, digest, ranges = [], [], [], [], []
            held = 0
            done = 0
            for k in range(b.num_rows):
                words = SPACED.split(texts[k].as_py())
                spans, own = b.column(3)[k].values if b.column(3)[k].is_valid else None, []
                if spans is not None and len(spans):
                    start, mask = (np.asarray(spans.field(f)) for f in ("start", "mask"))
                    delta = np.zeros(len(words) + 1, np.int64)
                    for o in range(int(mask.max()).bit_length()):
                        p = start[(mask >> o) & 1 == 1] + o
                        p = p[p + length <= len(words)]
                        np.add.at(delta, p, 1)
                        np.add.at(delta, p + length, -1)
                    covered = np.cumsum(delta)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
                    own = [{"start": int(s), "stop": int(e)} for s, e in edge.reshape(-1, 2)]
                    kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                else:
                    kept = words
                data = b" ".join(kept)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                text.append(data)
                digest.append(hashlib.sha256(data).hexdigest())
                ranges.append(own)
                held += len(data)
                if held > 8 << 20 or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, k + 1 - done), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(digest, pa.string()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["id", "n_words", "n_removed", "kept_text", "kept_sha256", "removed"])
                    n, gone, text, digest, ranges, held, done = [], [], [], [], [], 0, k + 1

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k (the id, null last) and t (a hash of the text) tell documents apart."""
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return docs.select("id", F.coalesce("id", F.lit(2**63 - 1)).alias("k"), F.xxhash64("text").alias("t"), "text")


def _packed(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(tidy(_compress), "id bigint, k bigint, t bigint, size bigint, z binary")


def _sent(docs: DataFrame, length: int) -> tuple[DataFrame, np.ndarray]:
    """The places of each document's repeated anchors, and the hot anchors."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot = max(HOT_PLACES, total // (2 * HOT_ANCHORS))
    places = docs.select("k", "t", "text").mapInArrow(tidy(_rung1(length)), "h bigint, id bigint, t bigint, pos int, n bigint, more binary")
    again = places.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(_repeated(hot)), "id bigint, t bigint, pos int")
    found = stored(again.groupBy(F.col("id").alias("k"), "t").agg(F.sort_array(F.collect_set("pos")).alias("anchors")), "anchors")
    # at most total / 2 places, and each hot anchor has more than total / 2 / HOT_ANCHORS of them
    listed = found.where(F.col("anchors")[0] < 0).select("k").toArrow().column(0).to_numpy()
    real = found.select("k", "t", F.filter("anchors", lambda p: p >= 0).alias("anchors")).where(F.size("anchors") > 0)
    return real, np.sort(listed)


def ladder(df: DataFrame, length: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length: the windows that occur more than once, at each of the lengths length, 2 * length, 4 * length ...
    up to the last that has any. Nulls and repeated rows as in dedup(), but rows that repeat a document count as one."""
    docs = _keyed(df, id_col, text_col).dropDuplicates(["k", "t"])
    sent, _ = _sent(docs, length)
    candidates = _packed(docs).join(sent, ["k", "t"])
    names = stored(candidates.select("k", "t", "size", "z", "anchors").mapInArrow(tidy(_named(length)), "id bigint, t bigint, pos int, name binary"), "rung")
    rungs = []
    while True:
        often = names.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").drop("c")
        kept = stored(names.join(often, "name"), "rung", instead=names if not rungs else None)
        if kept.isEmpty() and rungs:
            break
        rungs.append(kept.select("id", F.col("pos").alias("start"), F.lit(length).alias("length")))
        if kept.isEmpty():
            break
        second = kept.select("id", "t", (F.col("pos") - length).alias("pos"), F.col("name").alias("second"))
        names = kept.join(second, ["id", "t", "pos"]).select("id", "t", "pos", F.substring(F.unhex(F.sha2(F.concat("name", "second"), 256)), 1, 16).alias("name"))
        length *= 2
    out = rungs[0]
    for x in rungs[1:]:
        out = out.unionByName(x)
    return out.select(F.when(F.col("id") != 2**63 - 1, F.col("id")).alias("id"), "start", "length")


def dedup(df: DataFrame, length: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_text, kept_sha256 (of its UTF-8), removed (array of word spans start, stop).

    Words (runs of anything but ASCII white space, unchanged) that lie in a window of `length` consecutive words which
    also starts earlier, in a smaller id or before it in the same text, are removed; windows are judged on the input,
    and equal if the digests of their bytes are. Null text: no words, empty kept text. Null ids come after all others.
    Rows with one id and different texts are two documents, ordered by a hash of their texts; rows that repeat id and
    text get equal results and aren't each other's earlier occurrence. Empty table: no rows. Other columns are left out.
    """
    docs = _keyed(df, id_col, text_col)
    sent, hot = _sent(docs, length)
    candidates = _packed(docs).join(sent, ["k", "t"]).select("k", "t", "size", "z", "anchors")
    windows = candidates.mapInArrow(tidy(_rung2(length, df.sparkSession.sparkContext.broadcast(hot))), "key bigint, id bigint, t bigint, start int, mask bigint, windows binary")
    found = windows.repartition("key").sortWithinPartitions("key", "id", "t", "start").mapInArrow(tidy(_decide), "id bigint, t bigint, start int, mask bigint")
    spans = stored(found.groupBy(F.col("id").alias("k"), "t").agg(F.collect_list(F.struct("start", "mask")).alias("spans")), "spans")
    schema = "id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string, removed array<struct<start:int,stop:int>>"
    return _packed(docs).join(spans, ["k", "t"], "left").select("id", "size", "z", "spans").mapInArrow(tidy(_apply(length)), schema)
