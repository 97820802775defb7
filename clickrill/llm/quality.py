"""Quality by a linear-chain conditional random field over lines.

Each line is good or bad; its features are shares of character classes, lengths, repetition inside the document and
endings, its own and those of the lines before and after it. Training documents give their label to all their lines.
Forward-backward marginals of the lines, weighted by length, average to the document's score.

Only the fit is bounded: TRAIN_DOCS labelled documents, drawn by a hash of the id, and of each a run of TRAIN_LINES lines,
drawn by a hash of the text from all the runs that it consists of. Scoring reads every line of every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import quoted, tidy, unused
from .tokens import SPACED_LOWER, Words, raw_texts

TRAIN_DOCS = 4000
TRAIN_LINES = 60
#: Bytes of texts whose lines are scored together, and lines in one forward-backward pass.
CHUNK = 1 << 19
_LOCAL = 16
N_FEATURES = 3 * _LOCAL + 2


def _class_table() -> np.ndarray:
    """Byte classes: 0 other letters, 1 upper-case, 2 digit, 3 space, 4 sentence punctuation, 5 other punctuation, 6 control, 7 continuation byte."""
    t = np.zeros(256, np.uint8)
    for i in range(128):
        c = chr(i)
        t[i] = 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c in " \t" else 4 if c in ".,;:?'\"-()" else 5 if c.isprintable() else 6
    t[128:192] = 7
    return t


_CLASS = _class_table()


@dataclass
class Lines:
    """Lines of consecutive texts: features, lengths (characters and 1) and each text's first line."""

    features: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """data: UTF-8 of consecutive texts that begin at offsets. A newline ends a line; what follows the last one is a line
    if it isn't empty, and an empty text has one empty line."""
    newline = np.flatnonzero(data == 10)
    lo, hi = np.searchsorted(newline, offsets[:-1]), np.searchsorted(newline, offsets[1:])
    n = hi - lo
    # a last line without a newline of its own
    open_ = np.ones(len(n), bool)
    some = offsets[1:] > offsets[:-1]
    open_[some] = data[offsets[1:][some] - 1] != 10
    first = np.r_[0, np.cumsum(n + open_)]
    stop = np.empty(first[-1], np.int64)
    last = np.zeros(first[-1], bool)
    last[first[1:][open_] - 1] = True
    stop[last], stop[~last] = offsets[1:][open_], newline
    begin = np.empty_like(stop)
    begin[1:] = stop[:-1] + ~last[:-1]
    begin[first[:-1]] = offsets[:-1]
    return _featured(data, offsets, begin, stop, first)


def _featured(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, stop: np.ndarray, first: np.ndarray) -> Lines:
    m = len(begin)
    kind = _CLASS[data]
    counts = np.zeros((m, 8), np.float64)
    sums = np.zeros(len(data) + 1, np.int64)
    for c in range(8):
        np.cumsum(kind == c, out=sums[1:])
        counts[:, c] = sums[stop] - sums[begin]
    pipe = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == ord("|"), out=pipe[1:])
    bang = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == ord("!"), out=bang[1:])
    run = np.zeros(len(data) + 1, np.int64)
    run[2:] = np.cumsum((kind[1:] == 5) & (kind[:-1] == 5)) if len(data) > 1 else run[2:]
    size = (stop - begin).astype(np.float64)
    chars = np.maximum(1.0, size - counts[:, 7])
    words = counts[:, 3] + 1
    last = np.where(size > 0, kind[np.maximum(stop - 1, 0)] if len(data) else 0, 3)
    head = np.where(size > 0, kind[np.minimum(begin, max(0, len(data) - 1))] if len(data) else 0, 3)
    # lines that occur in their text before
    again = np.zeros(m)
    raw = data.tobytes()
    for a, e in zip(first[:-1], first[1:], strict=True):
        if e - a > 1:
            seen: set[bytes] = set()
            for k in range(a, e):
                x = raw[begin[k] : stop[k]]
                again[k] = x in seen
                seen.add(x)
    # words that are the same as the one before, or as the one two or three before
    found = Words(data, offsets, SPACED_LOWER)
    line = np.searchsorted(begin, found.starts, "right") - 1
    number = np.maximum(1, np.bincount(line, minlength=m)) if m else np.zeros(0)
    same = [np.bincount(line[d:][(found.hashes[d:] == found.hashes[:-d]) & (line[d:] == line[:-d])], minlength=m) / number for d in (1, 2, 3)]
    letters = np.maximum(1.0, counts[:, 0] + counts[:, 1])
    f = np.stack([counts[:, 1] / letters, counts[:, 2] / chars, counts[:, 4] / words, np.minimum(2.0, counts[:, 5] / words), (pipe[stop] - pipe[begin]) / words, np.minimum(2.0, (bang[stop] - bang[begin]) / words), np.minimum(3.0, np.where(stop > begin, run[stop] - run[np.minimum(begin + 1, stop)], 0) / words), np.minimum(3.0, chars / words / 5), np.log1p(chars) / 5, np.log1p(words) / 3, last == 4, head == 1, again, size == 0, same[0], np.maximum(same[1], same[2])], axis=1).astype(np.float64)
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first[:-1]] = 0
    ends = first[1:] - 1
    after[ends] = 0
    edge = np.zeros((m, 2))
    edge[first[:-1], 0] = 1
    edge[:, 1] = 1
    return Lines(np.concatenate([f, before, after, edge], axis=1), chars, first)


@dataclass
class Model:
    """weights: log-odds of good by feature; moves: 2 x 2 scores of (label, next label), 0 bad, 1 good; mean and scale of the features."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def odds(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale @ self.weights


def marginals(u: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each move, by forward-backward over all texts side by side."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    a0, n = first[:-1][order], n[order]
    m, longest = len(u), int(n.max(initial=0))
    s = np.zeros((m, 2))
    s[:, 1] = u
    fwd, bwd = np.zeros((m, 2)), np.zeros((m, 2))
    active = [int(np.searchsorted(-n, -p, "left")) for p in range(longest + 1)]  # texts with more than p lines
    fwd[a0[n > 0]] = s[a0[n > 0]]
    for p in range(1, longest):
        k = a0[: active[p]] + p
        fwd[k] = s[k] + np.logaddexp(fwd[k - 1, :1] + moves[0], fwd[k - 1, 1:] + moves[1])
        fwd[k] -= fwd[k].max(1, keepdims=True)
    for p in range(longest - 2, -1, -1):
        k = a0[: active[p + 1]] + p
        nxt = s[k + 1] + bwd[k + 1]
        bwd[k] = np.stack([np.logaddexp(moves[0, 0] + nxt[:, 0], moves[0, 1] + nxt[:, 1]), np.logaddexp(moves[1, 0] + nxt[:, 0], moves[1, 1] + nxt[:, 1])], axis=1)
        bwd[k] -= bwd[k].max(1, keepdims=True)
    both = fwd + bwd
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    inner = np.ones(m, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    k = np.flatnonzero(inner)
    pair = fwd[k - 1][:, :, None] + moves[None] + (s[k] + bwd[k])[:, None, :]
    pair = np.exp(pair - pair.max((1, 2), keepdims=True))
    return good, (pair / pair.sum((1, 2), keepdims=True)).sum(0)


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Adam on the regularized conditional likelihood; every line has its document's label. A document's gradient counts
    by 1 / lines, so long documents don't outweigh the rest."""
    mean, scale = features.mean(0), features.std(0) + 1e-3
    mean[-1], scale[-1] = 0.0, 1.0  # the constant
    x = (features - mean) / scale
    n = np.diff(first)
    y = np.repeat(labels, n).astype(float)
    per_doc = 1 / np.maximum(1, n)
    weight = np.repeat(per_doc, n) / max(1, len(labels))
    w, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    moved = np.zeros((2, 2))
    for c in (0, 1):
        moved[c, c] = (np.maximum(0, n - 1) * (labels == c)).sum()
    total = max(1.0, moved.sum())
    for step in range(1, steps + 1):
        good, expected = marginals(x @ w, first, moves)
        g = np.r_[x.T @ ((y - good) * weight) - ridge * w, ((moved - expected) / total - 0.1 * moves).ravel()]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        delta = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, moves = w + delta[:-4], moves + delta[-4:].reshape(2, 2)
    return Model(w, moves, mean, scale)


def _chunked(texts: pa.Array) -> Iterator[tuple[int, int, Lines]]:
    n = len(texts)
    if not n:
        return
    data, offsets = raw_texts(texts)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, j, lines_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (label, features of one run of TRAIN_LINES lines: any of the text's, the last may be shorter)."""
    for b in batches:
        out = []
        for i, _, x in _chunked(b.column(1)):
            for t, (a, e) in enumerate(zip(x.first[:-1], x.first[1:], strict=True)):
                runs = -(-int(e - a) // TRAIN_LINES)
                at = a + TRAIN_LINES * (zlib.crc32((b.column(1)[i + t].as_py() or "").encode()) % runs if runs > 1 else 0)
                out.append(x.features[at : min(e, at + TRAIN_LINES)].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["label", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = TRAIN_DOCS) -> Model:
    """A model of max_docs labelled documents at most, chosen by a hash of the id; other labels than 0 and 1 are left out.
    Without usable rows: a model that scores every text 0.5."""
    usable = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(["_id"])
    chosen = usable.join(docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct(), "_id").orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("label", "text").mapInArrow(tidy(_features), "label int, features binary").collect()  # max_docs rows of up to TRAIN_LINES lines
    rows.sort(key=lambda r: (r["label"], bytes(r["features"])))
    if not rows:
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(N_FEATURES), np.ones(N_FEATURES))
    parts = [np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return fit(np.concatenate(parts).astype(np.float64), np.r_[0, np.cumsum([len(p) for p in parts])], np.array([r["label"] for r in rows]))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for _, _, x in _chunked(b.column(b.num_columns - 1)):
                good, _ = marginals(model.odds(x.features), x.first, model.moves)
                top, low = np.add.reduceat(good * x.weight, x.first[:-1]), np.add.reduceat(x.weight, x.first[:-1])
                scores += np.clip(top / low, 0.0, 1.0).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs, and score: 0 to 1, higher is likelier good. A null text counts as empty, which is one
    empty line. Repeated rows get equal scores. Empty table: no rows. A column of docs named score isn't kept."""
    keep = [c for c in keep if c.lower() != "score"]
    (text,) = unused(docs, "_scored")
    rows = docs.select(*quoted([c for c in keep if c != text_col]), F.col(text_col).alias(text))
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.mapInArrow(tidy(_scorer(model)), schema).select(*[F.col(text).alias(c) if c == text_col else quoted([c])[0] for c in keep], "score")
