"""Mixing sources to target weights with soft domain membership, in built-in functions only.

1. A softmax classifier over the labelled table: hashed words and a few shape marks of a text give the posterior of each
   domain. Every word counts; features are scaled by the log ratio of their shares inside and outside a domain. Only
   the fit is bounded, to TRAIN_DOCS labelled documents drawn by a hash of the id, and the model to BUCKETS of words.
2. Projected-gradient least squares: rates r >= floor of the documents, starting at 1, such that each domain's expected
   tokens, sum of r * tokens * posterior, meet their targets. A step is r = max(floor, r - posterior . g), with tokens as the
   metric of the rates. First g is the residual preconditioned by the D x D moment matrix of the documents that are not at the
   floor, which meets targets that can be met in a few steps. Where they can't, accelerated steps along the plain residual
   follow, down to the least-squares point. A rate so follows from a document's posterior and the D numbers of each step,
   and a step is one distributed sum of D * (D + 3) / 2 numbers.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored, unused

TRAIN_DOCS = 4000
#: Buckets of the hashed words, and marks of a text's shape with three levels each.
BUCKETS, MARKS = 1 << 16, 4
FEATURES = BUCKETS + 3 * MARKS
#: Weights are whole numbers of these, so that two sums of them fit into one number of 64 bits.
UNIT = 1e-3
#: Preconditioned steps, and accelerated ones after them where targets can't be met, at most.
STEPS, MORE_STEPS = 60, 200
TOLERANCE = 1e-6
#: Steps in one plain expression; with more, a fold over an array of steps. Rates are written out after so many.
UNROLLED, FOLDED = 12, 20


def _words(text: Column) -> Column:
    """The lower-case words (0-9, a-z and characters beyond ASCII) of a text; its ends may give empty ones. Null: none."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _marks(text: Column) -> Column:
    """The features that mark a text's shape: levels of the shares of capitals, of symbols and of digits, and of shortness."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    level = lambda x, low, high: (x >= low).cast("int") + (x >= high).cast("int")
    levels = [level(share(r"[A-ZÀ-Þ]"), 0.1, 0.4), level(share(r"[#$%&*|!]"), 0.02, 0.1), level(share("[0-9]"), 0.1, 0.4), level(-n, -40, -10)]
    return F.array(*[x + F.lit(BUCKETS + 3 * i) for i, x in enumerate(levels)])


def n_words(words: Column) -> Column:
    return (F.size(words) - (F.get(words, F.lit(0)) == "").cast("int") - F.when(F.size(words) > 1, (F.element_at(words, -1) == "").cast("int")).otherwise(0)).cast("bigint")


def _features(words: Column, marks: Column) -> Column:
    """The distinct buckets of a text's words, and its marks."""
    return F.concat(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))), marks)


class Classifier:
    """weights: the scores that a feature adds to each domain (FEATURES x domains); prior: those of a text without any."""

    def __init__(self, domains: list[str], prior: list[float], weights: np.ndarray | None = None):
        self.domains, self.prior, self.weights = domains, prior, weights

    def scores(self, features: Column) -> list[Column]:
        """The score of each domain, less that of the first. Two domains share a sum: one in its upper, one in its lower half."""
        out, rest = [F.lit(0.0)], [self.prior[d] - self.prior[0] for d in range(1, len(self.domains))]
        if self.weights is None:
            return out + [F.lit(float(x)) for x in rest]
        whole = np.clip(np.rint((self.weights[:, 1:] - self.weights[:, :1]) / UNIT), -30_000, 30_000).astype(np.int64)
        for d in range(0, whole.shape[1], 2):
            pair = whole[:, d : d + 2]
            packed = (pair[:, 1] << 32) + pair[:, 0] if pair.shape[1] == 2 else pair[:, 0]
            table = F.from_json(F.lit(json.dumps(packed.tolist())), "array<bigint>")
            total = F.aggregate(features, F.lit(0).cast("bigint"), lambda acc, i: acc + F.get(table, i))
            low = F.shiftright(F.shiftleft(total, 32), 32)
            out += [x * UNIT + float(p) for x, p in zip((low, F.shiftright(total - low, 32)), rest[d : d + 2], strict=False)]
        return out


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS) -> Classifier:
    """labelled: id, domain. Rows with another domain or without a document are left out; an id counts once. Without any
    usable row every posterior is the uniform one."""
    usable = labelled.where(F.col("domain").isin(domains)).select(F.col(id_col).alias("_id"), "domain").dropDuplicates(["_id"])
    chosen = usable.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id").orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    rows = texts.select("domain", F.array_sort(_features(_words(F.col("text")), _marks(F.col("text")))).alias("x")).collect()  # max_docs rows of FEATURES numbers at most
    sample = sorted((domains.index(r["domain"]), r["x"]) for r in rows)
    if not sample:
        return Classifier(domains, [0.0] * len(domains))
    prior, weights = _softmax_fit([np.array(x, np.int64) for _, x in sample], np.array([d for d, _ in sample]), len(domains))
    return Classifier(domains, prior.tolist(), weights)


def _softmax_fit(x: list[np.ndarray], y: np.ndarray, n_domains: int, steps: int = 100, rate: float = 0.05, ridge: float = 3e-3) -> tuple[np.ndarray, np.ndarray]:
    """(prior, weights) of a regularized softmax regression over binary features scaled by their log ratios, by Adam on the
    whole sample. x: the features of each document; only those that occur have weights."""
    size = np.array([len(r) for r in x])
    row = np.repeat(np.arange(len(x)), size)
    seen, flat = np.unique(np.concatenate(x), return_inverse=True)
    flat, row = np.r_[flat, np.full(len(x), len(seen))], np.r_[row, np.arange(len(x))]  # the constant
    by_row, by_feature = np.argsort(row, kind="stable"), np.argsort(flat, kind="stable")
    row_cuts, feature_cuts = np.r_[0, np.cumsum(size + 1)[:-1]], np.searchsorted(flat[by_feature], np.arange(len(seen) + 1))
    wanted = np.eye(n_domains, dtype=np.float32)[y]
    docs = wanted.sum(0)
    inside = np.add.reduceat(wanted[row[by_feature]], feature_cuts)
    outside = inside.sum(1, keepdims=True) - inside
    scale = np.log((inside + 1) / (docs + 2)) - np.log((outside + 1) / (docs.sum() - docs + 2))
    scale[-1] = 1.0
    scale = scale.astype(np.float32)
    w, m1, m2 = (np.zeros(scale.shape, np.float32) for _ in range(3))
    for step in range(1, steps + 1):
        z = np.add.reduceat((w * scale)[flat[by_row]], row_cuts)
        p = np.exp(z - z.max(1, keepdims=True))
        miss = wanted - p / p.sum(1, keepdims=True)
        g = np.add.reduceat(miss[row[by_feature]], feature_cuts) / len(x) * scale - ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w = w + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros((FEATURES, n_domains))
    weights[seen] = (w * scale)[:-1]
    return (w * scale)[-1], weights


def memberships(df: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """df with n_tokens and p_<domain>: the posteriors, adding up to 1. Tokens are runs of 0-9, a-z, A-Z and characters
    beyond ASCII, so a text of symbols alone has none. Columns of df named like a result are replaced."""
    df = df.drop("n_tokens", *[f"p_{d}" for d in model.domains])
    words, x, scores = unused(df, "_words", "_features", "_scores")
    own = quoted(df.columns)
    out = df.select(*own, _words(F.col(text_col)).alias(words))
    out = out.select(*own, n_words(F.col(words)).alias("n_tokens"), _features(F.col(words), _marks(F.col(text_col))).alias(x))
    out = out.select(*own, "n_tokens", F.array(*model.scores(F.col(x))).alias(scores))
    # through a generator: each score is computed once
    out = out.select(*own, "n_tokens", F.explode(F.array(F.col(scores))).alias(scores))
    each = [F.exp(F.get(scores, F.lit(i)) - F.array_max(scores)) for i in range(len(model.domains))]
    whole = sum(each[1:], each[0])
    return out.select(*own, "n_tokens", *[(e / whole).alias(f"p_{d}") for e, d in zip(each, model.domains, strict=True)])


class _Steps:
    """The steps taken so far, each D numbers g and a momentum b: (r, q) -> (max(floor, y - p . g), r), y = r + b * (r - q).
    Those of before the last table that was written are in its columns r and q."""

    def __init__(self, p: list[Column], floor: float):
        self.p, self.floor, self.all, self.since = p, float(floor), [], 0

    def _fold(self, steps: list[list[float]], r: Column, q: Column) -> tuple[Column, Column]:
        def moved(y: Column, g) -> Column:
            return F.greatest(F.lit(self.floor), y - sum((x * g(i) for i, x in enumerate(self.p)), F.lit(0.0)))

        if len(steps) <= UNROLLED and not any(s[-1] for s in steps):
            for s in steps:
                r, q = moved(r, lambda i, s=s: F.lit(float(s[i]))), r
            return r, q
        listed, last = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>"), len(self.p)
        both = F.aggregate(listed, F.struct(r.alias("r"), q.alias("q")), lambda a, s: F.struct(moved(a["r"] + F.get(s, F.lit(last)) * (a["r"] - a["q"]), lambda i: F.get(s, F.lit(i))).alias("r"), a["r"].alias("q")))
        return both["r"], both["q"]

    def rate(self) -> Column:
        return self._fold(self.all, F.lit(1.0), F.lit(1.0))[0]

    def point(self, written: bool) -> tuple[Column, Column]:
        """(r, q) over the table as it is."""
        return self._fold(self.all[self.since :], *((F.col("r"), F.col("q")) if written else (F.lit(1.0), F.lit(1.0))))


def fit_rates(members: DataFrame, targets: dict[str, float], floor: float = 0.0, max_steps: int = STEPS, more_steps: int = MORE_STEPS) -> tuple[Column, dict]:
    """The rate as an expression over p_<domain> of members, and a report of targets and what is reached.

    targets: expected tokens wanted of each domain. Where no rates >= floor meet them (a domain without documents, say),
    the rates are those of the least squared differences, and the report shows what is left of them.
    """
    domains = sorted(targets)
    want, n = np.array([float(targets[d]) for d in domains]), len(domains)
    p, t = [F.col(f"p_{d}") for d in domains], F.col("n_tokens")
    table, written, steps = members.select("n_tokens", *p), False, _Steps(p, floor)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))

    def measure() -> tuple[np.ndarray, np.ndarray]:
        r = steps.point(written)[0].alias("y")
        y = table.select("n_tokens", *p, F.explode(F.array(r)).alias("y"))
        free = F.when(F.col("y") > floor, t).otherwise(0)
        row = y.agg(*[total(F.col("y") * t * p[i]).alias(f"g{i}") for i in range(n)], *[total(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i + 1)]).first()
        return np.array([float(row[f"g{i}"]) for i in range(n)]), np.array([[row[f"m{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)], float)

    def left(reached: np.ndarray) -> float:
        return float(((reached - want) ** 2).sum())

    reached, moments = measure()
    met = (TOLERANCE * max(1.0, want.sum())) ** 2
    lipschitz, size = float(np.linalg.eigvalsh(moments).max(initial=0)), 1.0
    for _ in range(max_steps):
        if left(reached) <= met:
            break
        steps.all.append([*(size * np.linalg.pinv(moments, rcond=1e-9) @ (reached - want)).tolist(), 0.0])
        new, new_moments = measure()
        if left(new) < left(reached) * (1 - 1e-4 * size):
            reached, moments, size = new, new_moments, min(1.0, 2 * size)
        else:
            steps.all.pop()
            size /= 4
            if size < 1e-3:
                break
    if left(reached) > met and lipschitz > 0:
        k, flat, before, last = 0, 0, left(reached), reached
        for _ in range(more_steps):
            momentum = k / (k + 3)
            if len(steps.all) - steps.since >= FOLDED:
                r, q = steps.point(written)
                table = stored(table.select("n_tokens", *p, r.alias("r"), q.alias("q")), "rates", instead=table if written else None)
                steps.since, written = len(steps.all), True
            y = reached + momentum * (reached - last)  # what is reached is linear in the rates
            steps.all.append([*((y - want) / lipschitz).tolist(), momentum])
            last, (reached, _) = reached, measure()
            k = k + 1 if left(reached) <= before else 0  # momentum starts anew where it leads up
            flat = flat + 1 if abs(before - left(reached)) <= 1e-6 * before else 0
            before = left(reached)
            if before <= met or flat >= 5:
                break
    return steps.rate(), {d: {"target": float(w), "reached": float(x)} for d, w, x in zip(domains, want, reached, strict=True)}


def mix(members: DataFrame, weights: dict[str, float], floor: float = 0.0, total: float | None = None) -> DataFrame:
    """members with `rate`: expected copies of each document such that domains have the shares `weights` of `total` tokens
    (as many as there are now, if not given). Empty members: no rows. n_tokens 0: the rate counts nothing and is kept."""
    table = stored(members, "members")
    whole = total if total is not None else float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    scale = sum(weights.values())
    rate, _ = fit_rates(table, {d: whole * w / scale for d, w in weights.items()}, floor)
    return table.withColumn("rate", rate)


def copies(rate: Column, *row: Column, snap: float = 0.1) -> Column:
    """Whole copies of a row: the nearest integer to rates within `snap` of one, else the rate rounded up or down by a
    hash of the row, with the rate as its expectation."""
    u = (F.pmod(F.xxhash64(*row, F.lit("copies")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.when(F.abs(rate - F.round(rate)) <= snap, F.round(rate)).otherwise(F.floor(rate + u)).cast("int")
