"""The registered queries: against their SQL, or, where SQL can't express them, against plain versions over whole tables."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_records import brute_quality, least_squares  # noqa: F401
from test_words import plain_detections

import corpus_pipeline
from clickrill.llm import licenses, mixing, quality, registry
from clickrill.llm.oracle import ORACLES

SF = "/root/testdata/sf0.001"


def tables(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    plain = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, (float, np.floating)) and v == int(v) else v.item() if isinstance(v, np.generic) else v
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got, expected = rows(registry.QUERIES[name](spark, SF).toPandas()), rows(tables(SF).sql(ORACLES[name]).df())
    assert got == expected and got[1]


def test_op5_equals_plain_rules(spark):
    """All columns, by Python's re over every document."""
    texts = dict(tables(SF).sql("SELECT doc_id, text FROM documents").fetchall())
    got = {r["doc_id"]: r for r in registry.op5_licenses(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        n, places, first, last, base = brute.licenses(text)
        found = plain_detections(text)
        labels = ",".join(sorted({x[3] for x in found} | set(filter(None, base.split(",")))))
        score = licenses.CONFIDENCE[max((x[2] for x in found), default=0)]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (n, places, first, last, base, labels, score)


def plain_rates(p, t, want, steps=500):
    """Projected Newton steps over a matrix of posteriors, until the targets are met."""
    r = np.ones(len(t))
    for _ in range(steps):
        left = (r * t) @ p - want
        if np.abs(left).max() < 1e-9 * want.sum():
            break
        free = t * (r > 0)
        r = np.maximum(0, r - p @ np.linalg.pinv((p * free[:, None]).T @ p, rcond=1e-9) @ left)
    return r


def test_op2_equals_plain_arithmetic(spark):
    """Tokens, posteriors and rates of every document by NumPy, from the fitted weights."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = mixing.train(docs, registry.domain_labels(spark.read.parquet(f"{SF}/labels.parquet")), sorted(registry.WEIGHTS))
    from pyspark.sql import functions as F

    features = {r["doc_id"]: r["x"] for r in docs.select("doc_id", mixing._features(mixing._words(F.col("text")), mixing._marks(F.col("text"))).alias("x")).collect()}
    texts = dict(tables(SF).sql("SELECT doc_id, text FROM documents").fetchall())
    got = registry.op2_mixing(spark, SF).toPandas().set_index("doc_id")
    domains = sorted(registry.WEIGHTS)
    assert set(got.index) == set(texts)
    for i, text in texts.items():
        assert got.n_tokens[i] == len(brute.ALNUM.findall((text or "").lower()))
        z = np.array(model.prior) + model.weights[features[i]].sum(0)
        e = np.exp(z - z.max())
        assert np.allclose([got[f"p_{d}"][i] for d in domains], e / e.sum(), atol=0.02)
    p, t = got[[f"p_{d}" for d in domains]].to_numpy(), got.n_tokens.to_numpy().astype(float)
    want = t.sum() * np.array([registry.WEIGHTS[d] for d in domains]) / sum(registry.WEIGHTS.values())
    assert np.allclose((got.rate.to_numpy() * t) @ p, want, rtol=1e-4) and np.allclose(got.rate, plain_rates(p, t, want), atol=1e-3)


def test_pipeline_equals_plain_stages(spark):
    """Each stage's kept documents on its own input by brute force; of the mixture, what stays for certain."""
    con = tables(SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    for name, stage in corpus_pipeline.STAGES:
        had = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, SF).persist()
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "quality":
            model = quality.train(docs, labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 != 1"))
            for i, text in had.items():
                if (text or "").count("\n") < 9:
                    assert (i in kept) == (brute_quality(model, text) >= 0.5)
        elif name == "near_duplicates":
            assert kept == {i for i, (_, c) in brute.near(sorted(had.items()), 5, 80).items() if c == i}
        elif name == "decontamination":
            assert kept == {i for i, n, hit, _ in brute.contamination(had.items(), items) if not (hit and 20 * hit >= n)}
        elif name == "mixing":
            clean = {i for (i,) in con.sql("SELECT doc_id FROM labels WHERE toxic = 0").fetchall()} & set(had)
            assert kept <= set(had) and len(clean & kept) >= 0.9 * len(clean)
        else:
            got = out.collect()
            share = sum(r["size"] for r in got) / corpus_pipeline.SHARDS
            largest = max(r["size"] for r in got)
            assert kept == set(had) and all(abs(sum(r["size"] for r in got if r["shard"] == s) - share) <= largest + 1 for s in range(corpus_pipeline.SHARDS))
        docs = spark.createDataFrame(out.select(*docs.columns).collect(), docs.schema) if name != "sharding" else out
        assert kept
