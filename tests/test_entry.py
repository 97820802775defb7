"""The driver contract, and each query against its SQL at the smallest scale."""

import ast
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from clickrill.plans.oracle import ORACLES
from clickrill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float | np.floating):
        return int(v) if v == int(v) else round(float(v), 9)
    if isinstance(v, np.integer):
        return int(v)
    return str(v)[:10] if hasattr(v, "year") else v


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, expected = rows(QUERIES[name](spark, SF).toPandas()), rows(con.sql(ORACLES[name]).df())
    assert got == expected and got[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_knows_the_optional_parts():
    root = Path(entry.__file__).parent
    for f in root.rglob("*.py"):
        rel = f.relative_to(root).as_posix()
        if rel in ("__spark_entry__.py", "corpus_pipeline.py") or rel.startswith(("clickrill/llm/", "tests/llm/")):
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), rel
