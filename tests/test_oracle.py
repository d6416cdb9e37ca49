"""Every core query with an SQL twin gives the same rows as DuckDB on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from pagewright.plans import registry

Q, SQL = registry.queries(), registry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    df = Q[name](spark, data)
    got = sorted(repr(tuple(map(norm, r))) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rel.fetchall())
    assert got == want


def test_queries_without_sql_have_tests_of_their_own():
    assert set(Q) - set(SQL) == {"structural_sections_parsed", "crawl_bfs", "tfidf_train_predict", "quality_sample50"}  # see test_pipelines.py


def test_flagship(spark, data):
    assert registry.flagship(spark, data).count() > 0
