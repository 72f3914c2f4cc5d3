"""Every registered query runs; those of the core agree with their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import convert_queries, corpus_queries, problems, text_queries

FOLDER = "/root/testdata/sf0.001"
CORE = {n: (f, m.ORACLES.get(n)) for m in (problems, text_queries, corpus_queries, convert_queries) for n, f in m.QUERIES.items()}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return "~" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(CORE))
def test_core_query(spark, duck, name):
    f, sql = CORE[name]
    df = f(spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    if sql:
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(tuple(norm(r[k]) for k in at) for r in rel.fetchall())
