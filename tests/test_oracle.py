"""Every screening query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

from guilloche.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "None"
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = duck.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in result.description]
    assert sorted(cols) == names
    order = [cols.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"n3_heavy_blur"}))
def test_query_without_oracle_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
