"""Every query with SQL gives the same rows in Spark and in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from spanloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents embeddings pages labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def key(row):
    return tuple((v is None, str(type(v)), v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    if name not in registry.oracle_sql():
        assert rows is not None
        return
    found = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)
