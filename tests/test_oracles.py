"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

from lodestrata import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield c
    c.close()


def plain(v):
    if isinstance(v, float):
        return round(v, 8) if abs(v) < 1e6 else round(v, 2)
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def rows_of(rows, cols):
    return sorted(repr(tuple(plain(r[c]) for c in cols)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = con.sql(sql)
    cols = sorted(df.columns)
    assert sorted(got.columns) == cols
    own = [dict(zip(got.columns, r, strict=True)) for r in got.fetchall()]
    assert rows_of(rows, cols) == rows_of(own, cols)


def test_oracles_belong_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
