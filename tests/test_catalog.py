"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from keystrata import catalog, registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables aren't here")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def shown(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(shown(r[c]) for c in names) for r in df.collect()), key=repr)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert got == sorted((tuple(shown(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_queries_without_sql(spark, con):
    for name in catalog.queries().keys() - catalog.oracle_sql().keys():
        assert catalog.queries()[name](spark, DATA).count() > 0


def test_registry_names_only_what_is_there():
    rows = registry.rows()
    assert len(rows) == len({c for c, _, _ in rows}) == 191
    assert {q for _, s, by in rows if s == "query" for q in by.split()} <= catalog.queries().keys()
