"""Every query against its SQL in another engine, on small data."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CATALOG = __import__("tidepanel.plans.catalog", fromlist=["catalog"])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r)), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(CATALOG.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = CATALOG.queries()[name](spark, DIR)
    got, names = rows(df.columns, df.collect())
    result = duck.execute(CATALOG.oracle_sql()[name])
    want, want_names = rows([c[0] for c in result.description], result.fetchall())
    assert names == want_names
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w


@pytest.mark.parametrize("name", sorted(set(CATALOG.queries()) - set(CATALOG.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    df = CATALOG.queries()[name](spark, DIR)
    assert df.columns and df.count() > 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
