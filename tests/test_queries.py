"""Every registered engine query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def names():
    from rowloom import file_queries, queries

    return list(file_queries and queries.QUERIES)


def cells(pdf):
    import pandas as pd

    def cell(x):
        if not isinstance(x, (list, dict)) and pd.isna(x):
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(cell, r)) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from rowloom import queries

    got = queries.QUERIES[name](spark, DIR).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
