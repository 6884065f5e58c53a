"""Every registered query against the SQL that says the same, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandlake.plans import store_queries, table_queries

QUERIES = table_queries.QUERIES | store_queries.QUERIES
ORACLES = table_queries.ORACLES | store_queries.ORACLES
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, list | tuple | np.ndarray):
        return tuple(plain(x) for x in value)
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float | np.floating) and value != value):
        return None
    if isinstance(value, bool | np.bool_):
        return bool(value)
    if isinstance(value, int | np.integer | float | np.floating):
        return round(float(value), 9)
    return value


def rows(frame):
    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_all_have_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert rows(got) == rows(want)
