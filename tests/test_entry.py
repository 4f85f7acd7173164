"""The driver contract, and every query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vellum import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df):
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        row = []
        for v in r:
            if isinstance(v, float):
                v = None if v != v else round(v, 6)
            elif not isinstance(v, (list, dict)) and not hasattr(v, "tolist") and pd.isna(v):
                v = None
            row.append(str(v.tolist() if hasattr(v, "tolist") else v))
        rows.append(tuple(row))
    return sorted(rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 10


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
