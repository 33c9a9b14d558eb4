"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(df[columns].astype(object).where(df[columns].notna(), None).values.tolist(), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    got = catalog.QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    if name in catalog.SQL:
        assert rows(got.toPandas()) == rows(duck.sql(catalog.SQL[name]).df())
    else:
        got.count()
