"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from factgraph import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(df: pd.DataFrame) -> list[tuple]:
    value = lambda v: "NULL" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(value, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_as_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want) and len(got)


def test_entry(spark):
    assert [r.step for r in registry.entry(spark, DATA).orderBy("step").collect()] == [1, 2, 3]
