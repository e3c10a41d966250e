"""Every query with SQL gives what DuckDB gives, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entries

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in entries.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return c


def plain(df):
    one = lambda v: "NULL" if v is None or v is pd.NaT or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    df = df[sorted(df.columns)].map(one)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entries.queries()[name](spark, FOLDER).toPandas()
    sql = entries.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(want.columns) == sorted(got.columns)
    pd.testing.assert_frame_equal(plain(want), plain(got))
