"""Queries whose accessions have five digits of a key give what their SQL gives where keys have six."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entries
from test_queries import plain


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Parts 10010 and 100100 to 100109 are all P10010, of even and odd size."""
    path, c = tmp_path_factory.mktemp("keys"), duckdb.connect()
    keys = "SELECT unnest([7, 10010, 10011] || range(100100, 100110)) AS k"
    c.execute(f"COPY (SELECT k AS p_partkey, 'hot bolt ' || k % 4 AS p_name, 'Brand#' || k % 3 AS p_brand, 'SMALL' AS p_type, CAST(k % 7 AS INTEGER) AS p_size FROM ({keys})) TO '{path}/part.parquet'")
    c.execute(f"COPY (SELECT i AS s_suppkey, 'Supplier#' || i AS s_name FROM range(9) r(i)) TO '{path}/supplier.parquet'")
    c.execute(f"COPY (SELECT i AS item_id, 'text ' || i AS text FROM range(9) r(i)) TO '{path}/benchmark.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["id_mapping", "fasta_headers", "mixed_source"])
def test_keys_of_six_digits(spark, folder, name):
    c = duckdb.connect()
    for table in ("part", "supplier", "benchmark"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = entries.queries()[name](spark, folder).toPandas(), c.execute(entries.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(plain(want), plain(got))
