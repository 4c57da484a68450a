"""Every registered query against DuckDB on the smallest tables; without SQL only that it runs."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from codeloom.plans import catalogue


#: Queries that find nothing in the smallest tables: they run on the next larger ones.
SPARSE = {"contract_links", "cypher_inline_map", "cypher_with", "cypher_parameter", "symbol_candidates", "symbol_candidates_of_kind", "contract_exact", "contract_unique_suffix", "contract_wildcard"}


def connection(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.fixture(scope="module")
def larger(sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    return folder, connection(folder)


def normal(df):
    columns = sorted(df.columns)
    text = df[columns].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else f"{v:.6f}" if isinstance(v, float) else str(v))
    return text.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, larger, name):
    if name in SPARSE:
        sf_dir, con = larger
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalogue.ORACLE:
        want = con.execute(catalogue.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and len(want)
        pd.testing.assert_frame_equal(normal(got), normal(want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
