"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from shorewise.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(got, want):
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = [df[names].astype(str).sort_values(names).reset_index(drop=True) for df in (got, want)]
    assert rows[0].equals(rows[1])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir).toPandas(), con.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_crs_returns(spark, sf_dir):
    assert catalog.QUERIES["crs_round_trip"](spark, sf_dir).where("NOT returns").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["location_id", "ahn_version", "distance_to_erosion", "timestamp"]
    assert set(e.oracle_sql()) <= set(e.queries())
