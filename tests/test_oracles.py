"""Every query with a SQL twin, against DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest

from tessella.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted(map(repr, values))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, db, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(db.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
