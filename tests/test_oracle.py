"""Every signal query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from cadenza import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    plain = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(map(repr, plain.values.tolist()))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
    else:
        assert rows(got) == rows(duck.sql(sql).df())
