"""Every registered query against its DuckDB twin on the smallest shared tables."""

import os

import duckdb
import pytest

from snapweave.queries import QUERIES
from snapweave.twins import oracle_sql

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(res.fetchall(), ocols)
