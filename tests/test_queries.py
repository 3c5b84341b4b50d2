"""Every query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from marlstone.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.sql(registry.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in cols]
    assert sorted(found.columns) == cols
    assert rows == sorted((tuple(plain(x[i]) for i in at) for x in found.fetchall()), key=repr)
