"""Every registered query with DuckDB SQL gives the same columns and rows as that SQL."""

import os

import duckdb
import pytest

from nearfield import catalog


def _norm(rows):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_duckdb(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    expected = duck.sql(catalog.ORACLES[name])
    assert sorted(expected.columns) == cols
    got = _norm(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = _norm(duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({catalog.ORACLES[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
