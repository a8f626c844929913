"""The operators with DuckDB SQL give the rows of that SQL, on the tables and on odd rows."""

import duckdb
import pytest

from nearfield.llm import registry

TABLES = ("documents", "benchmark", "labels")


def _rows(columns, rows):
    """Rows as text that sorts, with losses to nine places."""
    return sorted(tuple(f"{v:.9f}".replace("-0.000000000", "0.000000000") if isinstance(v, float) else str(v) for _, v in sorted(zip(columns, r))) for r in rows)


def _check(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        found = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{found}{'/*.parquet' if 'odd' in found else ''}')")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, sf_dir, name):
    _check(spark, sf_dir, name)


@pytest.fixture(scope="module", params=["full", "no benchmark, no target", "no documents"])
def odd(request, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, f"Say {item.upper()}, {item} and the rest"), (5, "short item here, Short-Item"), (5, "short item here, Short-Item"), (5, "other words"), (None, item), (6, "word " * 30_000), (7, "Éa ÉA éa one two")]
    items = [(10, item), (9, item), (11, "short item"), (12, "word"), (13, ""), (14, None), (15, "éa one")]
    marks = [(4, 1), (4, 1), (4, 0), (5, 1), (7, 0), (None, 1)]
    if request.param == "no benchmark, no target":
        items, marks = [], marks[-1:]
    if request.param == "no documents":
        docs = []
    for t, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string"), ("labels", marks, "doc_id long, quality int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb_on_odd_rows(spark, odd, name):
    _check(spark, odd, name)
