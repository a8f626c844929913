"""How a plan registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict[str, str], Callable]:
    """Queries, DuckDB statements, and a decorator that adds to both; doubles are rounded to 6 digits on both sides."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def add(f):
            def run(spark, sf_dir: str) -> DataFrame:
                df = f(spark, sf_dir)
                return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

            run.__doc__ = f.__doc__
            queries[name] = run
            if sql:
                oracles[name] = sql
            return f

        return add

    return queries, oracles, query
