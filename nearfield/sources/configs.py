"""Configuration files as a table: one row for each leaf of each YAML file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _leaves(node, at: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _leaves(v, f"{at}.{k}" if at else str(k))
    elif isinstance(node, list):
        for k, v in enumerate(node):
            yield from _leaves(v, f"{at}[{k}]")
    else:
        yield at, "" if node is None else str(node)


def scan(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, key, value) of all leaves of the files that a pattern names; a file that is no YAML is an error."""
    texts = spark.read.text(pattern, wholetext=True).selectExpr("_metadata.file_path as path", "value as text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            rows = [(p, k, v) for p, t in zip(b["path"], b["text"]) for k, v in _leaves(yaml.safe_load(t) or {})]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return texts.mapInPandas(run, "path string, key string, value string")
