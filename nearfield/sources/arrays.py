"""Array files as tables: ``spark.read.format("nearfield_npz")`` and ``"nearfield_npy"``; NumPy parses each file.

An ``.npz`` has the array X (n x d) and may have y (n labels, else zeros); an ``.npy`` is a matrix alone. Rows are read
in ranges, one input partition each; objects are refused. Rows: row_id, features, label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "row_id long, features array<double>, label long"


class RowRange(InputPartition):
    """Rows from start up to end."""

    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


def _load(path: str, kind: str):
    if kind == "npy":
        return np.load(path, mmap_mode="r", allow_pickle=False), None
    held = np.load(path, allow_pickle=False)
    if "X" not in held:
        raise KeyError(f"no array X in {path}; it has {sorted(held.files)}")
    return held["X"], held["y"] if "y" in held else None


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, rows: int):
        self.path, self.kind, self.rows = path, kind, rows

    def partitions(self):
        n = len(_load(self.path, self.kind)[0])
        return [RowRange(k, min(n, k + self.rows)) for k in range(0, max(n, 1), self.rows)]

    def read(self, partition):
        x, y = _load(self.path, self.kind)
        if x.ndim != 2:
            raise ValueError(f"X must have two dimensions, not {x.ndim}")
        if y is not None and len(y) != len(x):
            raise ValueError(f"{len(y)} labels for {len(x)} rows")
        for k in range(partition.start, partition.end):
            yield k, x[k].astype(float).tolist(), int(y[k]) if y is not None else 0


class NpzSource(DataSource):
    """The source of .npz files; options path and rows (of a partition, 10,000 by default)."""

    KIND = "npz"

    @classmethod
    def name(cls):
        return f"nearfield_{cls.KIND}"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.KIND, int(self.options.get("rows", 10_000)))


class NpySource(NpzSource):
    """The source of .npy files."""

    KIND = "npy"


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(NpySource)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table of points by its file's ending: .npz, .npy, .csv or .parquet; others are refused."""
    for kind in ("npz", "npy"):
        if path.endswith(f".{kind}"):
            register(spark)
            return spark.read.format(f"nearfield_{kind}").option("path", path).load()
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file {path}; .npz, .npy, .csv and .parquet are read")
