"""Result tables: stacked embeddings, metric rows and run records, appended by Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schema of an embedding table as CSV.
EMBEDDING = "cell_id string, method string, layer int, x double, y double"


def stacked(df: DataFrame, layers: str, method: str) -> DataFrame:
    """(cell_id, method, layer, x, y): one row for each point and layer. ``layers``: an array of 2-D points."""
    each = df.select(F.col("id").cast("string").alias("cell_id"), F.lit(method).alias("method"), F.posexplode(layers).alias("layer", "p"))
    return each.select("cell_id", "method", "layer", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def write_embedding(df: DataFrame, path: str) -> None:
    """Appends stacked rows as CSV, one folder for each layer."""
    df.write.mode("append").partitionBy("layer").csv(path, header=True)


def write_epoch(df: DataFrame, path: str, epoch: int, rows: int) -> None:
    """Appends the stacked rows of one epoch as CSV; a number of points that is not ``rows`` is an error before any is written."""
    n = df.select("cell_id").distinct().count()
    if n != rows:
        raise ValueError(f"{n} points in the picture, {rows} in the data")
    df.withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("epoch", "layer").csv(path, header=True)


def write_consolidated(df: DataFrame, layers: str, labels: str, path: str, method: str, dataset: str) -> None:
    """One table of cell_id, label, method, dataset, num_layers and a column for each layer, as Parquet."""
    n = df.select(F.max(F.size(layers))).first()[0] or 0
    head = [F.col("id").cast("string").alias("cell_id"), F.col(labels).alias("label"), F.lit(method).alias("method"), F.lit(dataset).alias("dataset"), F.lit(n).alias("num_layers")]
    df.select(*head, *[F.get(layers, F.lit(k)).alias(f"layer_{k}") for k in range(n)]).write.mode("overwrite").parquet(path)


def read_embedding(spark, path: str) -> DataFrame:
    """Stacked rows of all layers; ids stay text."""
    return spark.read.schema("cell_id string, method string, x double, y double, layer int").csv(path, header=True).select("cell_id", "method", "layer", "x", "y")


def append_json(df: DataFrame, path: str) -> None:
    """Appends rows as lines of JSON, columns in order of name."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def append_records(df: DataFrame, path: str, columns: list[str]) -> None:
    """Appends run records as CSV with a fixed order of columns; one that is missing is empty."""
    row = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*row).write.mode("append").csv(path, header=True)
