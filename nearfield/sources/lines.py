"""Text files whose rows belong together by their place: line numbers without one task for all lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import bounded, settle


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file, or of all files of a folder in order of their names, numbered from 0.

    Each split of a file is read as one stretch: lines are numbered within it, and the counts of the splits before it are added.
    Only these counts, one for each split, are put in order in one task. Blank lines count. No lines give no rows.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    rows = settle(rows, "lines")
    splits = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bounded(splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    return rows.join(offsets, ["file", "start"]).select((F.col("offset") + F.col("at") - F.col("first")).alias("line"), "value")


def zipped(tables: dict[str, DataFrame]) -> DataFrame:
    """(line, one column for each table): tables (line, value) side by side; different lengths are an error."""
    sizes = {name: df.count() for name, df in tables.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"files of different length: {sizes}")
    out = None
    for name, df in tables.items():
        side = df.select("line", F.col("value").alias(name))
        out = side if out is None else out.join(side, "line")
    return out


def matched_by_place(spark: SparkSession, matrix: str, sides: dict[str, str]) -> DataFrame:
    """(line, features, one column for each side file): a text matrix and headerless single-column files, row by row."""
    found = zipped({"_row": numbered_lines(spark, matrix)} | {name: numbered_lines(spark, path) for name, path in sides.items()})
    numbers = F.split(F.trim(F.regexp_replace("_row", r"\s+", " ")), " ").cast("array<double>")
    return found.select("line", numbers.alias("features"), *[F.trim(F.col(name)).alias(name) for name in sides])
