"""Tables as users keep them: several CSV files as one, text matrices, stacked embeddings, side inputs, cached neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import short_digest
from ..operators import neighbours as nb
from .sinks import EMBEDDING


def csv_union(spark: SparkSession, paths: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows of CSV files with a header, by column name, without the columns ``drop``."""
    parts = [spark.read.csv(p, header=True, inferSchema=True) for p in paths]
    return reduce(lambda a, b: a.unionByName(b), parts).drop(*drop)


def text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(features): one row for each line that is not blank, its numbers parted by white space."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    return spark.read.text(path).where(line != "").select(F.split(line, " ").cast("array<double>").alias("features"))


def flattened(df: DataFrame, images: str) -> DataFrame:
    """``df`` with an image, an array of rows, as one array of its values."""
    return df.withColumn(images, F.flatten(images))


def reshaped(df: DataFrame, features: str, width: int) -> DataFrame:
    """``df`` with an array as rows of ``width`` values; a length that does not fit is an error at the first such row."""
    ok = F.size(features) % width == 0
    rows = F.transform(F.sequence(F.lit(0), (F.size(features) / width).cast("int") - 1), lambda k: F.slice(features, k * width + 1, width))
    return df.withColumn(features, F.when(ok, rows).otherwise(F.raise_error(F.lit(f"length is no multiple of {width}")).cast("array<array<double>>")))


def embeddings(spark: SparkSession, pattern: str, method: str | None = None, layer: int | None = None) -> DataFrame:
    """(cell_id, method, layer, x, y, file) of all CSV files that a pattern names; ids are text, the method may be overridden."""
    rows = spark.read.schema(EMBEDDING).csv(pattern, header=True).withColumn("file", F.input_file_name())
    if method is not None:
        rows = rows.withColumn("method", F.lit(method))
    return rows if layer is None else rows.where(F.col("layer") == layer)


def with_side(df: DataFrame, side: DataFrame | None, key: str, value: str) -> DataFrame:
    """``df`` with a side value by key; one whose number of rows differs is ignored, and the value is null."""
    if side is None or side.count() != df.count():
        return df.withColumn(value, F.lit(None).cast("double"))
    return df.join(side.select(key, value), key, "left")


def cached_knn(pts: DataFrame, k: int, column: str, folder: str, source: str) -> DataFrame:
    """Neighbours of a table, read from ``folder`` where they are kept under the digest of source, content and parameters.

    The content counts by its rows and the sum of their hashes, one pass; what is not kept is worked out and written.
    """
    seen = pts.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", column).cast("decimal(38,0)")).alias("h"))
    key = seen.select(short_digest(F.lit(source), "n", "h", F.lit(k), F.lit(column)).alias("k")).first()["k"]
    path = f"{folder.rstrip('/')}/{key}"
    spark = pts.sparkSession
    try:
        spark.read.parquet(f"{path}/done")  # written last, so that a table cut short is never taken
    except AnalysisException:
        nb.knn(pts, k, column).write.mode("overwrite").parquet(f"{path}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/rows")


# ---------------------------------------------------------------- columns
def add_if_present(df: DataFrame, source: str, target: str) -> DataFrame:
    """``df`` with a copy of a column under another name, where it has it."""
    return df.withColumn(target, F.col(source)) if source in df.columns else df


def prefix_columns(df: DataFrame, prefix: str, key: str) -> DataFrame:
    """``key`` and the columns that begin with a prefix, without it and as numbers."""
    return df.select(key, *[F.col(f"`{c}`").try_cast("double").alias(c.removeprefix(prefix)) for c in df.columns if c.startswith(prefix)])


def annotations(df: DataFrame, label: str, targets: tuple[str, ...] = ("celltype", "leiden", "branch")) -> DataFrame:
    """``df`` with its label as text under each of the names."""
    return df.withColumns({t: F.col(label).cast("string") for t in targets})


def first_label(df: DataFrame, label: str) -> DataFrame:
    """``df`` with the first of its labels where it holds an array of them."""
    return df.withColumn(label, F.get(label, F.lit(0))) if dict(df.dtypes)[label].startswith("array") else df


#: Older names of metrics.
ALIASES = {"knn": "knn_preservation", "trust": "trustworthiness", "dist_corr": "shepard", "den_corr": "density_correlation", "ldc": "local_density_correlation"}


def with_aliases(metrics: DataFrame) -> DataFrame:
    """A row of metrics with their older names too, for those it has."""
    return metrics.withColumns({a: F.col(c) for a, c in ALIASES.items() if c in metrics.columns})
