"""A branching cloud of points, made by Spark expressions from a seed; for examples and tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def branches(spark: SparkSession, n: int = 600, features: int = 32, seed: int = 42) -> DataFrame:
    """row_id, features, label and latent: three bent arms of growing noise in 3-D, cast into more dimensions."""
    base = spark.range(n).withColumnsRenamed({"id": "row_id"})
    base = base.withColumns({"label": (F.col("row_id") % 3).cast("int"), "r": F.pow(F.rand(seed), F.lit(2.0))})
    angle = F.col("label") * F.lit(2 * math.pi / 3) + F.col("r") * 0.8
    noise = lambda k: F.randn(seed + k) * (0.02 + 0.08 * F.col("r"))
    latent = F.array(F.col("r") * F.cos(angle) + noise(1), F.col("r") * F.sin(angle) + noise(2), F.col("r") * 0.5 + noise(3))
    weight = lambda k, j: math.sin(12.9898 * (k + 1) + 78.233 * (j + 1) + seed)
    cast = F.array(*[sum((F.get("latent", F.lit(j)) * weight(k, j) for j in range(3)), F.lit(0.0)) for k in range(features)])
    return base.withColumn("latent", latent).withColumn("features", cast).select("row_id", "features", "label", "latent")
