"""Augmented views of points: mixes with neighbours and walks on the neighbour graph, seeded by hash; a registry of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import hash_key, hash_pick

#: Named transforms: (points, knn, seed, **parameters) -> points with ``aug``.
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def transform(name: str):
    """Adds a transform to the registry."""

    def add(f):
        TRANSFORMS[name] = f
        return f

    return add


def _share(seed: int, *parts):
    """A number in [0, 1) from the hash."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 7), 16, 10).cast("double") / float(1 << 28)


def walk(starts: DataFrame, knn: DataFrame, k: int, hops: int, seed: int) -> DataFrame:
    """(id, node): where a walk of ``hops`` steps ends, each step to the neighbour of a hash-picked rank."""
    at = starts.select("id", F.col("id").alias("node"))
    for h in range(hops):
        step = at.withColumn("rank", (hash_pick(F.lit(k), seed, F.col("id"), F.lit(h)) + 1).cast("int"))
        at = step.join(knn.select(F.col("src").alias("node"), "rank", F.col("dst").alias("next")), ["node", "rank"]).select("id", F.col("next").alias("node"))
    return at


def _mixed(pts: DataFrame, ends: DataFrame, seed: int, column: str) -> DataFrame:
    other = pts.select(F.col("id").alias("node"), F.col(column).alias("_other"))
    joined = pts.join(ends, "id").join(other, "node").withColumn("alpha", _share(seed, F.lit("alpha"), "id"))
    return joined.withColumn("aug", F.zip_with(column, "_other", lambda a, b: a * F.col("alpha") + b * (1 - F.col("alpha")))).drop("_other")


@transform("neighbor_mixup")
def neighbor_mixup(pts: DataFrame, knn: DataFrame, seed: int = 42, k: int = 5, column: str = "hd") -> DataFrame:
    """Each point mixed with one neighbour."""
    return _mixed(pts, walk(pts, knn, k, 1, seed), seed, column)


@transform("trace_mixup")
def trace_mixup(pts: DataFrame, knn: DataFrame, seed: int = 42, k: int = 5, hops: int = 3, column: str = "hd") -> DataFrame:
    """Each point mixed with the end of a walk."""
    return _mixed(pts, walk(pts, knn, k, hops, seed), seed, column)


@transform("feature_dropout")
def feature_dropout(pts: DataFrame, knn: DataFrame | None = None, seed: int = 42, rate: float = 0.2, column: str = "hd") -> DataFrame:
    """Each value set to 0 with a probability, by hash of id and place."""
    return pts.withColumn("aug", F.transform(column, lambda x, i: F.when(_share(seed, F.col("id"), i) < rate, F.lit(0.0)).otherwise(x)))


def apply(names: list[str], pts: DataFrame, knn: DataFrame, seed: int = 42) -> DataFrame:
    """The transforms in order, each on the last one's result; an unknown name is an error."""
    out = pts
    for name in names:
        if name not in TRANSFORMS:
            raise KeyError(f"unknown transform {name}; known: {sorted(TRANSFORMS)}")
        done = TRANSFORMS[name](out, knn, seed)
        out = done.select(*[F.col("aug").alias("hd") if c == "hd" else F.col(c) for c in pts.columns])
    return out.select("id", F.col("hd").alias("aug")).join(pts, "id")
