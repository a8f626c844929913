"""Seeded samples by hash order: the same rows in every engine and on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_key(seed: int, *parts: Column | str) -> Column:
    """md5 of the parts and the seed, joined by colons; rows are sampled in its order."""
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed))).cast("binary"))


def subsample(df: DataFrame, id_col: str, size: int | None, seed: int = 42) -> DataFrame:
    """``size`` rows in hash order; all rows for no, a negative or too large a size."""
    if size is None or size < 0:
        return df
    return df.orderBy(hash_key(seed, id_col), id_col).limit(size)


def hash_pick(n: Column, seed: int, *parts: Column | str) -> Column:
    """A number under n from the first 7 hex digits of the hash."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 7), 16, 10).cast("long") % n


def random_tuples(spark, ids: DataFrame, count: int, width: int, seed: int = 42) -> DataFrame:
    """(t, i0, i1, ...): up to ``count`` tuples of distinct ids, drawn by hash from ids 0..n-1 in order of id.

    ids: (pos, id) with positions from 0. A tuple with a repeated id is dropped, as a redraw would not be repeatable.
    """
    n = ids.count()
    draws = spark.range(count).withColumnRenamed("id", "t")
    for k in range(width):
        draws = draws.withColumn(f"p{k}", hash_pick(F.lit(max(1, n)), seed, F.col("t"), F.lit(k)))
    for a in range(width):
        for b in range(a):
            draws = draws.where(F.col(f"p{a}") != F.col(f"p{b}"))
    for k in range(width):
        draws = draws.join(ids.select(F.col("pos").alias(f"p{k}"), F.col("id").alias(f"i{k}")), f"p{k}")
    return draws.select("t", *[f"i{k}" for k in range(width)])


def stratified(df: DataFrame, id_col: str, label: str, size: int, seed: int = 42) -> DataFrame:
    """An equal share of each label, the rest of the division to the first labels in order; exact in size."""
    labels = df.select(label).distinct()
    quota = labels.withColumns({"_k": F.row_number().over(Window.orderBy(label)) - 1, "_c": F.count("*").over(Window.partitionBy())})
    quota = quota.select(label, (F.floor(F.lit(size) / F.col("_c")) + (F.col("_k") < F.lit(size) % F.col("_c")).cast("int")).alias("_quota"))
    own = Window.partitionBy(label).orderBy(hash_key(seed, id_col), id_col)
    return df.join(F.broadcast(quota), label).withColumn("_r", F.row_number().over(own)).where("_r <= _quota").select(df.columns)


def batches(df: DataFrame, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """``df`` with batch: full batches of ``size`` rows in hash order; a short last one is dropped.

    Hash order is cut into 16 ranges by its first digit, so that no window holds more than one of them.
    """
    keyed = df.withColumn("_h", hash_key(seed, id_col)).withColumn("_range", F.substring("_h", 1, 1))
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    prior = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # 16 rows
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_shift"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    own = Window.partitionBy("_range").orderBy("_h", id_col)
    placed = keyed.withColumn("_r", F.row_number().over(own) - 1).join(F.broadcast(shift), "_range").withColumn("batch", F.floor((F.col("_shift") + F.col("_r")) / size))
    return placed.where(F.col("batch") < F.floor(F.col("_total") / size)).select(*df.columns, "batch")


def with_position(df: DataFrame, id_col: str) -> DataFrame:
    """(pos, id): places from 0 in order of id, by ranges and no global window."""
    from ..functions.ranks import value_ranks

    ranks = value_ranks(df.select(F.col(id_col).alias("id")), "id")
    return ranks.select(F.col("before").cast("long").alias("pos"), "id")
