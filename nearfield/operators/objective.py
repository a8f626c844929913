"""Pairwise objectives of two views of a batch: affinities, losses and density terms over pair tables.

Rows: (batch, id, h, l) for view A and B. Pairs are made within a batch only, so their number is that of the rows times
the batch size, and every window holds one row of one batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distance import euclidean, squared_distance, student_t_kernel

#: Least positive single-precision number, under denominators.
TINY = 1.1754943508222875e-38


def _row():
    return Window.partitionBy("batch", "i")


def _col():
    return Window.partitionBy("batch", "j")


def _off() -> Column:
    """Whether a pair lies off the diagonal."""
    return F.col("i") != F.col("j")


def pair_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """(batch, i, j, d2, d): squared distance of data, 0 on the diagonal, and distance of pictures."""
    left = a.select("batch", F.col("id").alias("i"), F.col("h").alias("ha"), F.col("l").alias("la"))
    right = b.select("batch", F.col("id").alias("j"), F.col("h").alias("hb"), F.col("l").alias("lb"))
    d2 = F.when(_off(), F.greatest(squared_distance("ha", "hb"), F.lit(1e-12))).otherwise(F.lit(0.0))
    return left.join(right, "batch").select("batch", "i", "j", d2.alias("d2"), euclidean("la", "lb").alias("d"))


def rank_affinity(pairs: DataFrame, base: float) -> DataFrame:
    """px and py: base to the rank of a pair in its row and in its column, from 0."""
    by = lambda w, tie: F.exp((F.row_number().over(w.orderBy("d2", tie)) - 1) * F.log(F.lit(base)))
    return pairs.withColumns({"px": by(_row(), "j"), "py": by(_col(), "i")})


def distance_affinity(pairs: DataFrame) -> DataFrame:
    """px and py: exp of minus the distance by the mean of its row and of its column."""
    of = lambda w: F.exp(-F.col("d2") / (F.avg("d2").over(w) + 1e-8))
    return pairs.withColumns({"px": of(_row()), "py": of(_col())})


def row_normalised(pairs: DataFrame, column: str) -> DataFrame:
    """``column`` by its row's sum off the diagonal; the diagonal stays."""
    total = F.greatest(F.sum(F.when(_off(), F.col(column)).otherwise(0.0)).over(_row()), F.lit(TINY))
    return pairs.withColumn(column, F.when(_off(), F.col(column) / total).otherwise(F.col(column)))


def student_t_affinity(pairs: DataFrame, nu: float) -> DataFrame:
    """q: the Student-t kernel by its row's sum off the diagonal; on the diagonal it may exceed 1."""
    kernel = pairs.withColumn("q", student_t_kernel(F.greatest("d", F.lit(0.0)) + 1e-9, nu))
    total = F.greatest(F.sum(F.when(_off(), F.col("q")).otherwise(0.0)).over(_row()), F.lit(TINY))
    return kernel.withColumn("q", F.col("q") / total)


def pair_loss(p: Column, q: Column, eps: float = 1e-8) -> Column:
    """Bernoulli loss of a pair; the diagonal has no negative term."""
    negative = F.when(_off(), F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return -(p * F.log(q + eps) + (1 - p) * F.log(1 - negative + eps))


def manifold_loss(a: DataFrame, b: DataFrame, affinity: str = "rank", base: float = 0.9, nu: float = 0.1, both_sides: bool = True, least: float = 1e-5, row_normalise: bool = False, hard: int | None = None) -> DataFrame:
    """(batch, loss): mean pair loss of data affinity against the picture's, over all pairs or each row's hardest."""
    if affinity not in ("rank", "distance"):
        raise ValueError(f"unknown affinity {affinity}")
    if row_normalise and affinity != "distance":
        raise ValueError("row normalisation needs the distance affinity")
    pairs = pair_table(a, b)
    pairs = rank_affinity(pairs, base) if affinity == "rank" else distance_affinity(pairs)
    p = F.sqrt(F.col("px") * F.col("py")) if both_sides else F.col("px")
    pairs = pairs.withColumn("p", F.greatest(p, F.lit(least)))
    if row_normalise:
        pairs = row_normalised(pairs, "p")
    lossy = student_t_affinity(pairs, nu).withColumn("loss", pair_loss(F.col("p"), F.col("q")))
    if hard:
        lossy = lossy.withColumn("_r", F.rank().over(_row().orderBy(F.desc("loss")))).where(F.col("_r") <= hard)
    return lossy.groupBy("batch").agg(F.avg("loss").alias("loss"))


def contrastive_loss(a: DataFrame, b: DataFrame, nu: float) -> DataFrame:
    """(batch, loss): minus the mean log affinity of matching views, plus the log of all affinities off the diagonal."""
    pairs = pair_table(a, b).withColumn("k", student_t_kernel(F.col("d"), nu))
    return pairs.groupBy("batch").agg((-F.avg(F.when(~_off(), F.log("k"))) + F.log(F.sum(F.when(_off(), F.col("k"))))).alias("loss"))


def pearson_loss(df: DataFrame, x: str, y: str, by: list[str], eps: float = 1e-8) -> DataFrame:
    """1 minus the correlation of two columns, with a floor under the product of their norms."""
    cov = F.covar_pop(x, y) * F.count("*")
    norms = F.sqrt(F.var_pop(x) * F.count("*")) * F.sqrt(F.var_pop(y) * F.count("*"))
    return df.groupBy(*by).agg((1 - cov / (norms + eps)).alias("loss"))


def density_loss(a: DataFrame, k: int) -> DataFrame:
    """(batch, loss): mean over k // 2 and k of 1 minus the correlation of log densities within the batch."""
    pairs = pair_table(a, a).where(_off()).withColumns({"rh": F.row_number().over(_row().orderBy("d2", "j")), "rl": F.row_number().over(_row().orderBy("d", "j"))})
    parts = None
    for m in sorted({max(1, k // 2), k}):
        hd = F.max(F.when(F.col("rh") == m, -F.log(F.sqrt("d2") + 1e-8)))
        ld = F.max(F.when(F.col("rl") == m, -F.log(F.col("d") + 1e-8)))
        one = pearson_loss(pairs.groupBy("batch", "i").agg(hd.alias("x"), ld.alias("y")), "x", "y", ["batch"])
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("batch").agg(F.avg("loss").alias("loss"))


def nearest_code(rows: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """(id, code, d2) of the nearest code of each row, ties to the lesser code. codes: (code, v), few by construction."""
    d2 = squared_distance(F.col(column), F.col("v"))
    near = rows.select("id", column).join(F.broadcast(codes)).withColumn("d2", d2)
    return near.groupBy("id").agg(F.min(F.struct(F.round("d2", 12).alias("d2"), "code")).alias("m")).select("id", "m.code", "m.d2")
