"""Global ranks without a global window: values are dealt into ranges, ranked there, and shifted by the ranges before."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import bounded, settle

#: Values that a range holds, about, and the most ranges; their bounds are all that the driver holds.
RANGE_ROWS, MOST_RANGES = 50_000, 4096
#: Shares of rows about a quantile that are ranked: ten times what approximate quantiles may be off.
BRACKET = 1e-3


def range_count(n: int) -> int:
    """Ranges for n rows."""
    return max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))


def range_of(cuts: Column, value: Column, n: int) -> Column:
    """How many of ``n`` or fewer ordered cuts lie below a value: first among every so-many-th, then among those in between."""
    step = max(1, math.isqrt(n))
    if n <= 2 * step:
        return F.size(F.filter(cuts, lambda c: c < value))
    coarse = F.transform(F.sequence(F.lit(step), F.greatest(F.size(cuts), F.lit(step)), F.lit(step)), lambda k: F.get(cuts, k - 1))
    passed = F.size(F.filter(coarse, lambda c: c < value)) * step
    return passed + F.size(F.filter(F.slice(cuts, passed + 1, step), lambda c: c < value))


def _cuts(df: DataFrame, values: list[str]) -> list[list[float]]:
    """For each value column the approximate quantiles that part its ranges; one pass counts, one more finds them if needed."""
    n = range_count(df.count())
    if n == 1:
        return [[] for _ in values]
    shares = [k / n for k in range(1, n)]
    row = df.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"q{k}") for k, v in enumerate(values)]).first()
    return [sorted({float(c) for c in q or []}) for q in row]


def value_ranks(df: DataFrame, value: str, cuts: list[float] | None = None) -> DataFrame:
    """(value, before, n) of each distinct value: how many rows have a lesser one, and how many have it."""
    cuts = _cuts(df, [value])[0] if cuts is None else cuts
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("cast(array() as array<double>)")
    each = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    each = each.withColumn("_range", range_of(bounds, F.col(value), len(cuts)) if cuts else F.lit(0))
    own = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = each.withColumn("_local", F.coalesce(F.sum("n").over(own), F.lit(0)))
    if not cuts:
        return local.select(value, F.col("_local").alias("before"), "n")
    sizes = each.groupBy("_range").agg(F.sum("n").alias("_size"))
    prior = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over MOST_RANGES rows at most
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(prior), F.lit(0))).select("_range", "_shift")
    return local.join(F.broadcast(shift), "_range").select(value, (F.col("_shift") + F.col("_local")).alias("before"), "n")


def average_rank(df: DataFrame, value: str, name: str, cuts: list[float] | None = None) -> DataFrame:
    """``df`` with the rank of a value from 1; equal values share their mean rank."""
    ranks = value_ranks(df, value, cuts).select(F.col(value).alias("_v"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    return df.join(ranks, df[value] == ranks["_v"]).drop("_v")


def average_rank_within(df: DataFrame, key: str, value: str, name: str, ranges: int = 32) -> DataFrame:
    """``df`` with the rank of a value among the rows of its key, from 1; equal values share their mean rank.

    Each key's values are dealt into ranges of their own. Rows without a key or a value are left out.
    """
    shares = [k / ranges for k in range(1, ranges)]
    cuts = df.groupBy(F.col(key).alias("_key")).agg(F.percentile_approx(value, shares, 1000).alias("_cuts"))
    each = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    each = each.join(cuts, "_key").withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    prior = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # ``ranges`` rows a key at most
    shift = each.groupBy("_key", "_range").agg(F.sum("_c").alias("_size")).select("_key", "_range", F.coalesce(F.sum("_size").over(prior), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("_key", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    local = each.withColumn("_local", F.coalesce(F.sum("_c").over(own), F.lit(0))).join(shift, ["_key", "_range"])
    ranks = local.select("_key", "_v", (F.col("_shift") + F.col("_local") + (F.col("_c") + 1) / 2.0).alias(name))
    return df.join(ranks, (df[key] == ranks["_key"]) & (df[value] == ranks["_v"])).drop("_key", "_v")


def ordinal_percentile(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """``df`` with the share of rows that come before it in order of value, then of ``tie``."""
    ranks = value_ranks(df, value).select(F.col(value).alias("_v"), "before")
    total = df.agg(F.count("*").alias("_n"))
    own = Window.partitionBy(value).orderBy(tie)
    out = df.join(ranks, df[value] == ranks["_v"]).drop("_v").withColumn("_k", F.row_number().over(own) - 1)
    return out.join(F.broadcast(total)).withColumn(name, (F.col("before") + F.col("_k")) / F.col("_n")).drop("before", "_k", "_n")


def exact_quantile(df: DataFrame, value: str, share: float, name: str, key: str | None = None) -> DataFrame:
    """One row, or one for each key: the exact quantile of a value, interpolated between the two values it lies between.

    Approximate quantiles bracket both places; rows below are counted, and only the values within the bracket are ranked. A key whose
    places turn out to lie outside has all its values ranked. Rows without a value or a key count for nothing; without any there is a
    null, or no row for a key.
    """
    named = df.select((F.col(key) if key else F.lit(0)).alias("_key"), F.col(value).alias("_v")).where(F.col("_v").isNotNull() & F.col("_key").isNotNull())
    named = settle(named, "values")
    ends = [max(0.0, share - BRACKET), min(1.0, share + BRACKET)]
    cuts = named.groupBy("_key").agg(F.percentile_approx("_v", ends, 10_000).alias("_cuts"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count("*").alias("_n"))
    cuts = cuts.select("_key", (F.lit(share) * (F.col("_n") - 1)).alias("_pos"), *[(F.col(f"_{e}") if share in (0.0, 1.0) else F.get("_cuts", F.lit(k))).alias(f"_{n}") for k, (n, e) in enumerate((("low", "min"), ("high", "max")))], "_min", "_max")
    cuts = bounded(cuts, "brackets")
    placed = named.join(cuts, "_key")
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    known = placed.groupBy("_key").agg(F.sum((F.col("_v") < F.col("_low")).cast("long")).alias("_before"), F.sum(inside.cast("long")).alias("_within"), F.first("_pos").alias("_pos"))
    hit = (F.col("_before") <= F.floor("_pos")) & (F.col("_before") + F.col("_within") > F.ceil("_pos"))
    known = settle(known.withColumn("_hit", hit), "brackets")
    before = bounded(known.select("_key", "_hit", F.when(F.col("_hit"), F.col("_before")).otherwise(0).alias("_before")), "brackets")
    each = placed.join(before, "_key").where(inside | ~F.col("_hit")).groupBy("_key", "_v").agg(F.count("*").alias("_c"), F.first("_before").alias("_before"), F.first("_pos").alias("_pos"))
    order = Window.partitionBy("_key").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)  # the values of a bracket
    found = each.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_c").over(order), F.lit(0)))
    at = lambda place: F.max(F.when((F.col("_at") <= place) & (place < F.col("_at") + F.col("_c")), F.col("_v")))
    ends = found.groupBy("_key").agg(at(F.floor("_pos")).alias("_a"), at(F.ceil("_pos")).alias("_b"), F.first("_pos").alias("_p"))
    quantile = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_p") - F.floor("_p")))
    if key:
        return ends.select(F.col("_key").alias(key), quantile.alias(name))
    return ends.select(quantile.alias(name)).agg(F.max(name).alias(name))


def pearson(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; null where a column does not vary, which ``corr`` takes for an error."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, a: str, b: str, name: str, undefined: float = 0.0) -> DataFrame:
    """One row: the correlation of the average ranks of two columns, ``undefined`` where it has no value.

    The pairs are settled once; all that follows reads that table and not what it was made from.
    """
    pairs = settle(df.select(F.col(a).alias("_a"), F.col(b).alias("_b")), "pairs")
    cuts = _cuts(pairs, ["_a", "_b"])
    ranked = average_rank(average_rank(pairs, "_a", "_ra", cuts[0]), "_b", "_rb", cuts[1])
    return ranked.agg(F.coalesce(pearson("_ra", "_rb"), F.lit(float(undefined))).alias(name))
