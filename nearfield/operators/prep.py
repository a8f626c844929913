"""Preparation of feature tables: checks, filters, scaling, selection and coding. Rows: id, features, and more."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import value_ranks
from ..functions.tables import bounded, settle


def is_finite(features: str) -> Column:
    """Whether no value is missing, NaN or infinite."""
    return F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def require_finite(df: DataFrame, features: str) -> DataFrame:
    """``df``; reading it fails at the first row that is not finite."""
    ok = F.assert_true(is_finite(features), F.lit("features must be finite"))
    return df.where(F.coalesce(ok.cast("string"), F.lit("")) == "")


def finite_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that are finite in all the columns."""
    for c in columns:
        df = df.where(is_finite(c))
    return df


def coordinates(df: DataFrame, features: str) -> DataFrame:
    """(id, pos, x): one row for each value."""
    return df.select("id", F.posexplode(features).alias("pos", "x"))


def per_feature(df: DataFrame, features: str, *names: str) -> DataFrame:
    """One row with an array by name: mean, sd and var (of the population), sd_samp, lo, hi; one pass, no row a value."""
    s = df.select(Summarizer.metrics("count", "mean", "variance", "min", "max").summary(array_to_vector(F.col(features))).alias("s"))
    of = lambda c: vector_to_array(F.col(f"s.{c}"))
    share = (F.col("s.count") - 1) / F.col("s.count")
    var = F.transform(of("variance"), lambda v: v * share)
    made = {"mean": of("mean"), "var": var, "sd": F.transform(var, lambda v: F.sqrt(v)), "sd_samp": F.transform(of("variance"), lambda v: F.sqrt(v)), "lo": of("min"), "hi": of("max")}
    return s.select(*[made[n].alias(n) for n in names])


def z_score(df: DataFrame, features: str, floor: float = 1e-8, zero_as_one: bool = False) -> DataFrame:
    """Features less their mean, by their population deviation: floored, or with 0 taken for 1."""
    stats = per_feature(df, features, "mean", "sd")
    scale = (lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s)) if zero_as_one else (lambda s: F.greatest(s, F.lit(floor)))
    value = F.zip_with(F.zip_with(features, "mean", lambda x, m: x - m), F.transform("sd", scale), lambda d, s: d / s)
    return df.join(F.broadcast(stats)).withColumn(features, value).drop("mean", "sd")


def min_max(df: DataFrame, features: str) -> DataFrame:
    """Features scaled to [0, 1]; a constant one becomes 0."""
    stats = per_feature(df, features, "lo", "hi")
    width = F.zip_with("hi", "lo", lambda h, low: F.when(h > low, h - low).otherwise(F.lit(1.0)))
    value = F.zip_with(F.zip_with(features, "lo", lambda x, low: x - low), width, lambda d, w: d / w)
    return df.join(F.broadcast(stats)).withColumn(features, value).drop("lo", "hi")


def global_min_max(df: DataFrame, features: str) -> DataFrame:
    """All features by one minimum and maximum."""
    ends = df.agg(F.min(F.array_min(features)).alias("lo"), F.max(F.array_max(features)).alias("hi"))
    return df.join(F.broadcast(ends)).withColumn(features, F.transform(features, lambda x: (x - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")


def centre_by_max(df: DataFrame, features: str) -> DataFrame:
    """Features less their mean, by the one greatest absolute value left."""
    stats = per_feature(df, features, "mean")
    centred = df.join(F.broadcast(stats)).withColumn(features, F.zip_with(features, "mean", lambda x, m: x - m)).drop("mean")
    most = centred.agg(F.max(F.array_max(F.transform(features, F.abs))).alias("most"))
    return centred.join(F.broadcast(most)).withColumn(features, F.transform(features, lambda x: x / F.col("most"))).drop("most")


def log_counts(df: DataFrame, features: str) -> DataFrame:
    """log(1 + x), negative values taken for 0."""
    return df.withColumn(features, F.transform(features, lambda x: F.log1p(F.greatest(x, F.lit(0.0)))))


def sanitise(df: DataFrame, features: str) -> DataFrame:
    """NaN to 0, infinities to a million with their sign, then each feature less its mean."""
    big = 1e6

    def clean(x: Column) -> Column:
        return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).when(x == float("inf"), F.lit(big)).when(x == float("-inf"), F.lit(-big)).otherwise(x)

    cleaned = df.withColumn(features, F.transform(features, clean))
    stats = per_feature(cleaned, features, "mean")
    return cleaned.join(F.broadcast(stats)).withColumn(features, F.zip_with(features, "mean", lambda x, m: x - m)).drop("mean")


def keep_features(df: DataFrame, features: str, kept: DataFrame) -> DataFrame:
    """Only the features whose ``pos`` is in ``kept``, in their old order."""
    index = kept.agg(F.array_sort(F.collect_list("pos")).alias("kept"))
    return df.join(F.broadcast(index)).withColumn(features, F.transform("kept", lambda p: F.get(features, p))).drop("kept")


def features_above(df: DataFrame, features: str, least: float) -> DataFrame:
    """(pos) of the features whose greatest value is over ``least``."""
    return coordinates(df, features).groupBy("pos").agg(F.max("x").alias("m")).where(F.col("m") > least).select("pos")


def top_variance(df: DataFrame, features: str, k: int) -> DataFrame:
    """(pos) of the k features of greatest population variance; NaN comes last, ties to the first feature."""
    each = coordinates(df, features).groupBy("pos").agg(F.var_pop("x").alias("v"))
    return each.withColumn("v", F.when(F.isnan("v"), F.lit(float("-inf"))).otherwise(F.col("v"))).orderBy(F.desc("v"), "pos").limit(k).select("pos")


def drop_rare(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of labels that have ``least`` rows or more."""
    common = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(common, label, "left_semi")


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """``df`` with code: the place of the label among all labels in order, from 0."""
    names = settle(df.where(F.col(label).isNotNull()).select(label).distinct(), "labels")
    codes = value_ranks(names, label).select(label, F.col("before").cast("int").alias("code"))
    return df.join(bounded(codes, "codes"), label)


def pad_even(df: DataFrame, features: str) -> DataFrame:
    """One more zero where the number of features is odd."""
    return df.withColumn(features, F.when(F.size(features) % 2 == 1, F.concat(features, F.array(F.lit(0.0)))).otherwise(F.col(features)))


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate that is a column; a missing one is an error. Decided before any row is read."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {candidates} in {df.columns}")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def align(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left rows with the first right row of their key; missing ones stay, with nulls."""
    return left.join(keep_first(right, key, order), key, "left")


def zip_rows(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of equal place side by side; different numbers of rows are an error."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows on the left, {b} on the right")
    return left.join(right, pos)


def standardise(df: DataFrame, features: str, mode: str = "axis", floor: float = 1e-6) -> DataFrame:
    """Centred features by their own deviation (``axis``), that with a floor (``floored``), or one scale (``global``)."""
    stats = per_feature(df, features, "mean", "sd_samp", "var")
    centred = df.join(F.broadcast(stats)).withColumn(features, F.zip_with(features, "mean", lambda x, m: x - m))
    if mode == "global":
        rms = F.sqrt(F.greatest(F.aggregate("var", F.lit(0.0), lambda s, v: s + v) / F.size("var"), F.lit(floor * floor)))
        value = F.transform(features, lambda x: x / rms)
    elif mode in ("axis", "floored"):
        scale = (lambda s: F.greatest(s, F.lit(floor))) if mode == "floored" else (lambda s: s + F.lit(1e-8))
        value = F.zip_with(features, F.transform("sd_samp", scale), lambda d, s: d / s)
    else:
        raise ValueError(f"unknown mode {mode}")
    return centred.withColumn(features, value).drop("mean", "sd_samp", "var")
