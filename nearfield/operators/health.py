"""Health of a picture and of a training run: collapse, spread, stability of loss series, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def axis_ratio(xx: Column, yy: Column, xy: Column) -> Column:
    """The lesser singular value of centred 2-D points by the greater one, from their (co)variances."""
    mid, half = (xx + yy) / 2, F.sqrt(F.pow((xx - yy) / 2, F.lit(2.0)) + xy * xy)
    return F.sqrt(F.greatest(mid - half, F.lit(0.0))) / F.greatest(F.sqrt(mid + half), F.lit(1e-12))


def _spread(name: str) -> Column:
    return axis_ratio(F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")).alias(name)


def embedding_health(xy: DataFrame, std_least: float = 1e-6, axis_least: float = 1e-3, line_least: float = 5e-2) -> DataFrame:
    """One row on a table of (id, x, y): share of non-finite rows, spread, axis ratios, norms, and two flags.

    The trimmed ratio leaves out the ceil(0.1 %) rows of greatest norm.
    """
    ok = xy.where(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).withColumn("norm", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))
    total = xy.agg(F.count("*").alias("total"))
    whole = ok.agg(F.count("*").alias("n"), F.least(F.stddev_pop("x"), F.stddev_pop("y")).alias("std_min"), _spread("axis_ratio"), F.percentile("norm", 0.5).alias("norm_median"), F.max("norm").alias("norm_max"))
    # the rows cut off are 0.1 %: a top-k by norm and an anti-join, no global window
    cut = int(-(-ok.count() // 1000))
    top = ok.orderBy(F.desc("norm"), F.desc("id")).limit(cut).select("id")
    trimmed = ok.join(F.broadcast(top) if cut <= 100_000 else top, "id", "left_anti").agg(_spread("axis_ratio_trimmed"))
    row = whole.join(total).join(trimmed)
    lost = (1.0 - F.col("n") / F.col("total")).alias("nonfinite_fraction")
    flag = lambda least: ((F.col("nonfinite_fraction") > 0) | (F.col("std_min") < std_least) | (F.col("axis_ratio") < least)).cast("double")
    row = row.select(lost, "std_min", "axis_ratio", "axis_ratio_trimmed", "norm_median", "norm_max", (F.col("norm_max") / F.greatest("norm_median", F.lit(1e-12))).alias("norm_max_median_ratio"))
    return row.withColumns({"near_line": flag(line_least), "collapsed": flag(axis_least)})


def raw_diagnostics(xy: DataFrame, line_least: float = 5e-2) -> DataFrame:
    """Deviation of each axis, one scale for both, ratios of deviations and of eigenvalues, and whether it is near a line."""
    sx, sy = F.stddev_pop("x"), F.stddev_pop("y")
    row = xy.agg(sx.alias("std_x"), sy.alias("std_y"), F.sqrt((F.var_pop("x") + F.var_pop("y")) / 2).alias("global_rms"), _spread("axis_ratio"))
    row = row.withColumn("std_ratio", F.least("std_x", "std_y") / F.greatest("std_x", "std_y", F.lit(1e-12)))
    return row.withColumn("near_line", (F.col("axis_ratio") < line_least).cast("double"))


def loss_stability(series: DataFrame, cv_most: float = 0.25, turns_most: float = 0.5, spike_most: float = 3.0) -> DataFrame:
    """One row for each ``name`` of (name, epoch, value): variation, share of turns, greatest spike, oscillation."""
    ok = series.where(~F.isnan("value") & (F.abs("value") < float("inf")))
    order = Window.partitionBy("name").orderBy("epoch")
    step = F.col("value") - F.lag("value").over(order)
    moves = ok.withColumn("step", step).where(F.abs("step") > 1e-12).withColumn("turn", F.signum("step") != F.lag(F.signum("step")).over(order))
    turns = moves.groupBy("name").agg(F.coalesce(F.avg(F.col("turn").cast("double")), F.lit(0.0)).alias("direction_change_rate"))
    size = F.abs("value")
    sums = ok.groupBy("name").agg((F.stddev_pop("value") / F.greatest(F.avg(size), F.lit(1e-12))).alias("tail_cv"), (F.max(size) / F.greatest(F.percentile(size, 0.5), F.lit(1e-12))).alias("spike_ratio"))
    out = sums.join(turns, "name", "left").withColumn("direction_change_rate", F.coalesce("direction_change_rate", F.lit(0.0)))
    swings = ((F.col("tail_cv") >= cv_most) & (F.col("direction_change_rate") >= turns_most)) | (F.col("spike_ratio") >= spike_most)
    return out.select("name", "tail_cv", "direction_change_rate", "spike_ratio", swings.alias("oscillation_detected"))


def epoch_means(values: DataFrame) -> DataFrame:
    """Mean of the finite values of each (name, epoch)."""
    return values.where(~F.isnan("value") & (F.abs("value") < float("inf"))).groupBy("name", "epoch").agg(F.avg("value").alias("value"))


def final_status(series: DataFrame, tail: int) -> DataFrame:
    """Last value of each name, stability of its last ``tail`` epochs, and whether any name oscillates."""
    last = Window.partitionBy("name").orderBy(F.desc("epoch"))
    ends = series.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= tail)
    stable = loss_stability(ends.select("name", "epoch", "value"))
    values = series.groupBy("name").agg(F.max_by("value", "epoch").alias("last_value"))
    return values.join(stable, "name").withColumn("any_oscillation", F.bool_or("oscillation_detected").over(Window.partitionBy()))


def epoch_times(seconds: DataFrame, skip: int = 5) -> DataFrame:
    """Mean, median, sample deviation and steady mean (after the first epochs, else of all) of each run."""
    own = Window.partitionBy("run").orderBy("epoch")
    placed = seconds.withColumn("_r", F.row_number().over(own))
    return placed.groupBy("run").agg(
        F.avg("seconds").alias("mean_seconds"),
        F.percentile("seconds", 0.5).alias("median_seconds"),
        F.stddev_samp("seconds").alias("std_seconds"),
        F.coalesce(F.avg(F.when(F.col("_r") > skip, F.col("seconds"))), F.avg("seconds")).alias("steady_seconds"),
    )


def capacity(parameters: DataFrame, baseline: float, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Parameters of each model, their ratio to a baseline, and whether it lies in the band."""
    sums = parameters.groupBy("model").agg(F.sum("numel").alias("parameters"))
    ratio = F.col("parameters") / F.lit(float(baseline))
    return sums.select("model", "parameters", ratio.alias("ratio"), ratio.between(low, high).alias("in_band"))


def nonfinite_summary(df: DataFrame, values: str) -> DataFrame:
    """For each row's array: its size, the share of finite values and the greatest finite absolute value."""
    ok = F.filter(values, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select("id", F.size(values).alias("size"), (F.size(ok) / F.size(values)).alias("finite_fraction"), F.array_max(F.transform(ok, F.abs)).alias("max_finite"))
