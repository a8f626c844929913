"""Exact quantiles by ranges against Spark's own."""

import random

import pytest
from pyspark.sql import functions as F

from nearfield.functions import ranks


@pytest.mark.parametrize("rows", [50_000, 40])
def test_exact_quantiles(spark, rows, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
    rng = random.Random(5)
    data = [(rng.choice("aaab"), rng.choice([float(rng.randint(0, 9)), rng.gauss(0, 1)])) for _ in range(900)] + [("c", 2.5), ("d", None), (None, 1.0)]
    df = spark.createDataFrame(data, "k string, v double")
    for share in (0.0, 0.5, 0.9, 1.0):
        want = {r["k"]: r["q"] for r in df.where("k is not null and v is not null").groupBy("k").agg(F.percentile("v", share).alias("q")).collect()}
        got = {r["k"]: r["q"] for r in ranks.exact_quantile(df, "v", share, "q", "k").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        whole = ranks.exact_quantile(df, "v", share, "q").collect()
        assert len(whole) == 1 and abs(whole[0]["q"] - df.agg(F.percentile("v", share)).first()[0]) < 1e-12
    assert ranks.exact_quantile(df.limit(0), "v", 0.5, "q").collect()[0]["q"] is None
    assert ranks.exact_quantile(df.limit(0), "v", 0.5, "q", "k").count() == 0


def test_only_values_about_the_quantile_are_ranked(spark):
    """each of the distinct values was compared with all bounds of ranges, hundreds at size, before any was ranked."""
    df = spark.range(40_000).select(F.sqrt("id").alias("v"))
    got = ranks.exact_quantile(df, "v", 0.5, "q")
    assert got.first()["q"] == pytest.approx((19_999**0.5 + 20_000**0.5) / 2, rel=1e-15)
    cuts = [float(c) for c in range(0, 3000, 3)]
    at = ranks.range_of(F.array(*[F.lit(c) for c in cuts]), F.col("v"), len(cuts))
    few = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (3.0,), (1499.0,), (2997.0,), (9999.0,)], "v double")
    assert [r["k"] for r in few.select("v", at.alias("k")).collect()] == [sum(c < v for c in cuts) for v in (-1.0, 0.0, 0.5, 3.0, 1499.0, 2997.0, 9999.0)]
