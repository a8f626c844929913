"""Block joins by products of matrices against plain differences, and how their work is dealt."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.operators import neighbours as nb


def _points(kind, n, width):
    rng = np.random.default_rng(7)
    if kind == "far":  # squares of the numbers hide the distances
        return 1e6 + rng.normal(size=(n, width))
    if kind == "grid":  # many equal distances and equal points
        return rng.integers(0, 3, (n, width)).astype(float)
    return rng.normal(size=(n, width))


@pytest.mark.parametrize("kind", ["plain", "far", "grid"])
@pytest.mark.parametrize("width", [2, 24])
def test_kernels_like_differences(kind, width):
    b = _points(kind, 900, width)
    a, ids, norms = b[:60], np.arange(900), (b * b).sum(1)
    diff = a[:, None] - b[None]
    d = nb._lengths(diff)
    assert np.allclose(d, np.sqrt((diff**2).sum(2)), rtol=1e-14) and (nb._distances(a, b) == d).all()
    order = np.argsort(d, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    for radius in (np.median(d), d[3, 77]):
        assert (nb._within(a, b, norms, radius) == (d <= radius).sum(1)).all()
    assert np.allclose(nb._measured(a, b, norms), d, rtol=1e-9, atol=0)
    for k in (1, 12, 300):
        at, dist = nb._nearest_rows(a, b, k, None)
        assert (at == order[:, :k]).all() and (dist == np.take_along_axis(d, at, 1)).all()
    own = (ids % 5)[:60, None] == (ids % 5)[None]
    at, _ = nb._nearest_rows(a, b, 15, own)
    assert (at == np.argsort(np.where(own, np.inf, d), axis=1, kind="stable")[:, :15]).all()
    some = nb._sure(a, b, norms)
    far, slack = some or (d, 0.0)
    to = np.random.default_rng(8).integers(0, 900, (60, 7))
    for k in range(60):
        assert (nb._before(far[k], d[k, to[k]], to[k], ids, a[k] if some else None, b, slack) == rank[k, to[k]]).all()


def test_wide_distances_take_little_time():
    """differences of 64 numbers a pair took about 120 ns a pair."""
    b = np.random.default_rng(9).normal(size=(8000, 64))
    norms, took = (b * b).sum(1), []
    for f in (lambda: nb._distances(b[:100], b), lambda: nb._within(b[:100], b, norms, 10.0), lambda: nb._measured(b[:100], b, norms)):
        f()
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    assert took[1] < took[0] / 2 and took[2] < took[0] / 2, took


def test_pairs_of_blocks_are_dealt_into_many_tasks(spark):
    """F5 to F22: adaptive execution merged the small partitions of all pairs of blocks, and few tasks did the work."""
    p = np.random.default_rng(10).normal(size=(6000, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(p)), "v": p.tolist()}))
    got = nb.radius_counts(df, df, 0.5, "v")
    tasks = nb._in_blocks(df, df, lambda q, r: pd.DataFrame({"n": [len(q)]}), "n long", True).rdd.getNumPartitions()
    assert tasks >= 25 and got.count() == 6000


def test_pairs_of_blocks_are_dealt_evenly(spark):
    """hashes of the blocks' numbers put several pairs of blocks into one task and none into others."""
    df = spark.range(6000).select("id", F.array(F.col("id").cast("double")).alias("v"))
    got = nb._in_blocks(df, df.where("id < 3000"), lambda q, r: pd.DataFrame({"n": [len(q) * len(r)]}), "n long").withColumn("task", F.spark_partition_id()).toPandas()
    assert len(got) == 18 and got["task"].nunique() == 18 and got["n"].sum() == 6000 * 3000


def test_shifted_density_joins_neighbours_once(spark, sf_dir, monkeypatch):
    """shifted_density_correlation asked for the same neighbours twice."""
    from nearfield.plans import training_plans

    asked, knn = [], nb.knn
    monkeypatch.setattr(nb, "knn", lambda *a: asked.append(a) or knn(*a))
    assert training_plans.shifted_density_correlation(spark, sf_dir).columns == ["rho"] and len(asked) == 1


@pytest.mark.parametrize("kind", ["plain", "far", "grid", "tiny", "huge"])
@pytest.mark.parametrize("width", [1, 2, 24])
def test_best_rows_of_references_that_stream_past(kind, width):
    """F3 to F9: rows of all references in batches, and ranks by single precision, are those of a stable sort of exact distances."""
    b = _points("plain" if kind in ("tiny", "huge") else kind, 900, width) * {"tiny": 1e-22, "huge": 1e25}.get(kind, 1.0)
    a, ids = b[:60], np.arange(900)
    d = nb._lengths(a[:, None] - b[None])
    order = np.argsort(d, axis=1, kind="stable")
    for k, step in ((1, 7), (13, 100), (13, 900), (300, 250), (1000, 400)):
        best = nb._Best(a, k)
        for at in range(0, 900, step):
            best.add(ids[at : at + step], b[at : at + step])
        got = pd.concat([x.to_pandas() for x in best.rows(ids[:60])])
        m = min(k, 900)
        assert (got["dst"].to_numpy().reshape(60, m) == order[:, :m]).all() and (got["rank"].to_numpy().reshape(60, m) == np.arange(m)).all()
        assert (got["dist"].to_numpy().reshape(60, m) == np.take_along_axis(d, order[:, :m], 1)).all()
    rank, to = np.argsort(order, axis=1, kind="stable"), np.random.default_rng(8).integers(0, 900, (60, 7))
    for s, far, slack in nb._Single(a).against(b):
        for k in range(s.start, s.stop):
            sure = not np.isnan(slack[k - s.start])
            assert sure == (kind != "huge")
            if sure and k == s.start:
                own = np.take_along_axis(d[s], to[s], 1)
                assert (nb._counted(far, slack, own, to[s], a[s], ids, b) == np.take_along_axis(rank[s], to[s], 1)).all()
            assert (nb._before(far[k - s.start], d[k, to[k]], to[k], ids, a[k] if sure else None, b, 0.5 * slack[k - s.start] if sure else 0.0) == rank[k, to[k]]).all()


def test_nearest_rows_come_once_a_query(spark, monkeypatch):
    """each block of references answered with k rows for each query, which filled the disk; now in sets, and by parts, too."""
    p = np.random.default_rng(12).integers(0, 9, (6000, 3)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(p))[::-1], "v": p.tolist()}))
    want = [tuple(r) for r in nb.nearest(df, df, 20, "v").orderBy("src", "rank").collect()]
    d = nb._distances(p[::-1][:50], p[::-1])
    assert [r[2] for r in want[:1000]] == np.argsort(d, axis=1, kind="stable")[:, :20].ravel().tolist() and len(want) == 120_000
    rows, parts = nb._past(df, df, lambda block, refs: (yield pa.RecordBatch.from_pydict({"n": [len(block) * sum(len(i) for i, _ in refs)]})), "n long", True)
    assert parts == 1 and rows.count() >= 4 and rows.groupBy().sum("n").first()[0] == 6000 * 6000
    pairs = df.select(F.col("id").alias("src"), (F.col("id") * 7 % 6000).alias("dst"))
    ranks = sorted(tuple(r) for r in nb.pair_ranks(pairs, df, "v").collect())
    full = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
    assert ranks[:50] == [(k, k * 7 % 6000, full[k, k * 7 % 6000]) for k in range(50)]
    monkeypatch.setattr(nb, "COPIES", 1)
    monkeypatch.setattr(nb, "STREAM", 2500)
    monkeypatch.setattr(nb, "MOST", 700)
    assert [tuple(r) for r in nb.nearest(df, df, 20, "v").orderBy("src", "rank").collect()] == want
    assert sorted(tuple(r) for r in nb.pair_ranks(pairs, df, "v").collect()) == ranks


@pytest.mark.parametrize("name", ["spir", "ordinal_percentile_distortion", "neighborhood_distortion"])
def test_neighbours_are_joined_once(spark, sf_dir, monkeypatch, name):
    """what reads the neighbours several times joined them each time."""
    from nearfield.plans import neighbour_plans

    met, past = spark.sparkContext.accumulator(0), nb._past

    def counting(queries, refs, run, *rest):
        def also(block, rows):
            met.add(len(block))
            return run(block, rows)

        return past(queries, refs, also, *rest)

    monkeypatch.setattr(nb, "_past", counting)
    getattr(neighbour_plans, name)(spark, sf_dir).collect()
    assert met.value == 2 * neighbour_plans.points(spark, sf_dir).count()
