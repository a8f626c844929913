"""Tree forces against all pairs, spanning trees and forests against Kruskal's."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearfield.operators import approximate, metric_cells, spanning, treeforces
from nearfield.operators import neighbours as nb


def _forces(p):
    d = p[:, None] - p[None]
    q = 1 / (1 + (d**2).sum(2))
    np.fill_diagonal(q, 0)
    return ((q * q)[:, :, None] * d).sum(1), q.sum(1)


@pytest.mark.parametrize("theta", [0.0, 0.5])
def test_tree_forces_like_all_pairs(spark, theta):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(size=(150, 2)), rng.normal(size=(150, 2)) * 0.05 + 3, np.full((20, 2), 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]})).union(spark.createDataFrame([(1000, None, 1.0), (1001, float("nan"), 1.0), (1002, 1.0, float("inf"))], "id long, x double, y double"))
    got = treeforces.tree_forces(df, theta).toPandas().sort_values("id")
    f, z = _forces(p)
    assert got["id"].tolist() == list(range(len(p)))
    gap = np.sqrt(((got[["fx", "fy"]].to_numpy() - f) ** 2).sum() / (f**2).sum())
    if theta:
        assert abs(got["z"].sum() / z.sum() - 1) < 0.01 and gap < 0.02  # 0.001 and 0.005
        assert got["asked"].sum() < 0.5 * len(p) ** 2
    else:
        assert np.allclose(got["z"], z, rtol=1e-12) and gap < 1e-12


def test_tree_forces_of_few_or_no_points(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    assert treeforces.tree_forces(none).count() == 0
    same = spark.createDataFrame([(k, 1.0, 2.0) for k in range(30)], "id long, x double, y double")
    assert {(r["fx"], r["fy"], r["z"]) for r in treeforces.tree_forces(same).collect()} == {(0.0, 0.0, 29.0)}


def _kruskal(edges):
    at, out = {}, set()

    def root(x):
        while at.setdefault(x, x) != x:
            at[x] = x = at[at[x]]
        return x

    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in edges if u != v and w == w):
        if root(u) != root(v):
            at[root(u)] = root(v)
            out.add((u, v, w))
    return out


def test_forest_like_kruskal(spark):
    rng = np.random.default_rng(3)
    edges = [(int(u), int(v), float(w)) for u, v, w in zip(rng.integers(0, 400, 900), rng.integers(0, 400, 900), rng.integers(0, 6, 900))]  # many ties, some parts
    edges += [(k, k + 1, 1.0) for k in range(1000, 1200)] + [(5, 5, 0.0), (1, 2, float("nan"))]
    got = {tuple(r) for r in spanning.least_forest(spark.createDataFrame(edges, "u long, v long, w double")).collect()}
    assert got == _kruskal(edges)
    assert spanning.least_forest(spark.createDataFrame([], "u long, v long, w double")).count() == 0


def test_tree_of_all_pairs_like_kruskal(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.normal(size=(120, 2)), 1)  # ties and equal places
    df = spark.createDataFrame([(k, [float(x), float(y)]) for k, (x, y) in enumerate(p)] + [(500, None), (501, [1.0, float("nan")])], "id long, v array<double>")
    got = spanning.least_tree(df).collect()
    want = _kruskal([(a, b, float(np.sqrt(((p[a] - p[b]) ** 2).sum()))) for a in range(120) for b in range(a + 1, 120)])
    assert {(r["u"], r["v"]) for r in got} == {(u, v) for u, v, _ in want}


def test_pivot_cells_like_the_block_join(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.normal(size=(80, 5)) * 0.1 + 10 * rng.normal(size=5) for _ in range(12)] + [np.zeros((40, 5))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(p)], "id long, v array<double>")
    rows, compared = metric_cells.nearest(df, df, 9, "v")
    want = nb.nearest(df, df, 9, "v")
    key = lambda d: sorted((r["src"], r["rank"], r["dst"], round(r["dist"], 9)) for r in d.collect())
    assert key(rows) == key(want)
    assert compared.first()["share"] < 0.25  # clusters are skipped
    few = df.where("id < 4")
    assert key(metric_cells.nearest(df.where("id < 30"), few, 9, "v")[0]) == key(nb.nearest(df.where("id < 30"), few, 9, "v"))
    assert metric_cells.nearest(df, df.limit(0), 3, "v")[0].count() == 0


def test_all_neighbour_joins_agree_on_rows_without_a_place_and_equal_points(spark):
    rows = [(k, [float(k % 5), 1.0]) for k in range(40)] + [(90, [float("nan"), 1.0]), (91, None), (92, [1.0, float("inf")]), (93, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    key = lambda d: sorted((r["src"], r["rank"], r["dst"], round(r["dist"], 9)) for r in d.select("src", "rank", "dst", "dist").collect())
    want = key(nb.knn(df, 9, "v"))
    assert {r[0] for r in want} == set(range(40)) and len(want) == 360
    assert key(metric_cells.knn(df, 9, "v")) == want
    assert key(approximate.knn(df, 9, "v", probes=50)) == want


def test_forces_of_all_pairs_make_no_table_of_pairs(spark, monkeypatch):
    """the walk listed every pair of points as a row of a settled table."""
    rng = np.random.default_rng(5)
    p = np.round(rng.normal(size=(1500, 2)), 2)  # some points share a place; several blocks
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]}))
    rows, settle = [], treeforces.settle
    monkeypatch.setattr(treeforces, "settle", lambda t, name: rows.append(settle(t, name)) or rows[-1])
    got = treeforces.tree_forces(df, 0.0).toPandas().sort_values("id")
    f, z = _forces(p)
    assert np.allclose(got[["fx", "fy"]], f, atol=1e-9) and np.allclose(got["z"], z, rtol=1e-12)
    assert (got["asked"] == len(np.unique(p, axis=0))).all()
    assert sum(t.count() for t in rows) <= len(p)


def test_places_are_dealt_over_all_cores(spark):
    """a few MB of places were one file, and one task did each level's walk of repulsion_tree."""
    df = spark.range(2000).select("id", F.cos("id").alias("x"), F.sin("id").alias("y"))
    places, _ = treeforces._placed(df)
    assert len(places.inputFiles()) >= spark.sparkContext.defaultParallelism and places.count() == 2000


def test_pivot_cells_send_no_row_for_each_cell(spark, monkeypatch):
    """where few cells can be left out, a copy of each query went to nearly all of them, which filled the disk."""
    rng = np.random.default_rng(14)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "v": np.round(rng.normal(size=(3000, 12)), 1).tolist()}))
    sizes, settle = {}, metric_cells.settle
    monkeypatch.setattr(metric_cells, "settle", lambda t, name: sizes.setdefault(name, settle(t, name)))
    rows, compared = metric_cells.nearest(df, df, 9, "v")
    assert compared.first()["share"] > 0.5 and sizes["rest"].count() <= 3000 * 10
    key = lambda t: sorted(tuple(r) for r in t.collect())
    assert key(rows) == key(nb.nearest(df, df, 9, "v"))
