"""Operators against literal cases and brute force."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import parse
from nearfield.functions.ranks import average_rank, spearman
from nearfield.operators import augment, fidelity, graph, health, lineage, neighbours, objective, prep, sampling


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4))
    return x, spark.createDataFrame([(i, r.tolist(), r[:2].tolist(), int(i % 3)) for i, r in enumerate(x)], "id long, hd array<double>, ld array<double>, label int")


def test_knn_is_exact_over_several_blocks(cloud, monkeypatch):
    x, df = cloud
    monkeypatch.setattr(neighbours, "BLOCK", 13)
    got = {(r["src"], r["rank"]): r["dst"] for r in neighbours.knn(df, 5, "hd").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (d[i, j], j))
        assert [got[i, k] for k in range(1, 6)] == order[1:6]


def test_identity_picture_is_perfect(cloud):
    _, df = cloud
    same = df.withColumn("ld", F.col("hd"))
    hd, ld = neighbours.knn(same, 6, "hd"), neighbours.knn(same, 6, "ld")
    assert fidelity.knn_preservation(hd, ld, 60, 6).first()[0] == 1.0
    assert fidelity.trustworthiness(same, 6).first()[0] == 1.0
    assert fidelity.continuity(same, 6).first()[0] == 1.0
    assert fidelity.density_correlation(hd, ld).first()[0] == pytest.approx(1.0)
    assert fidelity.neighborhood_distortion(hd, ld).first()[0] == pytest.approx(0.0, abs=1e-6)


def test_average_rank_and_spearman_with_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0)], "id int, v double")
    assert {r["id"]: r["k"] for r in average_rank(df, "v", "k").collect()} == {3: 1.0, 1: 2.5, 2: 2.5, 4: 4.0}
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert spearman(flat, "a", "b", "r").first()[0] == 0.0


def test_shortest_paths_like_a_heap(cloud):
    x, df = cloud
    edges = neighbours.symmetric_graph(neighbours.knn(df, 4, "hd"))
    got = {(r["source"], r["node"]): r["dist"] for r in graph.shortest_paths(edges, df.where("id < 3").select(F.col("id").alias("node"))).collect()}
    out = {}
    for r in edges.collect():
        out.setdefault(r["src"], []).append((r["dst"], r["w"]))
    for s in range(3):
        best, heap = {}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in best:
                continue
            best[u] = d
            for v, w in out.get(u, []):
                heapq.heappush(heap, (d + w, v))
        assert {n: pytest.approx(d) for n, d in best.items()} == {n: d for (q, n), d in got.items() if q == s}


def test_health_flags(spark):
    rng = np.random.default_rng(42)
    frame = lambda a: spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(a)], "id long, x double, y double")
    cloud = health.embedding_health(frame(rng.standard_normal((500, 2)))).first()
    assert (cloud["collapsed"], cloud["near_line"]) == (0.0, 0.0) and cloud["axis_ratio"] > 0.5
    line = health.embedding_health(frame([(k, 0.0) for k in range(100)])).first()
    assert line["collapsed"] == 1.0
    holes = health.embedding_health(frame([(float(k), float("nan") if k == 5 else float(k * k)) for k in range(100)])).first()
    assert holes["nonfinite_fraction"] > 0 and holes["collapsed"] == 1.0
    t = np.linspace(-1, 1, 1000)
    near = health.embedding_health(frame(np.column_stack([t, t + rng.normal(0, 0.02, 1000)]))).first()
    assert (near["near_line"], near["collapsed"]) == (1.0, 0.0)


def test_loss_stability_literals(spark):
    rows = [("a", k, v) for k, v in enumerate([1.0, 0.9, 0.8, 0.7, 0.6])] + [("b", k, v) for k, v in enumerate([1.0, 2.0, 0.5, 2.5, 0.4, 3.0])]
    got = {r["name"]: r for r in health.loss_stability(spark.createDataFrame(rows, "name string, epoch int, value double")).collect()}
    assert not got["a"]["oscillation_detected"] and got["a"]["direction_change_rate"] == 0
    assert got["b"]["oscillation_detected"] and got["b"]["direction_change_rate"] > 0.5


def test_steady_mean_literal(spark):
    rows = [("runtime_latent_hcl_n5000_seed44", k, s) for k, s in enumerate([3.0, 2.0, 1.0, 1.0, 1.0, 0.5, 0.7])]
    df = spark.createDataFrame(rows, "run string, epoch int, seconds double")
    assert health.epoch_times(df).first()["steady_seconds"] == pytest.approx(0.6)
    named = df.select(*[c.alias(n) for n, c in parse.run_name(F.col("run")).items()]).first()
    assert (named["method"], named["data"], named["seed"]) == ("latent", "hcl", "44")


def test_nonfinite_summary_literal(spark):
    row = health.nonfinite_summary(spark.createDataFrame([(1, [1.0, float("inf"), float("nan")])], "id int, v array<double>"), "v").first()
    assert (row["size"], row["finite_fraction"], row["max_finite"]) == (3, pytest.approx(1 / 3), 1.0)


def test_row_normalisation_literal(spark):
    m = [[1.0, 0.2, 0.3], [0.1, 0.9, 0.4], [0.5, 0.6, 0.8]]
    df = spark.createDataFrame([(0, i, j, m[i][j]) for i in range(3) for j in range(3)], "batch int, i int, j int, p double")
    got = {(r["i"], r["j"]): r["p"] for r in objective.row_normalised(df, "p").collect()}
    assert [got[k, k] for k in range(3)] == [1.0, 0.9, 0.8]
    assert all(sum(got[i, j] for j in range(3) if i != j) == pytest.approx(1) for i in range(3))


def test_affinity_needs_positive_freedom_and_known_names(spark, cloud):
    _, df = cloud
    a = df.select(F.lit(0).alias("batch"), "id", F.col("hd").alias("h"), F.col("ld").alias("l"))
    with pytest.raises(ValueError):
        objective.manifold_loss(a, a, nu=0)
    with pytest.raises(ValueError):
        objective.manifold_loss(a, a, row_normalise=True)
    with pytest.raises(KeyError):
        augment.apply(["none"], df, neighbours.knn(df, 3, "hd"))


def test_time_bins(spark):
    df = spark.createDataFrame([("100-130",), ("<100",), (">650",), ("42",)], "t string")
    assert [r[0] for r in df.select(parse.time_bin(F.col("t"))).collect()] == [130.0, 50.0, 750.0, 42.0]


def test_hull_area_of_square_and_line(spark):
    square = [("s", k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0)])]
    line = [("l", k, float(k), float(k)) for k in range(6)]
    df = spark.createDataFrame(square + line, "g string, id long, x double, y double")
    got = {r["g"]: r["area"] for r in lineage.hull_areas(df, "g", 1.0).collect()}
    assert got["s"] == pytest.approx(4.0) and got["l"] == pytest.approx(0.0)


def test_perplexity_is_met(cloud):
    _, df = cloud
    rows = graph.perplexity_affinity(neighbours.knn(df, 20, "hd"), 7.0).toPandas()
    for _, g in rows.groupby("src"):
        assert math.exp(-(g.p * np.log(g.p)).sum()) == pytest.approx(7.0, rel=1e-3)


def test_samples(spark, cloud):
    _, df = cloud
    assert sampling.subsample(df, "id", None).count() == 60
    assert sampling.subsample(df, "id", 7).count() == 7
    assert {r["label"]: r["count"] for r in sampling.stratified(df, "id", "label", 10).groupBy("label").count().collect()} == {0: 4, 1: 3, 2: 3}
    got = sampling.batches(df, "id", 16).groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in got) == [(0, 16), (1, 16), (2, 16)]


def test_prep_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [1.0, 7.0])], "id int, features array<double>")
    assert [r[0] for r in prep.min_max(df, "features").orderBy("id").select("features").collect()] == [[0.0, 0.0], [0.0, 1.0]]
    with pytest.raises(KeyError):
        prep.resolve_column(df, ["x", "y"])
    with pytest.raises(ValueError):
        prep.zip_rows(df.withColumn("pos", F.lit(0)), df.limit(1).withColumn("pos", F.lit(0)))
    with pytest.raises(Exception, match="finite"):
        prep.require_finite(spark.createDataFrame([(1, [float("nan")])], "id int, features array<double>"), "features").collect()


def test_svc_tells_apart_two_clouds(spark):
    from nearfield.operators import classify

    rng = np.random.default_rng(1)
    rows = [(k, (rng.standard_normal(2) * 0.2 + (0 if k % 2 else 5)).tolist(), k % 2) for k in range(24)] + [(99, [0.0, 0.0], 7)]
    df = spark.createDataFrame(rows, "id long, ld array<double>, label int")
    assert classify.svc_accuracy(df, "ld", "label", 2, steps=5).first()[0] == 1.0
    assert math.isnan(classify.svc_accuracy(df.where("label <> 1"), "ld", "label").first()[0])


def test_mean_pairwise_takes_every_pair(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1303, 2)) * np.linspace(0.1, 5, 1303)[:, None]
    rows = [(i, r.tolist(), 0 if i < 1300 else None if i < 1302 else 2) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, ld array<double>, label int")
    got = {r["label"]: r["spread"] for r in lineage.mean_pairwise(df, "label", "ld").collect()}
    d = np.sqrt(((x[:1300, None] - x[None, :1300]) ** 2).sum(-1))
    assert got == {0: pytest.approx(d.sum() / (1300 * 1299)), None: pytest.approx(float(np.linalg.norm(x[1300] - x[1301]))), 2: 0.0}


def test_ranks_within_a_key(spark):
    from nearfield.functions.ranks import average_rank_within

    rng = np.random.default_rng(9)
    rows = [(str(k % 2), float(v)) for k, v in enumerate(rng.integers(0, 90, 400) * (1 + np.arange(400) % 2 * 50))]
    got = average_rank_within(spark.createDataFrame(rows, "b string, v double"), "b", "v", "k").collect()
    assert len(got) == 400
    for r in got:
        own = [v for b, v in rows if b == r["b"]]
        assert r["k"] == sum(v < r["v"] for v in own) + (sum(v == r["v"] for v in own) + 1) / 2


def test_shortest_paths_are_never_cut(spark):
    import inspect

    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(6)], "src long, dst long, w double")
    start = spark.createDataFrame([(0,)], "node long")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(edges, start, most_rounds=3)
    assert inspect.signature(graph.shortest_paths).parameters["most_rounds"].default is None
    assert {r["node"]: r["dist"] for r in graph.shortest_paths(edges, start).collect()} == {k: float(k) for k in range(7)}


def test_summary_has_all_eleven_metrics(cloud):
    _, df = cloud
    assert {"shepard", "triplet_accuracy", "msdp_auc"} < set(fidelity.summary(df).columns) and len(fidelity.summary(df).columns) == 11
    same = df.withColumn("ld", F.col("hd"))
    assert fidelity.shepard(same).first()[0] == pytest.approx(1.0) and fidelity.triplet_accuracy(same).first()[0] == 1.0
