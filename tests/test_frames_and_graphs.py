"""Sources of tables, cached and approximate neighbours, and graph operators against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearfield.functions import ranks
from nearfield.operators import approximate, fidelity, graph, lineage
from nearfield.operators import neighbours as nb
from nearfield.operators import sampling as sm
from nearfield.operators.points import points
from nearfield.plans import objective_plans, summary_plans
from nearfield.sources import frames, sinks


def test_csv_union_and_matrix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,label,subject\n1,b,9\n2,a,9\n")
    (tmp_path / "b.csv").write_text("label,x,subject\nc,3,9\n")
    got = frames.csv_union(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ("subject",))
    assert sorted(map(tuple, got.select("x", "label").collect())) == [(1, "b"), (2, "a"), (3, "c")]
    (tmp_path / "m.txt").write_text(" 1  2.5\t-3\n\n4 5 6\n")
    assert [r["features"] for r in frames.text_matrix(spark, str(tmp_path / "m.txt")).collect()] == [[1.0, 2.5, -3.0], [4.0, 5.0, 6.0]]


def test_shapes_sides_and_columns(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], ["p", "q"], "0.5", "x")], "id long, im array<array<double>>, labels array<string>, fate_A string, fate_B string")
    flat = frames.flattened(df, "im")
    assert flat.first()["im"] == [1.0, 2.0, 3.0, 4.0] and frames.reshaped(flat, "im", 2).first()["im"] == df.first()["im"]
    with pytest.raises(PySparkException):
        frames.reshaped(flat, "im", 3).collect()
    assert tuple(frames.prefix_columns(df, "fate_", "id").first()) == (1, 0.5, None)
    assert frames.first_label(df, "labels").first()["labels"] == "p" and frames.first_label(df, "fate_A").first()["fate_A"] == "0.5"
    assert "copy" in frames.add_if_present(df, "id", "copy").columns and "copy" not in frames.add_if_present(df, "none", "copy").columns
    assert frames.annotations(df, "id").first()["leiden"] == "1"
    side = spark.createDataFrame([(1, 0.25)], "id long, density double")
    assert frames.with_side(df, side, "id", "density").first()["density"] == 0.25
    assert frames.with_side(df, side.union(side), "id", "density").first()["density"] is None
    assert frames.with_aliases(spark.createDataFrame([(0.5,)], "trustworthiness double")).first()["trust"] == 0.5


def test_epochs_and_consolidated(spark, tmp_path):
    df = spark.createDataFrame([(k, [[k * 1.0, 0.0], [0.0, k * 1.0]], "l") for k in range(3)], "id long, layers array<array<double>>, label string")
    stacked = sinks.stacked(df, "layers", "m")
    with pytest.raises(ValueError):
        sinks.write_epoch(stacked, str(tmp_path / "e"), 1, 4)
    sinks.write_epoch(stacked, str(tmp_path / "e"), 1, 3)
    assert spark.read.csv(str(tmp_path / "e"), header=True).count() == 6
    sinks.write_consolidated(df, "layers", "label", str(tmp_path / "c"), "m", "d")
    assert spark.read.parquet(str(tmp_path / "c")).where("num_layers = 2 and layer_1[1] = cast(cell_id as double)").count() == 3
    stacked.select("cell_id", "method", "layer", "x", "y").coalesce(1).write.csv(str(tmp_path / "s"), header=True)
    assert frames.embeddings(spark, str(tmp_path / "s"), "other", 1).where("method = 'other' and file <> ''").count() == 3


def test_cached_neighbours_follow_the_content(spark, sf_dir, tmp_path, monkeypatch):
    pts = points(spark, sf_dir)
    first = sorted(map(tuple, frames.cached_knn(pts, 3, "hd", str(tmp_path), "t").collect()))
    monkeypatch.setattr(frames.nb, "knn", lambda *a: pytest.fail("worked out again"))
    assert sorted(map(tuple, frames.cached_knn(pts, 3, "hd", str(tmp_path), "t").collect())) == first
    monkeypatch.undo()
    assert frames.cached_knn(pts.where("id <> 1"), 3, "hd", str(tmp_path), "t").count() == len(first) - 3


def test_approximate_neighbours(spark, sf_dir, monkeypatch):
    pts = points(spark, sf_dir)
    exact = nb.knn(pts, 10, "hd")
    assert approximate.recall(approximate.knn(pts, 10, "hd"), exact).first()["recall"] >= 0.9
    every = approximate.knn(pts, 10, "hd", centres=5, probes=5)
    key = lambda df: sorted((r["src"], r["rank"], r["dst"], round(r["dist"], 9)) for r in df.collect())
    assert key(every) == key(exact)
    monkeypatch.setattr(nb, "MOST", 20)  # crowded cells are dealt into parts
    assert key(approximate.knn(pts, 10, "hd", centres=2, probes=2)) == key(exact)
    assert approximate.nearest(pts, pts.limit(0), 3, "hd").count() == 0


def test_nearest_is_exact_where_rounding_could_lose(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1, 8)) * 1e4 + rng.normal(size=(300, 8)) * 1e-4  # far from 0 and close together
    rows = np.concatenate([base, base[:40]])  # and ties
    order, dist = nb._nearest_rows(rows, rows, 12, None)
    d = nb._distances(rows, rows)
    want = np.lexsort((d,), axis=1)[:, :12]
    assert (order == want).all() and np.allclose(dist, np.take_along_axis(d, want, 1))


def test_spearman_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 40, 500).astype(float), rng.normal(size=500)
    df = spark.createDataFrame([(float(x), float(y + x / 20)) for x, y in zip(a, b)], "a double, b double")
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    want = np.corrcoef(rank(a), rank(b + a / 20))[0, 1]
    assert abs(ranks.spearman(df, "a", "b", "r").first()["r"] - want) < 1e-12
    monkeypatch.setattr(ranks, "RANGE_ROWS", 30)
    assert abs(ranks.spearman(df, "a", "b", "r").first()["r"] - want) < 1e-12


def test_positions_of_large_ids(spark):
    ids = [2**53 + k for k in (1, 2, 3, 7)]
    got = {r["id"]: r["pos"] for r in sm.with_position(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()}
    assert got == {i: k for k, i in enumerate(ids)}


def test_paths_longer_than_any_fixed_number_of_rounds(spark):
    n = 260
    edges = [(k, k + 1, 1.0 + k % 3) for k in range(n)]
    df = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src long, dst long, w double")
    got = {r["node"]: r["dist"] for r in graph.shortest_paths(df, spark.createDataFrame([(k,) for k in (0, n)], "node long")).where("source = 0").collect()}
    want = dict(zip(range(n + 1), itertools.accumulate([0.0] + [w for *_, w in edges])))
    assert got == want


def test_spanning_tree_like_brute_force(spark):
    rng = np.random.default_rng(7)
    xy = rng.normal(size=(12, 2))
    nodes = spark.createDataFrame([(f"n{k:02d}", float(x), float(y)) for k, (x, y) in enumerate(xy)], "node string, x double, y double")
    got = {(r["u"], r["v"]) for r in graph.spanning_tree(nodes).collect()}
    lab, want = list(range(12)), set()
    for _, a, b in sorted((float(np.hypot(*(xy[a] - xy[b]))), a, b) for a in range(12) for b in range(a + 1, 12)):  # Kruskal
        if lab[a] != lab[b]:
            want.add((f"n{a:02d}", f"n{b:02d}"))
            lab = [lab[a] if x == lab[b] else x for x in lab]
    assert got == want


def test_geodesics_like_brute_force(spark, sf_dir):
    pts = points(spark, sf_dir).limit(60).cache()
    edges = nb.symmetric_graph(nb.knn(pts, 6, "hd"))
    rows = edges.collect()
    ids = sorted(r["id"] for r in pts.collect())
    at = {i: k for k, i in enumerate(ids)}
    d = np.full((len(ids), len(ids)), np.inf)
    np.fill_diagonal(d, 0)
    for r in rows:
        d[at[r["src"]], at[r["dst"]]] = r["w"]
    for k in range(len(ids)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    got = {(r["source"], r["node"]): r["dist"] for r in graph.shortest_paths(edges, pts.select(F.col("id").alias("node"))).collect()}
    assert set(got) == {(a, b) for a in ids for b in ids if np.isfinite(d[at[a], at[b]])}
    assert all(abs(v - d[at[a], at[b]]) < 1e-9 for (a, b), v in got.items())
    roots = {r["node"]: r["dist"] for r in graph.distance_from_roots(edges, spark.createDataFrame([(ids[0],), (ids[5],)], "node long")).collect()}
    assert all(abs(v - min(d[at[ids[0]], at[k]], d[at[ids[5]], at[k]])) < 1e-9 for k, v in roots.items())


def test_perplexity_like_brute_force(spark, sf_dir):
    near = nb.knn(points(spark, sf_dir).limit(80), 15, "hd")
    rows = graph.perplexity_affinity(near, 6.0).toPandas()
    for _, g in rows.groupby("src"):
        assert abs(g.p.sum() - 1) < 1e-9
        assert abs(-(g.p * np.log(g.p)).sum() - np.log(6.0)) < 1e-4
        x = g.sort_values("d2")
        slope = np.log(x.p.iloc[0] / x.p.iloc[-1]) / (x.d2.iloc[-1] - x.d2.iloc[0])
        assert np.allclose(np.log(x.p / x.p.iloc[0]), -slope * (x.d2 - x.d2.iloc[0]), atol=1e-9)  # a Gaussian's shares


def test_principal_coordinates_like_brute_force(spark, sf_dir):
    x = np.array([r["hd"] for r in points(spark, sf_dir).orderBy("id").collect()])
    x = x - x.mean(0)
    values, vectors = np.linalg.eigh(x.T @ x)
    want = x @ vectors[:, ::-1][:, :2]
    got = np.array([[r["x"], r["y"]] for r in objective_plans.pca_embedding(spark, sf_dir).orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_class_spread_like_brute_force(spark, sf_dir):
    pts = points(spark, sf_dir)
    row = lineage.class_spread_recovery(pts, "label").first()
    assert -1 <= row["asr"] <= 1 and -1 <= row["asr_mpd"] <= 1
    rows = pts.toPandas()
    mean = lambda a: np.mean([np.linalg.norm(p - q) for p, q in itertools.combinations(a, 2)])
    hd, ld = zip(*[(mean(np.stack(g.hd)), mean(np.stack(g.ld))) for _, g in rows.groupby("label")])
    rank = lambda v: np.argsort(np.argsort(v))
    assert abs(row["asr_mpd"] - np.corrcoef(rank(hd), rank(ld))[0, 1]) < 1e-9


def test_summary_agrees_with_its_metrics(spark, sf_dir):
    pts = points(spark, sf_dir)
    row = fidelity.summary(pts).first()
    assert abs(row["trustworthiness"] - fidelity.trustworthiness(pts, 12).first()[0]) < 1e-12
    assert abs(row["continuity"] - fidelity.continuity(pts, 12).first()[0]) < 1e-12
    assert abs(row["density_correlation"] - fidelity.density_correlation(nb.knn(pts, 15, "hd"), nb.knn(pts, 15, "ld")).first()[0]) < 1e-12


def test_time_ordering_like_brute_force(spark, sf_dir):
    got = summary_plans.time_ordering(spark, sf_dir).first()
    assert all(0 <= v <= 1 for v in got)


def test_landmark_paths_like_shortest_paths_and_in_little_space(spark, monkeypatch):
    """every round settled a row for each landmark and node, and kept the tables of all rounds."""
    import numpy as np

    from nearfield.functions import tables
    from nearfield.operators import graph

    rng = np.random.default_rng(11)
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 90, 400), rng.integers(0, 90, 400), 1 + rng.random(400))]
    pairs += [(400, 401, 0.5), (3, 3, 0.0), (1, 2, float("nan"))]  # a part of its own, and what is no edge
    edges = spark.createDataFrame(pairs + [(b, a, w) for a, b, w in pairs], "src long, dst long, w double")
    landmarks = spark.createDataFrame([(k,) for k in range(0, 90, 4)] + [(400,), (999,)], "node long")
    monkeypatch.setattr(graph, "NODES", 50)  # several blocks, rows and sets
    monkeypatch.setattr(graph, "SOURCES", 16)
    monkeypatch.setattr(graph, "CELLS", 1600)
    names, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda t, name: names.append(settle(t, name)) or names[-1])
    got = {tuple(r) for r in graph.landmark_paths(edges, landmarks).collect()}
    made = [t.inputFiles()[0] for t in names]
    monkeypatch.undo()
    want = {tuple(r) for r in graph.shortest_paths(edges, landmarks).join(landmarks, "node", "left_semi").select("source", "node", "dist").collect()}
    assert got == want and len(got) > 300
    import os

    left = [f for f in made if os.path.exists(f.removeprefix("file://"))]
    assert all("landmark-paths" in f for f in left) and tables.shared_folder(spark) in left[0]


def test_landmarks_that_meet_half_way(spark, monkeypatch):
    """each landmark searched the whole graph; on one of one piece none does now, and the lengths are the same."""
    import numpy as np

    from nearfield.operators import graph

    rng = np.random.default_rng(13)
    p = rng.random((400, 8))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    pairs = {(min(a, b), max(a, b)) for a in range(400) for b in map(int, np.argsort(d[a])[1:11])}
    edges = spark.createDataFrame([(x, y, float(d[a, b])) for a, b in pairs for x, y in ((a, b), (b, a))], "src long, dst long, w double")
    landmarks = spark.createDataFrame([(k,) for k in range(0, 400, 9)], "node long")
    monkeypatch.setattr(graph, "_landmark_set", lambda *a: 1 / 0)
    got = {(r[0], r[1]): r[2] for r in graph.landmark_paths(edges, landmarks).collect()}
    want = {(r[0], r[1]): r[2] for r in graph.shortest_paths(edges, landmarks).join(landmarks, "node", "left_semi").select("source", "node", "dist").collect()}
    assert got.keys() == want.keys() and len(got) == 45 * 45 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
