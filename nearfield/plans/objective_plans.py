"""Registered queries of pairwise objectives, graphs, augmentation and schedules, with their DuckDB counterparts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import augment, graph, lineage
from ..operators import neighbours as nb
from ..operators import objective as ob
from ..operators import sampling as sm
from ..operators.points import lineage_cells, points, read
from .health_plans import _INC, CELLS, series, xy
from .register import registry

QUERIES, ORACLES, query = registry()

#: Rows of a batch; all full batches are judged, the short last one is dropped as in training.
BATCH = 64
VIEW = f"p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS h, (embedding::DOUBLE[])[1:2] AS l, label FROM embeddings), o AS (SELECT *, (row_number() OVER (ORDER BY md5(id::VARCHAR || ':42'), id) - 1) // {BATCH} AS batch, count(*) OVER () // {BATCH} AS fullones FROM p), v AS (SELECT * FROM o WHERE batch < fullones)"
SECOND = "w AS (SELECT batch, id, list_transform(h, lambda z: z * 0.9) AS h, list_transform(l, lambda z: z * 0.9) AS l FROM v)"
PAIRS = f"{VIEW}, {SECOND}, r AS (SELECT v.batch, v.id AS i, w.id AS j, CASE WHEN v.id = w.id THEN 0 ELSE greatest(list_distance(v.h, w.h) ** 2, 1e-12) END AS d2, list_distance(v.l, w.l) AS d FROM v JOIN w ON v.batch = w.batch)"
_ROW = "OVER (PARTITION BY batch, i)"
Q01 = f"q AS (SELECT *, k / greatest(sum(CASE WHEN i <> j THEN k ELSE 0 END) {_ROW}, 1.1754943508222875e-38) AS q FROM (SELECT *, pow(1 + (d + 1e-9) ** 2 / 0.1, -0.55) AS k FROM r))"
LOSS = "-(p * ln(q + 1e-8) + (1 - p) * ln(1 - CASE WHEN i <> j THEN least(greatest(q, 0), 1) ELSE 0 END + 1e-8))"


def views(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Batches of points, and a second view of them drawn in by a tenth."""
    pts = points(spark, sf_dir)
    a = sm.batches(pts, "id", BATCH).select("batch", "id", F.col("hd").alias("h"), F.col("ld").alias("l"))
    shrink = lambda c: F.transform(c, lambda z: z * 0.9).alias(c)
    return a, a.select("batch", "id", shrink("h"), shrink("l"))


@query("rank_affinity", f"WITH {PAIRS} SELECT batch, i, j, round(sqrt(exp((row_number() OVER (PARTITION BY batch, i ORDER BY d2, j) - 1) * ln(0.9)) * exp((row_number() OVER (PARTITION BY batch, j ORDER BY d2, i) - 1) * ln(0.9))), 6) + 0.0 AS p FROM r")
def rank_affinity(spark, sf_dir):
    """Affinity by rank, seen from both sides."""
    pairs = ob.rank_affinity(ob.pair_table(*views(spark, sf_dir)), 0.9)
    return pairs.select("batch", "i", "j", F.sqrt(F.col("px") * F.col("py")).alias("p"))


@query("distance_affinity", f"WITH {PAIRS} SELECT batch, i, j, round(exp(-d2 / (avg(d2) {_ROW} + 1e-8)), 6) + 0.0 AS p FROM r")
def distance_affinity(spark, sf_dir):
    """Affinity by distance and its row's mean."""
    return ob.distance_affinity(ob.pair_table(*views(spark, sf_dir))).select("batch", "i", "j", F.col("px").alias("p"))


@query("row_normalized_affinity", f"WITH {PAIRS}, e AS (SELECT *, exp(-d2 / (avg(d2) {_ROW} + 1e-8)) AS p FROM r) SELECT batch, i, j, round(CASE WHEN i <> j THEN p / sum(CASE WHEN i <> j THEN p ELSE 0 END) {_ROW} ELSE p END, 6) + 0.0 AS p FROM e")
def row_normalized_affinity(spark, sf_dir):
    """Affinity by its row's sum off the diagonal."""
    return ob.row_normalised(ob.distance_affinity(ob.pair_table(*views(spark, sf_dir))), "px").select("batch", "i", "j", F.col("px").alias("p"))


@query("student_t_affinity", f"WITH {PAIRS}, {Q01} SELECT batch, i, j, round(q, 6) + 0.0 AS q FROM q WHERE i <> j")
def student_t_affinity(spark, sf_dir):
    """The picture's affinity, off the diagonal."""
    return ob.student_t_affinity(ob.pair_table(*views(spark, sf_dir)), 0.1).where("i <> j").select("batch", "i", "j", "q")


_RANKP = "a AS (SELECT *, greatest(sqrt(exp((row_number() OVER (PARTITION BY batch, i ORDER BY d2, j) - 1) * ln(0.9)) * exp((row_number() OVER (PARTITION BY batch, j ORDER BY d2, i) - 1) * ln(0.9))), 1e-5) AS p FROM q)"


@query("manifold_loss_rank_hard", f"WITH {PAIRS}, {Q01}, {_RANKP}, s AS (SELECT batch, i, {LOSS} AS loss FROM a), t AS (SELECT *, rank() OVER (PARTITION BY batch, i ORDER BY loss DESC) AS k FROM s) SELECT batch, round(avg(loss), 6) + 0.0 AS loss FROM t WHERE k <= 10 GROUP BY batch")
def manifold_loss_rank_hard(spark, sf_dir):
    """Mean loss of each row's ten hardest pairs."""
    return ob.manifold_loss(*views(spark, sf_dir), hard=10)


@query("manifold_loss_distance_all", f"WITH {PAIRS}, {Q01}, e AS (SELECT *, greatest(exp(-d2 / (avg(d2) {_ROW} + 1e-8)), 1e-5) AS p0 FROM q), a AS (SELECT *, CASE WHEN i <> j THEN p0 / sum(CASE WHEN i <> j THEN p0 ELSE 0 END) {_ROW} ELSE p0 END AS p FROM e) SELECT batch, round(avg({LOSS}), 6) + 0.0 AS loss FROM a GROUP BY batch")
def manifold_loss_distance_all(spark, sf_dir):
    """Mean loss of all pairs, one-sided and row-normalised."""
    return ob.manifold_loss(*views(spark, sf_dir), affinity="distance", both_sides=False, row_normalise=True)


@query("contrastive_loss", f"WITH {PAIRS}, k AS (SELECT *, pow(1 + d ** 2 / 0.1, -0.55) AS k FROM r) SELECT batch, round(-avg(ln(k)) FILTER (i = j) + ln(sum(k) FILTER (i <> j)), 6) + 0.0 AS loss FROM k GROUP BY batch")
def contrastive_loss(spark, sf_dir):
    """Matching views against all others."""
    return ob.contrastive_loss(*views(spark, sf_dir), 0.1)


@query("pearson_loss", f"WITH {VIEW} SELECT batch, round(1 - covar_pop(h[1], h[3]) * count(*) / (sqrt(var_pop(h[1]) * count(*)) * sqrt(var_pop(h[3]) * count(*)) + 1e-8), 6) + 0.0 AS loss FROM v GROUP BY batch")
def pearson_loss(spark, sf_dir):
    """1 minus the correlation of two coordinates by batch."""
    a, _ = views(spark, sf_dir)
    return ob.pearson_loss(a.select("batch", F.get("h", F.lit(0)).alias("x"), F.get("h", F.lit(2)).alias("y")), "x", "y", ["batch"])


_SELF = f"{VIEW}, r AS (SELECT a.batch, a.id AS i, b.id AS j, greatest(list_distance(a.h, b.h) ** 2, 1e-12) AS d2, list_distance(a.l, b.l) AS d FROM v a JOIN v b ON a.batch = b.batch AND a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY d2, j) AS rh, row_number() OVER (PARTITION BY batch, i ORDER BY d, j) AS rl FROM r)"


@query("density_loss_multi", f"WITH {_SELF}, m AS (SELECT unnest([5, 10]) AS m), g AS (SELECT m, batch, i, max(-ln(sqrt(d2) + 1e-8)) FILTER (rh = m) AS x, max(-ln(d + 1e-8)) FILTER (rl = m) AS y FROM k, m GROUP BY ALL), c AS (SELECT m, batch, 1 - covar_pop(x, y) * count(*) / (sqrt(var_pop(x) * count(*)) * sqrt(var_pop(y) * count(*)) + 1e-8) AS loss FROM g GROUP BY ALL) SELECT batch, round(avg(loss), 6) + 0.0 AS loss FROM c GROUP BY batch")
def density_loss_multi(spark, sf_dir):
    """Log densities of both spaces at two sizes."""
    return ob.density_loss(views(spark, sf_dir)[0], 10)


@query("nearest_code", "WITH p AS (SELECT vec_id AS id, (embedding::DOUBLE[])[1:2] AS l, label FROM embeddings), c AS (SELECT label AS code, [avg(l[1]), avg(l[2])] AS v FROM p GROUP BY label), d AS (SELECT id, code, round(list_distance(l, v) ** 2, 12) AS d2 FROM p, c) SELECT id, code, round(d2, 6) + 0.0 AS d2 FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, code) = 1")
def nearest_code(spark, sf_dir):
    """The nearest class centre of each point."""
    pts = points(spark, sf_dir)
    codes = pts.groupBy(F.col("label").alias("code")).agg(F.array(*[F.avg(F.get("ld", F.lit(k))) for k in range(2)]).alias("v"))
    return ob.nearest_code(pts, codes, "ld")


# ---------------------------------------------------------------- augmentation
def _unit(*parts: str) -> str:
    return f"('0x' || substr(md5({' || '.join(parts)} || ':42'), 1, 7))::BIGINT"


_KNN5 = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS hd FROM embeddings), kn AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.hd, b.hd), b.id) - 1 AS rank FROM p a, p b QUALIFY rank <= 5)"


@query("neighbor_mixup", f"WITH {_KNN5}, m AS (SELECT p.id, dst AS node, p.hd, {_unit(chr(39) + 'alpha:' + chr(39), 'p.id::VARCHAR')} / 268435456.0::DOUBLE AS alpha FROM p JOIN kn ON kn.src = p.id AND kn.rank = {_unit('p.id::VARCHAR', chr(39) + ':0' + chr(39))} % 5 + 1) SELECT m.id, m.node, round(m.hd[1] * alpha + q.hd[1] * (1 - alpha), 6) + 0.0 AS a0, round(m.hd[64] * alpha + q.hd[64] * (1 - alpha), 6) + 0.0 AS a63 FROM m JOIN p q ON q.id = m.node")
def neighbor_mixup(spark, sf_dir):
    """Each point mixed with one of its five neighbours; first and last value."""
    pts = points(spark, sf_dir)
    out = augment.TRANSFORMS["neighbor_mixup"](pts, nb.knn(pts, 5, "hd"))
    return out.select("id", "node", F.get("aug", F.lit(0)).alias("a0"), F.get("aug", F.lit(63)).alias("a63"))


#: The five nearest of a point as a list, so that a step of a walk is one join of short tables.
_NEAR5 = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS hd FROM embeddings), kn AS MATERIALIZED (SELECT a.id AS src, list(b.id ORDER BY list_distance(a.hd, b.hd), b.id)[1:6] AS near FROM p a, p b GROUP BY a.id)"
_STEP = "s{h} AS MATERIALIZED (SELECT {of}.id AS id, near[{pick} % 5 + 2] AS node FROM {of} JOIN kn ON src = {of}.{at})"
_STEPS = ", ".join(_STEP.format(h=h, of=of, at=at, pick=_unit(f"{of}.id::VARCHAR", f"':{h}'")) for h, of, at in ((0, "p", "id"), (1, "s0", "node"), (2, "s1", "node")))


@query("trace_walk", f"WITH {_NEAR5}, {_STEPS} SELECT id, node FROM s2")
def trace_walk(spark, sf_dir):
    """Where a walk of three steps from each point ends."""
    pts = points(spark, sf_dir)
    return augment.walk(pts, nb.knn(pts, 5, "hd"), 5, 3, 42)


@query("augmented_pipeline")
def augmented_pipeline(spark, sf_dir):
    """A walk's mix, then dropped values; the mean of each view."""
    pts = points(spark, sf_dir)
    out = augment.apply(["trace_mixup", "feature_dropout"], pts, nb.knn(pts, 5, "hd"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return out.select("id", mean("aug").alias("aug_mean"), mean("hd").alias("mean"))


# ---------------------------------------------------------------- graphs
def _graph(spark, sf_dir: str, column: str) -> tuple[DataFrame, DataFrame]:
    pts = points(spark, sf_dir)
    return pts, nb.symmetric_graph(nb.knn(pts, 16, column))


@query("demap")
def demap(spark, sf_dir):
    """Graph distances in the data against distances in the picture, over 1,000 seeded landmarks."""
    pts, edges = _graph(spark, sf_dir, "hd")
    return graph.geodesic_fidelity(edges, sm.subsample(pts.select(F.col("id").alias("node")), "node", 1000, 0), xy(spark, sf_dir))


@query("pseudotime")
def pseudotime(spark, sf_dir):
    """Distance on the picture's graph from the points of label 0."""
    pts, edges = _graph(spark, sf_dir, "ld")
    return graph.distance_from_roots(edges, pts.where("label = 0").select(F.col("id").alias("node")))


@query("pseudotime_corr")
def pseudotime_corr(spark, sf_dir):
    """Spearman's correlation of pseudotime and label, and the share of points that a root reaches."""
    from ..functions.ranks import spearman

    pts, edges = _graph(spark, sf_dir, "ld")
    times = graph.distance_from_roots(edges, pts.where("label = 0").select(F.col("id").alias("node")))
    both = pts.select("id", F.col("label").cast("double").alias("a")).join(times, F.col("id") == F.col("node")).select("a", F.round("dist", 12).alias("b"))
    reached = both.agg((F.count("*") / F.lit(float(pts.count()))).alias("reached"))
    return spearman(both, "a", "b", "pseudotime_corr", float("nan")).join(reached)


_PLACED = "n AS (SELECT node, avg(x) AS x, avg(y) AS y FROM i GROUP BY node HAVING count(*) >= 10), d AS (SELECT a.node AS a, b.node AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS w FROM n a JOIN n b ON a.node <> b.node)"
_PRIM = "prim AS (SELECT [min(node)] AS seen, NULL::VARCHAR AS u, NULL::VARCHAR AS v FROM n UNION ALL SELECT list_append(seen, b), least(a, b), greatest(a, b) FROM (SELECT seen, a, b, row_number() OVER (ORDER BY w, least(a, b), greatest(a, b)) AS k FROM prim JOIN d ON list_contains(seen, a) AND NOT list_contains(seen, b)) WHERE k = 1)"


@query("topology_f1", f"WITH RECURSIVE {CELLS}, {_INC}, {_PLACED}, {_PRIM}, tree AS (SELECT u, v FROM prim WHERE u IS NOT NULL), e AS (SELECT DISTINCT least(f, t) AS u, greatest(f, t) AS v FROM cells WHERE f <> t AND f IN (SELECT node FROM n) AND t IN (SELECT node FROM n)), s AS (SELECT (SELECT count(*) FROM tree JOIN e USING (u, v)) AS hit, (SELECT count(*) FROM tree) AS n, (SELECT count(*) FROM e) AS m), r AS (SELECT hit / greatest(n, 1) AS p, hit / greatest(m, 1) AS r FROM s) SELECT round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) + 0.0 AS f1 FROM r")
def topology_f1(spark, sf_dir):
    """The spanning tree of node centres against the lineage."""
    cells = lineage_cells(spark, sf_dir)
    return graph.topology_scores(lineage.node_centroids(cells), lineage.lineage_edges(cells))


@query("perplexity_affinity")
def perplexity_affinity(spark, sf_dir):
    """Gaussian shares of 30 neighbours at perplexity 10, symmetrised."""
    pts = points(spark, sf_dir)
    return nb.symmetric_mean(graph.perplexity_affinity(nb.knn(pts, 30, "hd"), 10.0))


@query("expected_log_radius")
def expected_log_radius(spark, sf_dir):
    """Log of the mean squared distance under those shares."""
    pts = points(spark, sf_dir)
    return graph.expected_log_radius(graph.perplexity_affinity(nb.knn(pts, 30, "hd"), 10.0))


@query("time_continuity", "WITH p AS (SELECT vec_id AS id, (embedding::DOUBLE[])[1:2] AS l, label::DOUBLE AS t FROM embeddings), kn AS (SELECT a.id AS src, b.id AS dst, abs(a.t - b.t) AS dt, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.l, b.l), b.id) - 1 AS rank FROM p a, p b), pos AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, t FROM p), dr AS (SELECT t AS n, ('0x' || substr(md5(t::VARCHAR || ':0:42'), 1, 7))::BIGINT % (SELECT count(*) FROM p) AS p0, ('0x' || substr(md5(t::VARCHAR || ':1:42'), 1, 7))::BIGINT % (SELECT count(*) FROM p) AS p1 FROM (SELECT range AS t FROM range(200000))) SELECT round(1 - (SELECT avg(dt) FROM kn WHERE rank BETWEEN 1 AND 15) / (SELECT avg(abs(a.t - b.t)) FROM dr JOIN pos a ON a.pos = p0 JOIN pos b ON b.pos = p1 WHERE p0 <> p1), 6) + 0.0 AS time_continuity")
def time_continuity(spark, sf_dir):
    """How much less labels differ along neighbour edges than between 200,000 seeded pairs."""
    pts = points(spark, sf_dir)
    t = lambda key, name: pts.select(F.col("id").alias(key), F.col("label").cast("double").alias(name))
    near = nb.knn(pts, 15, "ld").join(t("src", "a"), "src").join(t("dst", "b"), "dst").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("near"))
    drawn = sm.random_tuples(spark, sm.with_position(pts, "id"), 200000, 2)
    far = drawn.join(t("i0", "a"), "i0").join(t("i1", "b"), "i1").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("far"))
    return near.join(far).select((1 - F.col("near") / F.col("far")).alias("time_continuity"))


# ---------------------------------------------------------------- schedules and tables
@query("lr_schedule", "WITH s AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch FROM events), m AS (SELECT max(epoch) + 1 AS n FROM s) SELECT epoch, round(CASE WHEN epoch < 5 THEN 0.001 * (epoch + 1) / 5 ELSE 0.5 * 0.001 * (1 + cos(pi() * (epoch - 5) / greatest(n - 5, 1))) END, 6) + 0.0 AS rate FROM s, m")
def lr_schedule(spark, sf_dir):
    """A linear rise over five epochs, then a cosine's fall; epochs are the days of the events."""
    days = read(spark, sf_dir, "events").select(F.datediff("ts", F.lit("2024-01-01")).alias("epoch")).distinct()
    n = days.agg((F.max("epoch") + 1).alias("n"))
    fall = 0.5 * 0.001 * (1 + F.cos(F.lit(math.pi) * (F.col("epoch") - 5) / F.greatest(F.col("n") - 5, F.lit(1))))
    return days.join(F.broadcast(n)).select("epoch", F.when(F.col("epoch") < 5, 0.001 * (F.col("epoch") + 1) / 5).otherwise(fall).alias("rate"))


@query("grid_decode", "WITH g AS (SELECT * FROM (VALUES (0, 5.0), (1, 15.0), (2, 30.0), (3, 50.0)) t(k, v)) SELECT s_suppkey AS id, round(CASE WHEN s_suppkey % 7 = 0 THEN 99.0 ELSE v END, 6)::DOUBLE + 0.0 AS value FROM supplier JOIN g ON k = least(greatest(s_nationkey - 5, 0), 3)")
def grid_decode(spark, sf_dir):
    """A grid's value at a clipped place; an override wins."""
    grid = spark.createDataFrame([(0, 5.0), (1, 15.0), (2, 30.0), (3, 50.0)], "k int, v double")
    s = read(spark, sf_dir, "supplier").withColumn("k", F.least(F.greatest(F.col("s_nationkey") - 5, F.lit(0)), F.lit(3)))
    override = F.when(F.col("s_suppkey") % 7 == 0, F.lit(99.0))
    return s.join(F.broadcast(grid), "k").select(F.col("s_suppkey").alias("id"), F.coalesce(override, F.col("v")).alias("value"))


@query("layer_average", "WITH s AS (SELECT event_type AS metric, date_diff('day', DATE '2024-01-01', ts::DATE) % 3 AS layer, avg(value) AS v FROM events GROUP BY 1, 2) SELECT metric, round(avg(v), 6) + 0.0 AS value FROM s GROUP BY metric")
def layer_average(spark, sf_dir):
    """Each metric's mean over three layers."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), (F.datediff("ts", F.lit("2024-01-01")) % 3).alias("layer"), "value")
    return e.groupBy("metric", "layer").agg(F.avg("value").alias("v")).groupBy("metric").agg(F.avg("v").alias("value"))


@query("metric_long_form", "WITH s AS (SELECT event_type AS name, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch, value FROM events), a AS (SELECT name, epoch, avg(value) AS mean, max(value) AS top FROM s GROUP BY 1, 2) SELECT name, epoch, 'mean' AS metric, round(mean, 6) + 0.0 AS value FROM a UNION ALL SELECT name, epoch, 'top', round(top, 6) + 0.0 FROM a UNION ALL SELECT name, epoch, 'combined', round(0.5 * mean + 0.5 * top, 6) + 0.0 FROM a")
def metric_long_form(spark, sf_dir):
    """Metrics and their composite as rows."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.datediff("ts", F.lit("2024-01-01")).alias("epoch"), "value")
    wide = e.groupBy("name", "epoch").agg(F.avg("value").alias("mean"), F.max("value").alias("top")).withColumn("combined", 0.5 * F.col("mean") + 0.5 * F.col("top"))
    return wide.unpivot(["name", "epoch"], ["mean", "top", "combined"], "metric", "value")


@query("series_tail", "WITH s AS (SELECT event_type AS name, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch, avg(value) AS value FROM events GROUP BY 1, 2) SELECT name, epoch, round(value, 6) + 0.0 AS value FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY epoch DESC) <= 5")
def series_tail(spark, sf_dir):
    """The last five epochs of each series."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("name").orderBy(F.desc("epoch"))
    return series(spark, sf_dir).withColumn("_r", F.row_number().over(w)).where("_r <= 5").drop("_r").select("name", "epoch", "value")


@query("pca_embedding")
def pca_embedding(spark, sf_dir):
    """Two principal coordinates of the centred data; their signs are free."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..operators.prep import per_feature

    pts = points(spark, sf_dir).select("id", "hd")
    mean = per_feature(pts, "hd", "mean")
    vec = pts.join(F.broadcast(mean)).select("id", array_to_vector(F.zip_with("hd", "mean", lambda x, m: x - m)).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="o").fit(vec).transform(vec).select("id", vector_to_array("o").alias("o"))
    return out.select("id", F.get("o", F.lit(0)).alias("x"), F.get("o", F.lit(1)).alias("y"))
