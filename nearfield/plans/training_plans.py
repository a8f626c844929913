"""Registered queries of training values, schedules, samples and approximate neighbours, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distance import cosine_similarity, gamma_kernel
from ..operators import approximate, classify, health
from ..operators import fidelity as fd
from ..operators import neighbours as nb
from ..operators import prep
from ..operators import sampling as sm
from ..operators import training as tr
from ..operators.points import points, read
from .health_plans import xy
from .neighbour_plans import HD, LD, P
from .objective_plans import _RANKP, _SELF, LOSS, PAIRS, Q01, VIEW, views
from .register import registry

QUERIES, ORACLES, query = registry()

_EPOCHS = "s AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch FROM events)"
_SHARES = f"{P}, {HD}, g AS (SELECT src, dst, exp(-(dist ** 2) / (2 * 4.0 * 4.0)) AS g, a.ld[1] - b.ld[1] AS dx, a.ld[2] - b.ld[2] AS dy FROM hd JOIN p a ON a.id = src JOIN p b ON b.id = dst WHERE rank BETWEEN 1 AND 10), t AS (SELECT *, dx * dx + dy * dy AS d2, 1 / (1 + dx * dx + dy * dy) AS t FROM g), e AS (SELECT *, g / sum(g) OVER () AS p, t / sum(t) OVER () AS q FROM t)"


def _epochs(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.datediff("ts", F.lit("2024-01-01")).alias("epoch")).distinct()


def _shares(spark, sf_dir, near=None):
    near = nb.knn(points(spark, sf_dir), 10, "hd") if near is None else near
    return tr.edge_shares(near, xy(spark, sf_dir).select("id", "x", "y"), 4.0)


# ---------------------------------------------------------------- losses
_DENSE = f"m AS (SELECT unnest([5, 10]) AS m), g AS (SELECT m, batch, i, max(-ln(sqrt(d2) + 1e-8)) FILTER (rh = m) AS x, max(-ln(d + 1e-8)) FILTER (rl = m) AS y FROM k, m GROUP BY ALL), c AS (SELECT m, batch, 1 - covar_pop(x, y) * count(*) / (sqrt(var_pop(x) * count(*)) * sqrt(var_pop(y) * count(*)) + 1e-8) AS loss FROM g GROUP BY ALL), dense AS (SELECT batch, avg(loss) AS density FROM c GROUP BY batch)"


@query("total_loss", f"WITH mani AS (WITH {PAIRS}, {Q01}, {_RANKP} SELECT batch, avg({LOSS}) AS manifold FROM a GROUP BY batch), {_SELF}, {_DENSE} SELECT batch, round(manifold, 6) + 0.0 AS manifold, round(density, 6) + 0.0 AS density, round(manifold + 0.5 * density, 6) + 0.0 AS loss FROM mani JOIN dense USING (batch)")
def total_loss(spark, sf_dir):
    """Manifold loss and half the density loss of each batch."""
    return tr.total_loss(*views(spark, sf_dir), weight=0.5, k=10)


_Z = "({c} - avg({c}) OVER (PARTITION BY batch)) / greatest(stddev_pop({c}) OVER (PARTITION BY batch), 1e-6)"


@query("consistency_loss", f"WITH {VIEW}, f AS (SELECT batch, id, l[1] AS x, l[2] AS y, h[3] AS u, h[4] AS w FROM v), z AS (SELECT batch, id, {_Z.format(c='x')} AS x, {_Z.format(c='y')} AS y, {_Z.format(c='u')} AS tx, {_Z.format(c='w')} AS ty FROM f), d AS (SELECT a.batch, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS ds, sqrt((a.tx - b.tx) ** 2 + (a.ty - b.ty) ** 2) AS dt FROM z a JOIN z b ON a.batch = b.batch AND a.id < b.id), n AS (SELECT batch, {_Z.format(c='ds')} AS ds, {_Z.format(c='dt')} AS dt FROM d), far AS (SELECT batch, avg((ds - dt) ** 2) AS far FROM n GROUP BY batch), place AS (SELECT batch, avg(((x - tx) ** 2 + (y - ty) ** 2) / 2) AS place FROM z GROUP BY batch) SELECT batch, round(far + 0.2 * place, 6) + 0.0 AS loss FROM far JOIN place USING (batch)")
def consistency_loss(spark, sf_dir):
    """Two pictures of each batch against each other: the first two coordinates and the next two."""
    a, _ = views(spark, sf_dir)
    return tr.consistency_loss(a.select("batch", "id", "l"), a.select("batch", "id", F.slice("h", 3, 2).alias("l")))


@query("teacher_update", "WITH e AS (SELECT label, vec_id % 2 AS odd, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), m AS (SELECT label, odd, unnest([0, 1]) AS pos, unnest([avg(a), avg(b)]) AS v FROM e GROUP BY label, odd), t AS (SELECT * FROM m WHERE odd = 0), s AS (SELECT * FROM m WHERE odd = 1) SELECT coalesce(t.label, s.label)::VARCHAR AS name, coalesce(t.pos, s.pos) AS pos, round(coalesce(0.9 * t.v + 0.1 * s.v, t.v, s.v), 6) + 0.0 AS value FROM t FULL JOIN s ON t.label = s.label AND t.pos = s.pos")
def teacher_update(spark, sf_dir):
    """Class centres of points of even id drawn a tenth of the way to those of odd id."""
    side = lambda odd: points(spark, sf_dir).where(F.col("id") % 2 == odd).groupBy(F.col("label").cast("string").alias("name")).agg(F.array(F.avg(F.get("ld", F.lit(0))), F.avg(F.get("ld", F.lit(1)))).alias("v")).select("name", F.posexplode("v").alias("pos", "value"))
    return tr.teacher_update(side(0), side(1), 0.9)


_CODES = "p AS (SELECT vec_id AS id, (embedding::DOUBLE[])[1:2] AS l, label FROM embeddings)"


@query("code_loss", f"WITH {_CODES}, c AS (SELECT label AS code, [avg(l[1]), avg(l[2])] AS v FROM p GROUP BY label), d AS (SELECT id, min(list_distance(l, v) ** 2) AS d2 FROM p, c GROUP BY id) SELECT round(1.25 * sum(d2) / (2 * count(*)), 6) + 0.0 AS loss FROM d")
def code_loss(spark, sf_dir):
    """Points against the nearest of the class centres."""
    pts = points(spark, sf_dir)
    codes = pts.groupBy(F.col("label").alias("code")).agg(F.array(*[F.avg(F.get("ld", F.lit(k))) for k in range(2)]).alias("v"))
    return tr.code_loss(pts, codes, "ld")


def _level(n: int) -> str:
    before = "SELECT id, 0 AS node, l FROM p" if n == 1 else f"SELECT id, node, l FROM l{n - 1}"
    return f"l{n} AS (SELECT q.id, t.node, q.l, round(list_distance(q.l, t.v) ** 2, 12) AS d2 FROM ({before}) q JOIN tree t ON t.node IN (2 * q.node + 1, 2 * q.node + 2) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.l, t.v) ** 2, 12), t.node) = 1)"


@query("tree_route", f"WITH {_CODES}, tree AS (SELECT row_number() OVER (ORDER BY id) AS node, l AS v FROM p QUALIFY node <= 14), {_level(1)}, {_level(2)}, {_level(3)} " + " UNION ALL ".join(f"SELECT id, {n} AS level, node, round(d2, 6) + 0.0 AS d2 FROM l{n}" for n in (1, 2, 3)))
def tree_route(spark, sf_dir):
    """Three levels of a binary tree whose nodes are the first 14 points."""
    pts = points(spark, sf_dir)
    first = pts.orderBy("id").limit(14)  # the code book, 14 nodes by definition
    tree = sm.with_position(first, "id").join(first, "id").select((F.col("pos") + 1).alias("node"), F.col("ld").alias("v"))
    return tr.tree_route(pts, tree, "ld", 3)


@query("orthogonality_loss", f"WITH {VIEW}, n AS (SELECT batch, count(*) AS n FROM v GROUP BY batch), c AS (SELECT a.batch, sum(list_cosine_similarity(a.h, b.h)) AS s FROM v a JOIN v b ON a.batch = b.batch AND a.id < b.id GROUP BY a.batch) SELECT round(1 + avg(s / (n * n)), 6) + 0.0 AS loss FROM n JOIN c USING (batch)")
def orthogonality_loss(spark, sf_dir):
    """Mean cosine of pairs of each batch, over its whole square."""
    return tr.orthogonality_loss(views(spark, sf_dir)[0].select(F.col("batch").alias("group"), "id", F.col("h").alias("v")))


@query("cosine_neighbours", f"WITH {P}, {HD} SELECT src, dst, round(list_cosine_similarity(a.hd, b.hd), 6) + 0.0 AS cosine FROM hd JOIN p a ON a.id = src JOIN p b ON b.id = dst WHERE rank BETWEEN 1 AND 3")
def cosine_neighbours(spark, sf_dir):
    """The cosine of each point and its three nearest."""
    pts = points(spark, sf_dir)
    at = lambda key, name: pts.select(F.col("id").alias(key), F.col("hd").alias(name))
    return nb.knn(pts, 3, "hd").join(at("src", "a"), "src").join(at("dst", "b"), "dst").select("src", "dst", cosine_similarity("a", "b").alias("cosine"))


@query("gamma_affinity", f"WITH {P}, {HD} SELECT src, dst, round(6.28 * pow(gamma(0.55) / (gamma(0.05) * sqrt(0.1 * pi())), 2) * pow(1 + dist / 0.1, -1.1), 6) + 0.0 AS p FROM hd WHERE rank BETWEEN 1 AND 5")
def gamma_affinity(spark, sf_dir):
    """The heavy-tailed kernel of five neighbours' distances."""
    return nb.knn(points(spark, sf_dir), 5, "hd").select("src", "dst", gamma_kernel(F.col("dist"), 0.1).alias("p"))


# ---------------------------------------------------------------- graph and density terms
@query("kl_cost", f"WITH {_SHARES} SELECT round(sum(p * ln((p + 1.1754943508222875e-38) / (q + 1.1754943508222875e-38))), 6) + 0.0 AS cost FROM e")
def kl_cost(spark, sf_dir):
    """Divergence of the data's shares of ten neighbours from the picture's."""
    return tr.kl_cost(_shares(spark, sf_dir))


@query("edge_forces", f"WITH {_SHARES} SELECT src AS id, round(1000 * sum(p / (1 + d2) * dx), 6) + 0.0 AS fx, round(1000 * sum(p / (1 + d2) * dy), 6) + 0.0 AS fy FROM e GROUP BY src")
def edge_forces(spark, sf_dir):
    """A thousand times the pull of each point's neighbours."""
    return tr.edge_forces(_shares(spark, sf_dir)).select("id", (1000 * F.col("fx")).alias("fx"), (1000 * F.col("fy")).alias("fy"))


@query("shifted_density_correlation", f"WITH {_SHARES}, r AS (SELECT src, ln(avg(dist ** 2)) AS r FROM hd WHERE rank BETWEEN 1 AND 10 GROUP BY src), re AS (SELECT src, ln(sum(d2 * t) / sum(t)) AS re FROM e GROUP BY src), z AS (SELECT re, (r - avg(r) OVER ()) / stddev_samp(r) OVER () AS r FROM r JOIN re USING (src)) SELECT round(covar_samp(re, r) / sqrt(var_samp(re) + 0.1), 6) + 0.0 AS rho FROM z")
def shifted_density_correlation(spark, sf_dir):
    """Log radii in the picture against those in the data."""
    near = nb.knn(points(spark, sf_dir), 10, "hd")
    r = near.groupBy(F.col("src").alias("id")).agg(F.log(F.avg(F.col("dist") ** 2)).alias("r"))
    return tr.shifted_correlation(tr.picture_radius(_shares(spark, sf_dir, near)).join(r, "id"), "re", "r")


@query("tail_trimmed", "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings), d AS (SELECT id, label, sqrt((x - avg(x) OVER w) ** 2 + (y - avg(y) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY label)), q AS (SELECT label, quantile_cont(d, 0.95) AS q FROM d GROUP BY label) SELECT id, d.label FROM d JOIN q ON q.label IS NOT DISTINCT FROM d.label WHERE d.d <= q.q")
def tail_trimmed(spark, sf_dir):
    """Points but the farthest twentieth of each class."""
    return tr.tail_trimmed(points(spark, sf_dir), "label", "ld").select("id", "label")


# ---------------------------------------------------------------- schedules
@query("temperature", f"WITH {_EPOCHS} SELECT epoch, round(CASE WHEN epoch >= 900 THEN 1.001 ELSE 100 * pow(1.001 / 100, epoch / 899.0) END, 6) + 0.0 AS tau FROM s")
def temperature(spark, sf_dir):
    """The annealed temperature; epochs are the days of the events."""
    return _epochs(spark, sf_dir).select("epoch", tr.temperature(F.col("epoch")).alias("tau"))


@query("training_stage", f"WITH {_EPOCHS} SELECT epoch, CASE WHEN epoch > 20 THEN 'step2_r' WHEN epoch > 10 THEN 'step2_s' ELSE 'step1' END AS stage FROM s")
def training_stage(spark, sf_dir):
    """The stage of each epoch."""
    return _epochs(spark, sf_dir).select("epoch", tr.stage(F.col("epoch"), 10, 20).alias("stage"))


# ---------------------------------------------------------------- samples
@query("multi_level_knn", "WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS hd, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id) AS k FROM embeddings), l AS (SELECT unnest([0, 1, 2]) AS level, unnest([30, 60, 1000000000]) AS size), r AS (SELECT level, a.id AS src, b.id AS dst, list_distance(a.hd, b.hd) AS dist, row_number() OVER (PARTITION BY level, a.id ORDER BY list_distance(a.hd, b.hd), b.id) - 1 AS rank FROM l JOIN p a ON a.k <= size JOIN p b ON b.k <= size) SELECT level, src, rank, dst, round(dist, 6) + 0.0 AS dist FROM r WHERE rank BETWEEN 1 AND 5")
def multi_level_knn(spark, sf_dir):
    """Five neighbours within samples of 30 and 60 points, and within all."""
    return tr.multi_level(points(spark, sf_dir), [30, 60], 5, "hd")


@query("anchor_subsets", f"WITH {P}, {HD}, a AS (SELECT id FROM p ORDER BY md5(id::VARCHAR || ':42'), id LIMIT 16) SELECT src, rank, dst, round(dist, 6) + 0.0 AS dist FROM hd WHERE src IN (SELECT id FROM a) AND rank < 8")
def anchor_subsets(spark, sf_dir):
    """The eight points nearest to each of 16 anchors."""
    return tr.anchor_subsets(points(spark, sf_dir), 16, 8, "hd")


@query("anchor_log_density", f"WITH {P}, {HD}, a AS (SELECT id FROM p ORDER BY md5(id::VARCHAR || ':42'), id LIMIT 64) SELECT src, round(-ln(greatest(dist, 1e-4)), 6) + 0.0 AS log_density FROM hd WHERE src IN (SELECT id FROM a) AND rank = 10")
def anchor_log_density(spark, sf_dir):
    """Log density of 64 anchors by their tenth neighbour among all points."""
    return fd.log_density(tr.anchor_subsets(points(spark, sf_dir), 64, 11, "hd"), 10, 1e-4)


@query("cluster_batches", f"WITH {P}, {HD}, a AS (SELECT id FROM p ORDER BY md5(id::VARCHAR || ':42'), id LIMIT 10), n AS (SELECT src AS batch, dst AS id FROM hd WHERE src IN (SELECT id FROM a) AND rank BETWEEN 1 AND 12 QUALIFY row_number() OVER (PARTITION BY src ORDER BY md5(src::VARCHAR || ':' || dst::VARCHAR || ':42'), dst) < 8) SELECT batch, id FROM n UNION ALL SELECT id, id FROM a")
def cluster_batches(spark, sf_dir):
    """Ten batches of a seed and seven of its twelve neighbours."""
    pts = points(spark, sf_dir)
    return tr.cluster_batches(pts, nb.knn(pts, 12, "hd"), 10, 8)


@query("gaussian_noise", "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x FROM embeddings), u AS (SELECT id, x, (('0x' || substr(md5(id::VARCHAR || ':0:0:42'), 1, 7))::BIGINT + 1) / 268435457.0::DOUBLE AS a, (('0x' || substr(md5(id::VARCHAR || ':0:1:42'), 1, 7))::BIGINT + 1) / 268435457.0::DOUBLE AS b FROM p) SELECT id, round(x + 0.1 * sqrt(-2 * ln(a)) * cos(2 * pi() * b), 6) + 0.0 AS aug FROM u")
def gaussian_noise(spark, sf_dir):
    """Points with noise; the first value."""
    return tr.gaussian_noise(points(spark, sf_dir), "hd", 0.1).select("id", F.get("aug", F.lit(0)).alias("aug"))


# ---------------------------------------------------------------- metrics
@query("nonfinite_summary", "WITH e AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > 1.5 THEN NULL ELSE x END) AS v FROM embeddings) SELECT id, len(v)::INTEGER AS size, round(list_count(v) / len(v), 6) + 0.0 AS finite_fraction, round(list_max(list_transform(list_filter(v, lambda x: x IS NOT NULL), lambda x: abs(x))), 6) + 0.0 AS max_finite FROM e")
def nonfinite_summary(spark, sf_dir):
    """Size, share of finite values and greatest finite value of each vector; values over 1.5 stand for infinity."""
    df = points(spark, sf_dir).select("id", F.transform("hd", lambda x: F.when(x > 1.5, F.lit(float("inf"))).otherwise(x)).alias("v"))
    return health.nonfinite_summary(df, "v")


@query("svc_accuracy")
def svc_accuracy(spark, sf_dir):
    """Held-out accuracy of a linear support-vector classifier on the picture."""
    return classify.svc_accuracy(points(spark, sf_dir), "ld", "label")


@query("trajectory_bundle")
def trajectory_bundle(spark, sf_dir):
    """Pseudotime correlation and reach, order concordance, continuity and geodesic fidelity in one row."""
    from .objective_plans import demap, pseudotime_corr, time_continuity
    from .summary_plans import time_ordering

    out = pseudotime_corr(spark, sf_dir)
    for part in (time_ordering, time_continuity, demap):
        out = out.join(part(spark, sf_dir))  # one row each
    return out


@query("approximate_recall")
def approximate_recall(spark, sf_dir):
    """Recall of the approximate join's 12 neighbours against the exact ones."""
    pts = points(spark, sf_dir)
    return approximate.recall(approximate.knn(pts, 12, "hd"), nb.knn(pts, 12, "hd"))


@query("zscore_zero_as_one", "WITH b AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS a, l_tax AS t FROM lineitem) SELECT id, round((a - avg(a) OVER ()) / CASE WHEN stddev_pop(a) OVER () = 0 THEN 1 ELSE stddev_pop(a) OVER () END, 6) + 0.0 AS a, 0.0::DOUBLE AS c, round((t - avg(t) OVER ()) / stddev_pop(t) OVER (), 6) + 0.0 AS t FROM b")
def zscore_zero_as_one(spark, sf_dir):
    """Features in deviations from their mean; a constant one becomes 0."""
    df = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_quantity").cast("double"), F.lit(3.0), F.col("l_tax").cast("double")).alias("v"))
    return prep.z_score(df, "v", zero_as_one=True).select("id", *[F.get("v", F.lit(k)).alias(n) for k, n in enumerate("act")])
