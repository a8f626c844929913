"""Registered queries over neighbours, ranks and densities of the embeddings, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import euclidean, log_ratio
from ..operators import fidelity as fd
from ..operators import neighbours as nb
from ..operators import sampling as sm
from ..operators.points import points
from .register import registry

QUERIES, ORACLES, query = registry()

#: DuckDB: points, distances and ranks in both spaces.
P = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS hd, (embedding::DOUBLE[])[1:2] AS ld, label FROM embeddings)"
HD = "hd AS (SELECT a.id AS src, b.id AS dst, list_distance(a.hd, b.hd) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.hd, b.hd), b.id) - 1 AS rank FROM p a, p b)"
LD = "ld AS (SELECT a.id AS src, b.id AS dst, list_distance(a.ld, b.ld) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.ld, b.ld), b.id) - 1 AS rank FROM p a, p b)"
N = "n AS (SELECT count(*)::DOUBLE AS n FROM p)"


def _avg_rank(value: str) -> str:
    return f"(rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0)"


def _both(spark, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    pts = points(spark, sf_dir)
    return pts, nb.knn(pts, k, "hd"), nb.knn(pts, k, "ld")


@query("density_correlation_k15", f"WITH {P}, {HD}, {LD}, m AS (SELECT a.src, a.r AS a, b.r AS b FROM (SELECT src, avg(dist) AS r FROM hd WHERE rank BETWEEN 1 AND 15 GROUP BY src) a JOIN (SELECT src, avg(dist) AS r FROM ld WHERE rank BETWEEN 1 AND 15 GROUP BY src) b ON a.src = b.src) SELECT round(corr(ra, rb), 6) + 0.0 AS density_correlation FROM (SELECT {_avg_rank('a')} AS ra, {_avg_rank('b')} AS rb FROM m)")
def density_correlation_k15(spark, sf_dir):
    """Spearman's correlation of mean neighbour radii."""
    _, hd, ld = _both(spark, sf_dir, 15)
    return fd.density_correlation(hd, ld)


for _c, _s in (("hd", HD), ("ld", LD)):

    @query(f"knn_{_c}_k12", f"WITH {P}, {_s} SELECT src, rank::INTEGER AS rank, dst, round(dist, 6) + 0.0 AS dist FROM {_c} WHERE rank BETWEEN 1 AND 12")
    def _knn(spark, sf_dir, c=_c):
        """Twelve nearest neighbours."""
        return nb.knn(points(spark, sf_dir), 12, c)


@query("knn_label_constrained", f"WITH {P}, x AS (SELECT a.id AS src, b.id AS dst, list_distance(a.hd, b.hd) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY a.label <> b.label, list_distance(a.hd, b.hd), b.id) - 1 AS rank FROM p a, p b) SELECT src, rank::INTEGER AS rank, dst, round(dist, 6) + 0.0 AS dist FROM x WHERE rank BETWEEN 1 AND 12")
def knn_label_constrained(spark, sf_dir):
    """Neighbours of the same label first."""
    return nb.knn(points(spark, sf_dir), 12, "hd", "label")


@query("radius_counts_hd", f"WITH {P}, {HD}, e AS (SELECT quantile_cont(dist, 0.5) AS e FROM hd WHERE rank = 49) SELECT src AS id, count(*) AS n FROM hd, e WHERE dist <= e GROUP BY src")
def radius_counts_hd(spark, sf_dir):
    """Points within the median distance to the 50th."""
    pts = points(spark, sf_dir)
    return nb.radius_counts(pts, pts, nb.distance_quantile_radius(pts, 50, "hd"), "hd")


@query("neighbour_ranks", f"WITH {P}, {HD}, {LD} SELECT hd.src, hd.dst, ld.rank AS rank FROM hd JOIN ld ON hd.src = ld.src AND hd.dst = ld.dst WHERE hd.rank BETWEEN 1 AND 5")
def neighbour_ranks(spark, sf_dir):
    """The picture's full rank of each of the five nearest in the data."""
    pts = points(spark, sf_dir)
    return nb.pair_ranks(nb.knn(pts, 5, "hd"), pts, "ld")


@query("knn_preservation", f"WITH {P}, {HD}, {LD}, {N} SELECT round(count(*) / (any_value(n) * 12), 6) + 0.0 AS knn_preservation FROM hd JOIN ld USING (src, dst), n WHERE hd.rank BETWEEN 1 AND 12 AND ld.rank BETWEEN 1 AND 12")
def knn_preservation(spark, sf_dir):
    """Common neighbours of both spaces."""
    pts, hd, ld = _both(spark, sf_dir, 12)
    return fd.knn_preservation(hd, ld, pts.count(), 12)


def _penalty_sql(own: str, other: str, name: str) -> str:
    return f"WITH {P}, {HD}, {LD}, {N} SELECT round(1 - 2 * coalesce(sum(b.rank - 12), 0) / (any_value(n) * 12 * (2 * any_value(n) - 37)), 6) + 0.0 AS {name} FROM {own} a JOIN {other} b USING (src, dst), n WHERE a.rank BETWEEN 1 AND 12 AND b.rank > 12"


@query("trustworthiness", _penalty_sql("ld", "hd", "trustworthiness"))
def trustworthiness(spark, sf_dir):
    """Excess ranks of false neighbours."""
    return fd.trustworthiness(points(spark, sf_dir), 12)


@query("continuity", _penalty_sql("hd", "ld", "continuity"))
def continuity(spark, sf_dir):
    """Excess ranks of lost neighbours."""
    return fd.continuity(points(spark, sf_dir), 12)


_RADII = f"WITH {P}, {HD}, {LD}, m AS (SELECT a.src, a.r AS a, b.r AS b FROM (SELECT src, avg(dist) AS r FROM hd WHERE rank BETWEEN 1 AND 15 GROUP BY src) a JOIN (SELECT src, avg(dist) AS r FROM ld WHERE rank BETWEEN 1 AND 15 GROUP BY src) b ON a.src = b.src)"


@query("neighborhood_distortion", _RADII + " SELECT round(avg(abs(ln((b / ((SELECT avg(b) FROM m) + 1e-8)) / (a / ((SELECT avg(a) FROM m) + 1e-8) + 1e-8) + 1e-8))), 6) + 0.0 AS neighborhood_distortion FROM m")
def neighborhood_distortion(spark, sf_dir):
    """Mean absolute log ratio of radii."""
    _, hd, ld = _both(spark, sf_dir, 15)
    return fd.neighborhood_distortion(hd, ld)


@query("local_density_correlation", f"WITH {P}, {HD}, {LD}, m AS (SELECT hd.dist AS a, ld.dist AS b FROM hd JOIN ld ON hd.src = ld.src WHERE hd.rank = 15 AND ld.rank = 15) SELECT round(corr(ra, rb), 6) + 0.0 AS local_density_correlation FROM (SELECT {_avg_rank('a')} AS ra, {_avg_rank('b')} AS rb FROM m)")
def local_density_correlation(spark, sf_dir):
    """Spearman's correlation of 15th distances."""
    _, hd, ld = _both(spark, sf_dir, 15)
    return fd.local_density_correlation(hd, ld, 15)


@query("spir", f"WITH {P}, {HD}, {LD}, f AS (SELECT src, dist >= (SELECT quantile_cont(dist, 0.9) FROM hd WHERE rank = 12) AS noise FROM hd WHERE rank = 12) SELECT round(avg((NOT t.noise)::INT), 6) + 0.0 AS spir FROM ld JOIN f s ON ld.src = s.src JOIN f t ON ld.dst = t.src WHERE s.noise AND ld.rank BETWEEN 1 AND 12")
def spir(spark, sf_dir):
    """Intrusion of dense points near scattered ones."""
    _, hd, ld = _both(spark, sf_dir, 12)
    return fd.intrusion_rate(hd, ld, 12)


@query("msdp_auc", f"WITH {P}, {HD}, {LD}, ks AS (SELECT unnest([5, 10, 15, 25, 50, 100, 200]) AS k0), kk AS (SELECT k0, least(k0, (SELECT count(*) FROM p) - 1) AS k FROM ks), a AS (SELECT k0, src, avg(dist) AS a FROM hd, kk WHERE rank BETWEEN 1 AND k GROUP BY k0, src), b AS (SELECT k0, src, avg(dist) AS b FROM ld, kk WHERE rank BETWEEN 1 AND k GROUP BY k0, src), r AS (SELECT k0, rank() OVER (PARTITION BY k0 ORDER BY a) + (count(*) OVER (PARTITION BY k0, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY k0 ORDER BY b) + (count(*) OVER (PARTITION BY k0, b) - 1) / 2.0 AS rb FROM a JOIN b USING (k0, src)) SELECT round(avg(c), 6) + 0.0 AS msdp_auc FROM (SELECT corr(ra, rb) AS c FROM r GROUP BY k0)")
def msdp_auc(spark, sf_dir):
    """Mean density correlation over seven sizes."""
    pts = points(spark, sf_dir)
    n = pts.count()
    k = min(200, n - 1)
    return fd.multi_scale_density(nb.knn(pts, k, "hd"), nb.knn(pts, k, "ld"), n)


@query("frdc", f"WITH {P}, {HD}, {LD}, m AS (SELECT a.n AS a, b.n AS b FROM (SELECT src, count(*) AS n FROM hd WHERE dist <= (SELECT quantile_cont(dist, 0.5) FROM hd WHERE rank = 49) GROUP BY src) a JOIN (SELECT src, count(*) AS n FROM ld WHERE dist <= (SELECT quantile_cont(dist, 0.5) FROM ld WHERE rank = 49) GROUP BY src) b ON a.src = b.src) SELECT round(corr(ra, rb), 6) + 0.0 AS frdc FROM (SELECT {_avg_rank('a')} AS ra, {_avg_rank('b')} AS rb FROM m)")
def frdc(spark, sf_dir):
    """Density correlation by fixed radius."""
    return fd.fixed_radius_density(points(spark, sf_dir))


@query("knn_log_density", f"WITH {P}, {HD} SELECT src, round(-ln(greatest(dist, 0.0001)), 6) + 0.0 AS log_density FROM hd WHERE rank = 10")
def knn_log_density(spark, sf_dir):
    """Minus the log of the 10th distance, floored."""
    return fd.log_density(nb.knn(points(spark, sf_dir), 10, "hd"), 10, 1e-4)


_K16 = f"WITH {P}, {HD}, e AS (SELECT src, dst, dist FROM hd WHERE rank BETWEEN 1 AND 16 UNION ALL SELECT dst, src, dist FROM hd WHERE rank BETWEEN 1 AND 16)"


@query("knn_symmetric_graph", _K16 + " SELECT src, dst, round(max(dist), 6) + 0.0 AS w FROM e GROUP BY src, dst")
def knn_symmetric_graph(spark, sf_dir):
    """Weighted graph of 16 neighbours, both ways."""
    return nb.symmetric_graph(nb.knn(points(spark, sf_dir), 16, "hd"))


@query("knn_union_adjacency", _K16 + " SELECT DISTINCT src, dst FROM e")
def knn_union_adjacency(spark, sf_dir):
    """Unweighted graph, both ways."""
    return nb.union_adjacency(nb.knn(points(spark, sf_dir), 16, "hd"))


@query("ordinal_percentile_distortion", _RADII + ", q AS (SELECT src, (row_number() OVER (ORDER BY a, src) - 1) / count(*) OVER () AS pa, (row_number() OVER (ORDER BY b, src) - 1) / count(*) OVER () AS pb FROM m) SELECT src, round(pa, 6) + 0.0 AS hd_percentile, round(pb, 6) + 0.0 AS ld_percentile, round(log2((pb + 1e-6) / (pa + 1e-6)), 6) + 0.0 AS distortion FROM q")
def ordinal_percentile_distortion(spark, sf_dir):
    """Log ratio of radius percentiles, a point each."""
    _, hd, ld = _both(spark, sf_dir, 15)
    both = fd.radius_percentiles(hd, "hd_percentile").join(fd.radius_percentiles(ld, "ld_percentile"), "src")
    return both.withColumn("distortion", log_ratio(F.col("ld_percentile"), F.col("hd_percentile")))


# ---------------------------------------------------------------- samples
@query("hash_subsample", "SELECT vec_id AS id FROM embeddings ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id LIMIT 100")
def hash_subsample(spark, sf_dir):
    """A seeded sample of 100 points; the size is the operator's parameter."""
    return sm.subsample(points(spark, sf_dir).select("id"), "id", 100)


@query("stratified_sample", f"WITH {P}, q AS (SELECT label, (100 // count(*) OVER ()) + (row_number() OVER (ORDER BY label) - 1 < 100 % count(*) OVER ())::INT AS quota FROM (SELECT DISTINCT label FROM p)) SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(id::VARCHAR || ':42'), id) AS r FROM p) JOIN q USING (label) WHERE r <= quota")
def stratified_sample(spark, sf_dir):
    """A seeded sample of 100 points with equal shares of labels."""
    return sm.stratified(points(spark, sf_dir).select("id", "label"), "id", "label", 100)


@query("fixed_size_batches", f"WITH {P}, b AS (SELECT id, (row_number() OVER (ORDER BY md5(id::VARCHAR || ':42'), id) - 1) // 64 AS batch, count(*) OVER () // 64 AS full_ones FROM p) SELECT id, batch FROM b WHERE batch < full_ones")
def fixed_size_batches(spark, sf_dir):
    """Shuffled batches of 64, the short last one dropped."""
    return sm.batches(points(spark, sf_dir).select("id"), "id", 64)


def _draw(k: int, n: str = "(SELECT count(*) FROM p)") -> str:
    return f"('0x' || substr(md5(t::VARCHAR || ':{k}:42'), 1, 7))::BIGINT % {n}"


_POS = "pos AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, id, hd, ld, label FROM p)"
_PAIRS = f"WITH {P}, {_POS}, g AS (SELECT range AS t FROM range(5000)), dr AS (SELECT t, {_draw(0)} AS p0, {_draw(1)} AS p1 FROM g), pr AS (SELECT t, a.id AS i0, b.id AS i1, list_distance(a.hd, b.hd) AS dh, list_distance(a.ld, b.ld) AS dl FROM dr JOIN pos a ON a.pos = p0 JOIN pos b ON b.pos = p1 WHERE p0 <> p1)"


def _tuples(spark, sf_dir, count: int, width: int) -> tuple[DataFrame, DataFrame]:
    pts = points(spark, sf_dir)
    drawn = sm.random_tuples(spark, sm.with_position(pts, "id"), count, width)
    for k in range(width):
        drawn = drawn.join(pts.select(F.col("id").alias(f"i{k}"), F.col("hd").alias(f"h{k}"), F.col("ld").alias(f"l{k}")), f"i{k}")
    return pts, drawn


@query("random_pairs", _PAIRS + " SELECT t, i0, i1 FROM pr")
def random_pairs(spark, sf_dir):
    """5,000 seeded pairs of distinct points."""
    return _tuples(spark, sf_dir, 5000, 2)[1].select("t", "i0", "i1")


@query("shepard_spearman", _PAIRS + f" SELECT round(corr(ra, rb), 6) + 0.0 AS shepard FROM (SELECT {_avg_rank('dh')} AS ra, {_avg_rank('dl')} AS rb FROM pr)")
def shepard_spearman(spark, sf_dir):
    """Spearman's correlation of sampled pair distances."""
    from ..functions.ranks import spearman

    pairs = _tuples(spark, sf_dir, 5000, 2)[1].select(F.round(euclidean("h0", "h1"), 12).alias("a"), F.round(euclidean("l0", "l1"), 12).alias("b"))
    return spearman(pairs, "a", "b", "shepard")


@query("random_triplet_accuracy", f"WITH {P}, {_POS}, g AS (SELECT range AS t FROM range(10000)), dr AS (SELECT t, {_draw(0)} AS p0, {_draw(1)} AS p1, {_draw(2)} AS p2 FROM g) SELECT round(avg(((list_distance(a.hd, b.hd) < list_distance(a.hd, c.hd)) = (list_distance(a.ld, b.ld) < list_distance(a.ld, c.ld)))::INT), 6) + 0.0 AS triplet_accuracy FROM dr JOIN pos a ON a.pos = p0 JOIN pos b ON b.pos = p1 JOIN pos c ON c.pos = p2 WHERE p0 <> p1 AND p1 <> p2 AND p0 <> p2")
def random_triplet_accuracy(spark, sf_dir):
    """Agreement on which of two points is nearer, over seeded triplets."""
    t = _tuples(spark, sf_dir, 10000, 3)[1]
    same = (euclidean("h0", "h1") < euclidean("h0", "h2")) == (euclidean("l0", "l1") < euclidean("l0", "l2"))
    return t.agg(F.avg(same.cast("double")).alias("triplet_accuracy"))
