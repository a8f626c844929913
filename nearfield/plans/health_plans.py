"""Registered queries of run health, lineages and classes, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import health, lineage
from ..operators.points import lineage_cells, points, read
from .register import registry

QUERIES, ORACLES, query = registry()

XY = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"
RATIO = "sqrt(greatest((var_pop(x) + var_pop(y)) / 2 - sqrt(((var_pop(x) - var_pop(y)) / 2) ** 2 + covar_pop(x, y) ** 2), 0)) / greatest(sqrt((var_pop(x) + var_pop(y)) / 2 + sqrt(((var_pop(x) - var_pop(y)) / 2) ** 2 + covar_pop(x, y) ** 2)), 1e-12)"
CELLS = "cells AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, price / 10000 AS y, r_name AS f, n_name AS t, date_diff('day', DATE '1992-01-01', first_day::DATE)::DOUBLE AS time FROM customer JOIN (SELECT o_custkey, avg(o_totalprice) AS price, min(o_orderdate) AS first_day FROM orders GROUP BY 1) ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SERIES = "s AS (SELECT event_type AS name, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch, avg(value) AS value FROM events GROUP BY 1, 2)"


def xy(spark, sf_dir: str) -> DataFrame:
    """id, x, y and label of the picture."""
    return points(spark, sf_dir).select("id", F.get("ld", F.lit(0)).alias("x"), F.get("ld", F.lit(1)).alias("y"), "label")


def series(spark, sf_dir: str) -> DataFrame:
    """Daily means of each event type as a loss series."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.datediff("ts", F.lit("2024-01-01")).alias("epoch"), "value")
    return health.epoch_means(events)


@query("embedding_health", f"WITH {XY}, n AS (SELECT *, sqrt(x * x + y * y) AS norm FROM p), k AS (SELECT * FROM n QUALIFY row_number() OVER (ORDER BY norm DESC, id DESC) > ceil(0.001 * count(*) OVER ())), a AS (SELECT least(stddev_pop(x), stddev_pop(y)) AS std_min, {RATIO} AS axis_ratio, quantile_cont(norm, 0.5) AS norm_median, max(norm) AS norm_max FROM n), b AS (SELECT {RATIO} AS trimmed FROM k) SELECT 0.0::DOUBLE AS nonfinite_fraction, round(std_min, 6) + 0.0 AS std_min, round(axis_ratio, 6) + 0.0 AS axis_ratio, round(trimmed, 6) + 0.0 AS axis_ratio_trimmed, round(norm_median, 6) + 0.0 AS norm_median, round(norm_max, 6) + 0.0 AS norm_max, round(norm_max / norm_median, 6) + 0.0 AS norm_max_median_ratio, (std_min < 1e-6 OR axis_ratio < 5e-2)::INT::DOUBLE AS near_line, (std_min < 1e-6 OR axis_ratio < 1e-3)::INT::DOUBLE AS collapsed FROM a, b")
def embedding_health(spark, sf_dir):
    """Collapse and spread of the picture."""
    return health.embedding_health(xy(spark, sf_dir))


@query("raw_diagnostics", f"WITH {XY}, a AS (SELECT stddev_pop(x) AS std_x, stddev_pop(y) AS std_y, sqrt((var_pop(x) + var_pop(y)) / 2) AS g, {RATIO} AS axis_ratio FROM p) SELECT round(std_x, 6) + 0.0 AS std_x, round(std_y, 6) + 0.0 AS std_y, round(g, 6) + 0.0 AS global_rms, round(axis_ratio, 6) + 0.0 AS axis_ratio, round(least(std_x, std_y) / greatest(std_x, std_y), 6) + 0.0 AS std_ratio, (axis_ratio < 5e-2)::INT::DOUBLE AS near_line FROM a")
def raw_diagnostics(spark, sf_dir):
    """Deviations and axis ratio of the picture."""
    return health.raw_diagnostics(xy(spark, sf_dir))


_STABLE = "d AS (SELECT name, epoch, value - lag(value) OVER (PARTITION BY name ORDER BY epoch) AS step FROM {src}), m AS (SELECT name, sign(step) <> lag(sign(step)) OVER (PARTITION BY name ORDER BY epoch) AS turn FROM d WHERE abs(step) > 1e-12), c AS (SELECT name, coalesce(avg(turn::INT), 0) AS r FROM m GROUP BY name), a AS (SELECT name, stddev_pop(value) / greatest(avg(abs(value)), 1e-12) AS cv, max(abs(value)) / greatest(quantile_cont(abs(value), 0.5), 1e-12) AS spike FROM {src} GROUP BY name)"


@query("loss_stability", f"WITH {SERIES}, {_STABLE.format(src='s')} SELECT name, round(cv, 6) + 0.0 AS tail_cv, round(coalesce(r, 0), 6) + 0.0 AS direction_change_rate, round(spike, 6) + 0.0 AS spike_ratio, (cv >= 0.25 AND coalesce(r, 0) >= 0.5) OR spike >= 3 AS oscillation_detected FROM a LEFT JOIN c USING (name)")
def loss_stability(spark, sf_dir):
    """Variation and turns of each series."""
    return health.loss_stability(series(spark, sf_dir))


@query("epoch_means", f"WITH {SERIES} SELECT name, epoch, round(value, 6) + 0.0 AS value FROM s")
def epoch_means(spark, sf_dir):
    """Daily mean of each event type."""
    return series(spark, sf_dir)


@query("final_status", f"WITH {SERIES}, t AS (SELECT name, epoch, value FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY epoch DESC) <= 10), {_STABLE.format(src='t')}, l AS (SELECT name, max_by(value, epoch) AS last FROM s GROUP BY name), o AS (SELECT name, cv, coalesce(r, 0) AS r, spike, (cv >= 0.25 AND coalesce(r, 0) >= 0.5) OR spike >= 3 AS osc FROM a LEFT JOIN c USING (name)) SELECT name, round(last, 6) + 0.0 AS last_value, round(cv, 6) + 0.0 AS tail_cv, round(r, 6) + 0.0 AS direction_change_rate, round(spike, 6) + 0.0 AS spike_ratio, osc AS oscillation_detected, bool_or(osc) OVER () AS any_oscillation FROM o JOIN l USING (name)")
def final_status(spark, sf_dir):
    """Last values and stability of the last ten days."""
    return health.final_status(series(spark, sf_dir), 10)


@query("epoch_time_stats", "WITH e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, value FROM events) SELECT run, round(avg(value), 6) + 0.0 AS mean_seconds, round(quantile_cont(value, 0.5), 6) + 0.0 AS median_seconds, round(stddev_samp(value), 6) + 0.0 AS std_seconds, round(coalesce(avg(value) FILTER (r > 5), avg(value)), 6) + 0.0 AS steady_seconds FROM e GROUP BY run")
def epoch_time_stats(spark, sf_dir):
    """Run times by user, their first five events set apart."""
    return health.epoch_times(read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("seconds")))


@query("capacity_band", "SELECT p_brand AS model, sum(p_size)::BIGINT AS parameters, round(sum(p_size) / 1000.0, 6) + 0.0 AS ratio, sum(p_size) / 1000.0 BETWEEN 0.5 AND 2.0 AS in_band FROM part GROUP BY p_brand")
def capacity_band(spark, sf_dir):
    """Parameters by model against a baseline of 1,000."""
    return health.capacity(read(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_size").alias("numel")), 1000)


@query("lineage_edges", f'WITH {CELLS} SELECT DISTINCT f AS "from", t AS "to" FROM cells')
def lineage_edges(spark, sf_dir):
    """Edges between regions and nations."""
    return lineage.lineage_edges(lineage_cells(spark, sf_dir))


_INC = "i AS (SELECT id, x, y, f AS node FROM cells UNION ALL SELECT id, x, y, t FROM cells WHERE t <> f)"


@query("node_centroids", f"WITH {CELLS}, {_INC} SELECT node, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, count(*) AS n FROM i GROUP BY node HAVING count(*) >= 10")
def node_centroids(spark, sf_dir):
    """Mean place of each node's cells."""
    return lineage.node_centroids(lineage_cells(spark, sf_dir))


@query("node_roles", f"WITH {CELLS}, e AS (SELECT DISTINCT f, t FROM cells), o AS (SELECT f AS node, count(*) AS outdegree FROM e GROUP BY f), n AS (SELECT t AS node, count(*) AS indegree FROM e GROUP BY t) SELECT node, coalesce(indegree, 0) AS indegree, coalesce(outdegree, 0) AS outdegree, CASE WHEN coalesce(indegree, 0) = 0 THEN 'root' WHEN coalesce(outdegree, 0) = 0 THEN 'terminal' WHEN outdegree > 1 THEN 'branchpoint' ELSE 'internal' END AS role FROM o FULL JOIN n USING (node)")
def node_roles(spark, sf_dir):
    """Roles of nodes by degree."""
    return lineage.node_roles(lineage.lineage_edges(lineage_cells(spark, sf_dir)))


@query("medoid", f"WITH {CELLS}, m AS (SELECT t, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM cells GROUP BY t), r AS (SELECT cells.t, id, x, y, row_number() OVER (PARTITION BY cells.t ORDER BY (x - mx) ** 2 + (y - my) ** 2, id) AS k FROM cells JOIN m USING (t)) SELECT t AS \"to\", id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM r WHERE k = 1")
def medoid(spark, sf_dir):
    """The cell nearest to the median of each nation."""
    return lineage.medoids(lineage_cells(spark, sf_dir), "to")


@query("branch_monotonicity", f"WITH {CELLS}, a AS (SELECT f, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, count(*) AS n FROM cells GROUP BY f HAVING count(*) >= 20 AND count(DISTINCT time) > 1), v AS (SELECT *, (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy ** 2) - yy AS ax, xy AS ay FROM a), pl AS (SELECT cells.f, n, time, round(((x - mx) * ax + (y - my) * ay) / sqrt(ax ** 2 + ay ** 2), 9) AS place FROM cells JOIN v USING (f)), r AS (SELECT f, n, rank() OVER (PARTITION BY f ORDER BY time) + (count(*) OVER (PARTITION BY f, time) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY f ORDER BY place) + (count(*) OVER (PARTITION BY f, place) - 1) / 2.0 AS rp FROM pl), e AS (SELECT f, abs(corr(rt, rp)) AS r, any_value(n) AS n FROM r GROUP BY f) SELECT round(sum(r * n) / sum(n), 6) + 0.0 AS branch_monotonicity FROM e")
def branch_monotonicity(spark, sf_dir):
    """How far time follows the main axis of each region."""
    return lineage.branch_monotonicity(lineage_cells(spark, sf_dir), "from")


@query("fate_recovery", f"WITH {CELLS}, tm AS (SELECT t AS terminal, avg(x) AS tx, avg(y) AS ty FROM cells GROUP BY t HAVING count(*) >= 10), d AS (SELECT id, terminal, sqrt((x - tx) ** 2 + (y - ty) ** 2) AS d, (t = terminal)::INT::DOUBLE AS p FROM cells, tm), w AS (SELECT *, exp(-d / (SELECT quantile_cont(d, 0.5) FROM d)) AS w FROM d), q AS (SELECT terminal, p, w / sum(w) OVER (PARTITION BY id) AS q FROM w), r AS (SELECT corr(p, q) AS r FROM q GROUP BY terminal HAVING count(*) > 10 AND stddev_pop(p) > 0 AND stddev_pop(q) > 0) SELECT round(avg(r), 6) + 0.0 AS fate_corr FROM r")
def fate_recovery(spark, sf_dir):
    """Nations recovered from distance to their centroid."""
    cells = lineage_cells(spark, sf_dir)
    ends = lineage.node_centroids(cells.withColumn("from", F.col("to")))
    probs = cells.select("id", "to").join(F.broadcast(ends.select(F.col("node").alias("terminal")))).select("id", "terminal", (F.col("to") == F.col("terminal")).cast("double").alias("p"))
    return lineage.fate_recovery(cells, probs, ends)


@query("fate_argmax", "WITH s AS (SELECT user_id, event_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY 1, 2), b AS (SELECT user_id, event_type, p, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS k FROM s) SELECT user_id, CASE WHEN p < 0.3 THEN 'uncommitted' ELSE event_type END AS fate, round(p, 6) + 0.0 AS p FROM b WHERE k = 1")
def fate_argmax(spark, sf_dir):
    """Each user's most frequent event type; under 0.3, none."""
    each = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = each.groupBy("user_id").agg(F.sum("n").alias("all"), F.min_by(F.struct("event_type", "n"), F.struct(-F.col("n"), "event_type")).alias("m"))
    p = F.col("m.n") / F.col("all")
    return top.select("user_id", F.when(p < 0.3, "uncommitted").otherwise(F.col("m.event_type")).alias("fate"), p.alias("p"))


@query("class_mean_pairwise", f"WITH {XY} SELECT a.label, round(avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) + 0.0 AS spread FROM p a JOIN p b ON a.label = b.label AND a.id < b.id GROUP BY a.label")
def class_mean_pairwise(spark, sf_dir):
    """Mean distance of pairs within each class."""
    return lineage.mean_pairwise(points(spark, sf_dir), "label", "ld")


@query("class_spread_recovery")
def class_spread_recovery(spark, sf_dir):
    """Hull areas and spreads of classes against their spread in the data."""
    return lineage.class_spread_recovery(points(spark, sf_dir), "label")


@query("hull_area")
def hull_area(spark, sf_dir):
    """Trimmed convex-hull area of each class."""
    return lineage.hull_areas(xy(spark, sf_dir), "label")
