"""Registered queries over quadtrees and spanning trees, with their DuckDB counterparts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import neighbours as nb
from ..operators import inference, metric_cells, spanning, treeforces
from ..operators.points import points
from ..sources import recipes
from .neighbour_plans import HD, P
from .register import registry

QUERIES, ORACLES, query = registry()

_P = "p AS (SELECT vec_id AS id, (embedding::DOUBLE[])[1] AS x, (embedding::DOUBLE[])[2] AS y FROM embeddings)"


def _places(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.get("ld", F.lit(0)).alias("x"), F.get("ld", F.lit(1)).alias("y"))


@query("repulsion_all_pairs", f"WITH {_P}, d AS (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy, 1 / (1 + (a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS q FROM p a JOIN p b ON a.id <> b.id) SELECT id, round(sum(q * q * dx), 6) + 0.0 AS fx, round(sum(q * q * dy), 6) + 0.0 AS fy, round(sum(q), 6) + 0.0 AS z FROM d GROUP BY id")
def repulsion_all_pairs(spark, sf_dir):
    """Repulsive forces and their sum by the tree with an opening angle of 0: those of all pairs."""
    return treeforces.tree_forces(_places(spark, sf_dir), 0.0).select("id", "fx", "fy", "z")


@query("repulsion_tree")
def repulsion_tree(spark, sf_dir):
    """Repulsive forces and their sum by the tree with an opening angle of 0.5, and how much each point asked."""
    return treeforces.tree_forces(_places(spark, sf_dir), 0.5)


@query("spanning_forest_knn")
def spanning_forest_knn(spark, sf_dir):
    """The least spanning forest of the graph of the 15 nearest neighbours."""
    return spanning.least_forest(nb.knn(points(spark, sf_dir), 15, "hd").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("dist").alias("w")))


@query("knn_pivot_cells", f"WITH {P}, {HD} SELECT src, rank::INTEGER AS rank, dst, round(dist, 6) + 0.0 AS dist FROM hd WHERE rank BETWEEN 1 AND 12")
def knn_pivot_cells(spark, sf_dir):
    """Twelve nearest neighbours by cells around pivots, pruned by the triangle inequality."""
    return metric_cells.knn(points(spark, sf_dir), 12, "hd")


@query("pivot_cells_compared")
def pivot_cells_compared(spark, sf_dir):
    """How many distances that took in the picture, whose points lie closer, of all there are."""
    pts = points(spark, sf_dir)
    return metric_cells.nearest(pts, pts, 13, "ld")[1]


def _rule(rows: int, columns: int, a: int, b: int) -> np.ndarray:
    """Weights by a rule that SQL can repeat."""
    return (((np.arange(rows)[:, None] * a + np.arange(columns)[None, :] * b) % 11) - 5) / 10.0


_DOT = "list_sum(list_transform(range({n}), lambda i: {v}[i + 1] * (((i * {a} + {j} * {b}) % 11) - 5) / 10.0))"


@query("layer_outputs", "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT id, list_transform(range(8), lambda j: " + _DOT.format(n=64, v="v", a=7, j="j", b=3) + " + j / 10.0) AS v FROM e), b AS (SELECT id, list_transform(range(2), lambda j: " + _DOT.format(n=8, v="v", a=5, j="j", b=2) + ") AS v FROM a) SELECT id, 0::INTEGER AS layer, round(v[1], 6) + 0.0 AS first, round(v[-1], 6) + 0.0 AS last FROM a UNION ALL SELECT id, 1::INTEGER, round(v[1], 6) + 0.0, round(v[-1], 6) + 0.0 FROM b")
def layer_outputs(spark, sf_dir):
    """Both layers of a linear model over the embeddings: first and last value of each output."""
    layers = [inference.Layer(_rule(64, 8, 7, 3), np.arange(8) / 10.0), inference.Layer(_rule(8, 2, 5, 2), np.zeros(2))]
    out = inference.layer_outputs(points(spark, sf_dir), "hd", layers, [0, 1])
    return out.select("id", "layer", F.get("v", F.lit(0)).alias("first"), F.element_at("v", -1).alias("last"))


@query("recipe_knn", f"WITH {P}, {HD} SELECT src, rank::INTEGER AS rank, dst, round(dist, 6) + 0.0 AS dist FROM hd WHERE rank BETWEEN 1 AND 12")
def recipe_knn(spark, sf_dir):
    """Twelve nearest neighbours, from configuration."""
    return recipes.run(spark, sf_dir, "source: {name: points}\nsteps:\n  - {name: finite, args: {features: hd}}\n  - {name: knn, args: {k: 12, column: hd}}")


@query("recipe_prepared", f"WITH {P}, c AS (SELECT label FROM p GROUP BY label HAVING count(*) >= 5), k AS (SELECT * FROM p WHERE label IN (SELECT label FROM c)), m AS (SELECT min(hd[1]) AS a, max(hd[1]) AS b, min(hd[64]) AS c, max(hd[64]) AS d FROM k) SELECT id, round((hd[1] - a) / (b - a), 6) + 0.0 AS first, round((hd[64] - c) / (d - c), 6) + 0.0 AS last FROM k, m")
def recipe_prepared(spark, sf_dir):
    """Points without rare classes, scaled by feature and padded to an even width, from configuration."""
    recipe = "source: {name: points}\nsteps:\n  - {name: finite, args: {features: hd}}\n  - {name: drop_rare, args: {label: label, least: 5}}\n  - {name: min_max, args: {features: hd}}\n  - {name: pad_even, args: {features: hd}}"
    return recipes.run(spark, sf_dir, recipe).select("id", F.get("hd", F.lit(0)).alias("first"), F.get("hd", F.lit(63)).alias("last"))
