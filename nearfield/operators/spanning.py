"""Least spanning trees and forests by Boruvka's rounds: the least edge out of each component, then contraction.

Each round at least halves the components that have an edge out. Edges are ordered by weight, then by their ends, so no two
are equal and the only circles that least edges make are two components that choose the same edge. Every round is a table in the
shared folder; mappings of components are broadcast only if they were counted to be few.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import bounded, settle
from . import neighbours as nb


def _roots(least: DataFrame) -> DataFrame:
    """(c, root) from the (c, to) that least edges join: pointers are followed, twice as far each time, to one of the two
    components at the end of each chain that point at each other, the lesser."""
    other = least.select(F.col("c").alias("to"), F.col("to").alias("back"))
    ends = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to"))
    roots = settle(least.join(other, "to").select("c", ends.alias("root")), "roots")
    while True:
        further = roots.select(F.col("c").alias("root"), F.col("root").alias("next"))
        after = settle(roots.join(further, "root").select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        if not after.where("moved").limit(1).count():
            return after.select("c", "root")
        roots = after.select("c", "root")


def _chosen(least: DataFrame) -> DataFrame:
    """The edges (u, v, w) of a round, each once."""
    return settle(least.select("u", "v", "w").distinct(), "chosen")


def least_forest(edges: DataFrame) -> DataFrame:
    """(u, v, w), u < v, of the least spanning forest of a graph of edges (u, v, w).

    Loops and edges with a null end, or a weight that is null or no number, are left out; of parallel edges the least counts.
    """
    ok = F.col("w").isNotNull() & ~F.isnan("w") & (F.col("u") != F.col("v"))
    pairs = edges.where(ok).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("w").cast("double").alias("w"))
    left = settle(pairs.groupBy("u", "v").agg(F.min("w").alias("w")).select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")), "edges")
    done = [left.limit(0).select("u", "v", "w")]
    while left.limit(1).count():
        out = left.select(F.col("a").alias("c"), "w", "u", "v", F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("c"), "w", "u", "v", F.col("a").alias("to")))
        least = settle(out.groupBy("c").agg(F.min(F.struct("w", "u", "v", "to")).alias("e")).select("c", "e.*"), "least")
        done.append(_chosen(least))
        roots = bounded(_roots(least), "roots")
        left = left.join(roots.select(F.col("c").alias("a"), F.col("root").alias("x")), "a").join(roots.select(F.col("c").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        left = left.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
        left = settle(left.select("e.u", "e.v", "e.w", "a", "b"), "edges")
    return reduce(DataFrame.unionByName, done)


def least_tree(points: DataFrame) -> DataFrame:
    """(u, v, w), u < v, of the least spanning tree of all pairs of points (id long, v array) by Euclidean distance.

    Each round, pairs of blocks of points find the nearest point of another component, and answer with the least edge of each
    component they hold; no table of pairs is made. Points with a null or a number that is not finite are left out.
    """
    finite = F.forall("v", lambda z: z.isNotNull() & (F.abs(z) < float("inf")))
    nodes = settle(points.where(F.col("v").isNotNull() & finite).select("id", F.col("v").cast("array<double>").alias("v"), F.col("id").alias("c")), "nodes")
    schema = "c long, w double, u long, v long, to long"

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            r = r.sort_values("id")
            ids, comps = r["id"].to_numpy(), r["c"].to_numpy()
            step = max(1, nb.SLAB // len(r))
            for at in range(0, len(q), step):
                part = q.iloc[at : at + step]
                d = nb.distances(part["v"], r["v"])
                own, names = part["c"].to_numpy(), part["id"].to_numpy()
                d[own[:, None] == comps[None, :]] = np.inf
                # ties by the ends of the edge, in order: of equal distances the pair that comes first
                low, high = np.minimum(names[:, None], ids[None, :]), np.maximum(names[:, None], ids[None, :])
                near = d.min(1)
                first = np.where(d == near[:, None], low, np.iinfo(np.int64).max).min(1)
                second = np.where((d == near[:, None]) & (low == first[:, None]), high, np.iinfo(np.int64).max)
                k = second.argmin(1)
                out.append(pd.DataFrame({"c": own, "w": near, "u": first, "v": second.min(1), "to": comps[k]})[np.isfinite(near)])
        best = pd.concat(out) if out else pd.DataFrame({"c": [], "w": [], "u": [], "v": [], "to": []})
        best = best.sort_values(["c", "w", "u", "v"]).drop_duplicates("c")
        return best.astype({"c": "int64", "w": "float64", "u": "int64", "v": "int64", "to": "int64"})

    done = [points.sparkSession.createDataFrame([], "u long, v long, w double")]
    while True:
        least = nb._in_blocks(nodes, nodes, run, schema, True).groupBy("c").agg(F.min(F.struct("w", "u", "v", "to")).alias("e"))
        least = settle(least.select("c", "e.*"), "least")
        if not least.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        done.append(_chosen(least))
        roots = bounded(_roots(least), "roots")
        nodes = settle(nodes.join(roots, "c").select("id", "v", F.col("root").alias("c")), "nodes")
