"""Approximate neighbour join: references in cells around sampled centres, queries in the cells nearest to them.

Centres are a bounded sample of references, by hash; every reference is indexed in the cell of its nearest centre, every
query looks into ``probes`` cells, and what it finds there is compared exactly. How many probes reach the wanted recall is
measured on SAMPLE queries, whose exact neighbours are worked out. A crowded cell is dealt by hash into parts
of bounded size, and its queries look into all of them, so no task holds more, however many points one cell has.
:func:`neighbours.nearest` is the exact way; :func:`recall` measures one against the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import bounded, settle
from . import neighbours as nb
from .sampling import subsample

#: Most centres, which go to every task: 4,096 of 1,024 numbers are 32 MB.
MOST_CENTRES = 4096
#: Queries on which the number of probes is fitted, and the recall that it aims at there.
SAMPLE, RECALL = 200, 0.95


def _cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, v, cell): each row with its ``probes`` nearest centres, one row each."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        norms = (c * c).sum(1)
        for b in batches:
            a = nb._matrix(b["v"]) if len(b) else np.zeros((0, c.shape[1]))
            near = np.argpartition(norms[None, :] - 2.0 * (a @ c.T), min(probes, len(c)) - 1, axis=1)[:, :probes]
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "cells": near.astype(np.int32).tolist()})

    found = rows.select("id", "v").mapInPandas(run, "id long, v array<double>, cells array<int>")
    return found.select("id", "v", F.explode("cells").alias("cell"))


def fitted_probes(queries: DataFrame, refs: DataFrame, index: DataFrame, centres: np.ndarray, k: int, seed: int) -> int:
    """The fewest cells that hold the share RECALL of the exact neighbours of SAMPLE queries; at most SAMPLE k rows are collected."""
    some = settle(subsample(queries, "id", SAMPLE, seed), "sample")
    exact = nb.nearest(some, refs, k, "v").select("src", F.col("dst").alias("id")).join(index.select("id", "cell"), "id")
    rows = exact.join(some.select(F.col("id").alias("src"), "v"), "src").groupBy("src").agg(F.first("v").alias("v"), F.collect_list("cell").alias("cells")).collect()
    if not rows:
        return 1
    a = np.stack([np.asarray(r["v"]) for r in rows])
    order = np.argsort((centres * centres).sum(1)[None, :] - 2.0 * (a @ centres.T), axis=1)
    place = np.argsort(order, axis=1)
    needed = np.sort(np.concatenate([place[k, r["cells"]] for k, r in enumerate(rows)]))
    return int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)) - 1)]) + 1


def nearest(queries: DataFrame, refs: DataFrame, k: int, column: str, probes: int | None = None, centres: int | None = None, seed: int = 42) -> DataFrame:
    """(src, rank, dst, dist): about the k nearest references of each query from rank 0; distances are exact.

    By default there are sqrt(n) centres, and the number of probes is fitted. Rows without a place neither ask nor answer.
    """
    q, r = (nb.placed(t, column).select(F.col("id"), F.col(column).alias("v")) for t in (queries, refs))
    n = r.count()
    if not n:
        return nb.nearest(queries, refs, k, column)
    count = min(MOST_CENTRES, centres or max(1, math.isqrt(n)))
    middle = np.stack([np.asarray(x["v"]) for x in subsample(r, "id", count, seed).collect()])
    index = settle(_cells(r, middle, 1), "cells")
    probes = min(count, probes or fitted_probes(q, r, index, middle, k, seed))
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / nb.MOST).cast("int").alias("parts"))
    parts = bounded(parts, "parts")
    dealt = index.join(parts, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    asked = _cells(q, middle, probes).join(parts, "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"src": [], "dst": [], "dist": []}).astype({"src": "int64", "dst": "int64"})
        y = y.sort_values("id")
        ids, a, b = y["id"].to_numpy(), nb._matrix(x["v"]), nb._matrix(y["v"])
        m, out = min(k, len(b)), []
        step = max(1, nb.SLAB // len(b))
        for at in range(0, len(a), step):
            order, dist = nb._nearest_rows(a[at : at + step], b, m, None)
            out.append(pd.DataFrame({"src": np.repeat(x["id"].to_numpy()[at : at + step], m), "dst": ids[order].ravel(), "dist": dist.ravel()}))
        return pd.concat(out)

    best = asked.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(run, "src long, dst long, dist double")
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return best.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).where(F.col("rank") < k).select("src", "rank", "dst", "dist")


def knn(pts: DataFrame, k: int, column: str, **options) -> DataFrame:
    """(src, rank, dst, dist) of about the k nearest others, from rank 1; the first of k + 1 is dropped by place, as by the
    exact join: a point lies in the first cell that it looks into."""
    return nearest(pts, pts, k + 1, column, **options).where("rank > 0")


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the share of the exact neighbours that were found."""
    hit = exact.select("src", "dst").join(approximate.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
