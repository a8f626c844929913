"""Exact nearest neighbours by cells around pivots, pruned by the triangle inequality.

Pivots are a bounded sample of the references; each reference lies in the cell of its nearest pivot, and a cell knows its
covering radius, the greatest distance of its references to the pivot. A query first looks into the nearest cells that hold
enough references together: its k-th distance there bounds what it still needs. Then it looks into every other cell that might
hold something nearer, which is one whose pivot is no farther than the radius and that distance, and no cell else. So the rows are
those of :func:`neighbours.nearest`; on clustered data most pairs of queries and cells are skipped, on data without
clusters few, and then that join is cheaper. A crowded cell is dealt by hash into parts of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import bounded, settle
from . import neighbours as nb
from .approximate import MOST_CENTRES
from .sampling import subsample

#: By how much rounding may change a distance, as a share of the greatest number at hand.
SLACK = 1e-9


def _cell_of(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, far): each row with its nearest pivot and the distance to it."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                d = nb._distances(nb._matrix(part["v"]), sent.value)
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "cell": d.argmin(1).astype(np.int32), "far": d.min(1)})

    return rows.mapInPandas(run, "id long, v array<double>, cell int, far double")


def _asked(queries: DataFrame, pivots: np.ndarray, size: np.ndarray, k: int) -> DataFrame:
    """(id, v, cells): the cells a query looks into first: the nearest ones with k references."""
    sent = queries.sparkSession.sparkContext.broadcast((pivots, size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, n = sent.value
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                d = nb._distances(nb._matrix(part["v"]), p)
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.empty(d.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "cells": [np.flatnonzero(f & (n > 0)).astype(np.int32) for f in first]})

    return queries.mapInPandas(run, "id long, v array<double>, cells array<int>")


def _rest(queries: DataFrame, index: DataFrame, pivots: np.ndarray, radius: np.ndarray, k: int) -> DataFrame:
    """(src, dst, dist, compared): the k nearest of all other cells that may hold something within a query's ``limit``; its count is in
    a row without dst.

    All cells stream past each block of queries, and each query's look is decided there: a row for each query and cell that it
    looks into would be the square of the points where few cells can be left out.
    """
    sent = queries.sparkSession.sparkContext.broadcast((pivots, radius))

    def run(block: pa.Table, rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        (p, r), v, limit = sent.value, nb._plain(block["v"]), block["limit"].to_numpy()
        sizes, flat = (block["cells"].combine_chunks(), block["cells"].combine_chunks().flatten().to_numpy())
        sizes = np.diff(sizes.offsets.to_numpy())
        first = np.full((len(v), sizes.max(initial=1)), -1)
        first[np.arange(first.shape[1])[None, :] < sizes[:, None]] = flat
        best, compared = nb._Best(v, k, limit * (1 + SLACK)), np.zeros(len(v), np.int64)
        for ids, b, cell in rows:
            ends = [*(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
            for at, end in zip([0, *ends], ends):
                c = cell[at]
                d = nb._distances(v, p[c : c + 1])[:, 0]
                look = (d - r[c] <= limit + SLACK * (d + r[c])) & (first != c).all(1)
                if look.any():
                    best.add(ids[at:end], b[at:end], None if look.all() else np.flatnonzero(look))
                    compared[look] += end - at
        src = block["id"].to_numpy()
        for x in best.rows(src):
            yield pa.RecordBatch.from_arrays([x.column("src"), x.column("dst"), x.column("dist"), pa.array(np.zeros(len(x), np.int64))], ["src", "dst", "dist", "compared"])
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.nulls(len(src), pa.int64()), pa.nulls(len(src), pa.float64()), pa.array(compared)], ["src", "dst", "dist", "compared"])

    return nb._past(queries, index.select("id", "v", "cell"), run, "src long, dst long, dist double, compared long", most=max(1, min(nb.MOST, nb.BEST // (16 * (2 * k + 32)))), cells=True)[0]


def _search(asked: DataFrame, dealt: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(src, dst, dist, compared): the k nearest of each part that a query looks into."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"src": [], "dst": [], "dist": [], "compared": []}).astype({"src": "int64", "dst": "int64", "compared": "int64"})]
        if len(x) and len(y):
            y = y.sort_values("id")
            ids, a, b = y["id"].to_numpy(), nb._matrix(x["v"]), nb._matrix(y["v"])
            m = min(k, len(b))
            step = max(1, nb.SLAB // len(b))
            for at in range(0, len(a), step):
                order, dist = nb._nearest_rows(a[at : at + step], b, m, None)
                rows = pd.DataFrame({"src": np.repeat(x["id"].to_numpy()[at : at + step], m), "dst": ids[order].ravel(), "dist": dist.ravel(), "compared": np.tile(np.where(np.arange(m) == 0, len(b), 0), len(order))})
                out.append(rows)
        return pd.concat(out)

    dealt_to = asked.join(parts, "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt_to.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(run, "src long, dst long, dist double, compared long")


def nearest(queries: DataFrame, refs: DataFrame, k: int, column: str, pivots: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((src, rank, dst, dist), (n, compared, share)): the k nearest references of each query from rank 0, ties to the lesser
    id, and how many distances were compared, of all there are. Rows without a place neither ask nor answer."""
    q, r = (nb.placed(t, column).select("id", F.col(column).cast("array<double>").alias("v")) for t in (queries, refs))
    n = r.count()
    if not n:
        return nb.nearest(q, r, k, "v"), q.sparkSession.createDataFrame([(0, 0, 0.0)], "n long, compared long, share double")
    count = min(MOST_CENTRES, pivots or max(1, math.isqrt(n)))
    middle = np.stack([np.asarray(x["v"]) for x in subsample(r, "id", count, seed).collect()])
    index = settle(_cell_of(r, middle), "cells")
    cells = index.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.ceil(F.count("*") / nb.MOST).cast("int").alias("parts"))
    cells = settle(cells, "radii")
    radius, size = np.zeros(len(middle)), np.zeros(len(middle), np.int64)
    for row in cells.collect():  # MOST_CENTRES at most
        radius[row["cell"]], size[row["cell"]] = row["radius"], row["n"]
    parts = bounded(cells.select("cell", "parts"), "parts")
    dealt = index.join(parts, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))

    order = Window.partitionBy("src").orderBy("dist", "dst")
    asked = settle(_asked(q, middle, size, k), "asked")
    near = settle(_search(asked.select("id", "v", F.explode("cells").alias("cell")), dealt, parts, k), "near")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    limits = best.groupBy("src").agg(F.when(F.count("*") == k, F.max("dist")).otherwise(float("inf")).alias("limit"))
    tied = settle(asked.join(limits, F.col("id") == F.col("src")).select("id", "v", "limit", "cells"), "limits")
    rest = settle(_rest(tied, index, middle, radius, k), "rest")
    both = near.unionByName(rest)
    compared = both.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared")).join(q.agg(F.count("*").alias("n")))
    compared = compared.select("n", "compared", (F.col("compared") / (F.col("n") * F.lit(n))).alias("share"))
    rows = both.where("dst is not null").withColumn("rank", (F.row_number().over(order) - 1).cast("int")).where(F.col("rank") < k)
    return rows.select("src", "rank", "dst", "dist"), compared


def knn(pts: DataFrame, k: int, column: str, **options) -> DataFrame:
    """(src, rank, dst, dist) of the k nearest others, from rank 1; the first of k + 1, the point itself, is dropped by place."""
    return nearest(pts, pts, k + 1, column, **options)[0].where("rank > 0")
