"""Repulsive forces of a picture's points by a quadtree that is a table, level by level.

All points push each other off by (1 / (1 + d2))^2 times their difference; the sum of 1 / (1 + d2) normalises. Far points act
through their cells: a cell of the quadtree acts as one mass at its centre if its width over the distance of that centre is
less than ``theta``; else its four parts are asked, and in a cell with few points these themselves.

The tree is a table (level, ix, iy, n, cx, cy, leaf), each level summed up from the one below. The walk is a table, too: the rows
(point, cell) that are open at a level are joined with the cells of that level, and end there, at once or with the points of
a leaf, or go on to the level below as the cell's parts. So a point meets a bounded number of cells at each level, and the work is
n log n; cells of a level are broadcast only if they were counted to be few, and no cell of the levels with many has many open rows.

With ``theta`` 0 no cell is ever far, and the walk would list all pairs as rows; then pairs of blocks of places answer with
sums, and no pair is a row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import BROADCAST_ROWS, settle
from . import neighbours as nb

#: Points of a cell that is not parted, and the level whose cells never are.
LEAF, DEEPEST = 8, 24


def _placed(points: DataFrame) -> tuple[DataFrame, float]:
    """Points with finite places, each with its mass and its cell at the deepest level, and the width of the whole square.

    Points of one place are one row whose mass is their number.
    """
    finite = F.col("x").between(-1.7e308, 1.7e308) & F.col("y").between(-1.7e308, 1.7e308)
    rows = points.where(finite).groupBy((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(F.count("*").alias("n"))
    ends = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None:
        return settle(rows.select("x", "y", "n", F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy")), "places"), 1.0
    width = max(ends[1] - ends[0], ends[3] - ends[2]) or 1.0
    cell = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(width) * F.lit(float(1 << DEEPEST))), F.lit((1 << DEEPEST) - 1)).cast("long")
    # dealt over all cores, however few bytes they are: each level's walk is read from the files of the one before it
    dealt = rows.select("x", "y", "n", cell("x", ends[0]).alias("ix"), cell("y", ends[2]).alias("iy")).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "x", "y")
    return settle(dealt, "places"), width


def tree(places: DataFrame) -> list[DataFrame]:
    """The cells (ix, iy, n, places, sx, sy) of each level, from the whole square on, as far as any holds more than LEAF places."""
    cell = lambda level: [F.shiftright(c, DEEPEST - level).alias(c) for c in ("ix", "iy")]
    low, high = 0, DEEPEST  # the first level of small cells only: cells of a lower level are parts of those of a higher one
    while low < high:
        level = (low + high) // 2
        most = places.groupBy(*cell(level)).count().agg(F.max("count")).first()[0] or 0
        low, high = (low, level) if most <= LEAF else (level + 1, high)
    sums = [F.sum("n").alias("n"), F.count("*").alias("places"), F.sum(F.col("x") * F.col("n")).alias("sx"), F.sum(F.col("y") * F.col("n")).alias("sy")]
    levels = [settle(places.groupBy(*cell(low)).agg(*sums), "cells")]
    for _ in range(low):
        up = levels[-1].groupBy(F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy"))
        levels.append(settle(up.agg(*[F.sum(c).alias(c) for c in ("n", "places", "sx", "sy")]), "cells"))
    return levels[::-1]


def tree_forces(points: DataFrame, theta: float = 0.5) -> DataFrame:
    """(id, fx, fy, z, asked): the repulsive force on each point, its part of the normalising sum, and the cells and points asked.

    ``points`` has id, x and y. Rows whose place is null or not finite are left out. Other points of the same place add 1 to z
    and no force; with ``theta`` 0 all points are asked, and the result is that of all pairs. Tables without rows give none.
    """
    places, width = _placed(points)
    if theta <= 0:
        return _at_points(points, _all_pairs(places))
    levels = tree(places)
    deep = len(levels) - 1
    # places of one cell of the deepest level used; those of leaves above it are found by the same shift
    at = lambda c, level: F.shiftright(c, DEEPEST - level)
    few = places.count() <= BROADCAST_ROWS
    open_ = places.select("x", "y", F.col("ix").alias("px"), F.col("iy").alias("py"), F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy"))
    parts: list[DataFrame] = []
    for level, cells in enumerate(levels):
        known = cells.select("ix", "iy", F.col("n").alias("mass"), "places", (F.col("sx") / F.col("n")).alias("cx"), (F.col("sy") / F.col("n")).alias("cy"))
        met = open_.join(F.broadcast(known) if few or 4**level <= BROADCAST_ROWS else known, ["ix", "iy"])
        own = (at("px", level) == F.col("ix")) & (at("py", level) == F.col("iy"))
        d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
        far = ~own & (F.lit(width / (1 << level)) < F.lit(float(theta)) * F.sqrt(d2))
        leaf = (F.col("places") <= LEAF) | F.lit(level == deep)
        met = settle(met.select("*", F.when(far, "far").when(leaf, "near").otherwise("open").alias("way")), "walk")

        q = 1.0 / (1.0 + d2)
        parts.append(_summed(met.where("way = 'far'").select("x", "y", (F.col("mass") * q).alias("z"), (F.col("mass") * q * q).alias("m"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))))
        inside = places.select(at("ix", level).alias("ix"), at("iy", level).alias("iy"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("n").alias("mass"))
        near = met.where("way = 'near'").select("x", "y", "ix", "iy").join(F.broadcast(inside) if few else inside, ["ix", "iy"])
        e2 = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
        same = (F.col("x") == F.col("ox")) & (F.col("y") == F.col("oy"))
        q = 1.0 / (1.0 + e2)
        parts.append(_summed(near.select("x", "y", ((F.col("mass") - same.cast("int")) * q).alias("z"), (F.col("mass") * q * q).alias("m"), "ox", "oy")))

        quarters = F.array(*[F.struct((F.col("ix") * 2 + i).alias("ix"), (F.col("iy") * 2 + j).alias("iy")) for i in (0, 1) for j in (0, 1)])
        open_ = met.where("way = 'open'").select("x", "y", "px", "py", F.explode(quarters).alias("to")).select("x", "y", "px", "py", "to.ix", "to.iy")
    total = reduce(DataFrame.unionByName, parts).groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "z", "asked")])
    return _at_points(points, total)


def _at_points(points: DataFrame, total: DataFrame) -> DataFrame:
    """The sums of places by the ids of their points."""
    back = points.select("id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
    return back.join(total, ["x", "y"]).select("id", "fx", "fy", "z", "asked")


def _all_pairs(places: DataFrame) -> DataFrame:
    """(x, y, fx, fy, z, asked) of each place from all places, by pairs of blocks."""
    schema = "x double, y double, fx double, fy double, z double, asked long"

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((6, 0))]
        if len(q) and len(r):
            x, y, mass = (r[c].to_numpy() for c in ("x", "y", "n"))
            own = q["_q"].iloc[0] == q["_r"].iloc[0]  # both sides are dealt alike: only here a place meets itself
            step = max(1, nb.SLAB // len(r))
            for k in range(0, len(q), step):
                px, py = q["x"].to_numpy()[k : k + step, None], q["y"].to_numpy()[k : k + step, None]
                dx, dy = px - x, py - y
                near = 1.0 / (1.0 + dx * dx + dy * dy)
                m = mass * near
                z = m.sum(1) if not own else ((mass - ((dx == 0) & (dy == 0))) * near).sum(1)
                m *= near
                out.append(np.stack([px[:, 0], py[:, 0], np.einsum("ij,ij->i", m, dx), np.einsum("ij,ij->i", m, dy), z, np.full(len(px), float(len(r)))]))
        rows = pd.DataFrame(np.concatenate(out, axis=1).T, columns=["x", "y", "fx", "fy", "z", "asked"])
        return rows.astype({"asked": "int64"})

    side = lambda: places.select(F.xxhash64("x", "y").alias("id"), F.array("x", "y").alias("v"), *[F.col(c).alias(c) for c in ("x", "y", "n")])  # noqa: E731  # columns of each side's own
    each = nb._in_blocks(side(), side(), run, schema, True)
    return each.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "z", "asked")])


def _summed(rows: DataFrame) -> DataFrame:
    """Forces, sums and counts of a level by place."""
    pull = lambda a, b: F.sum(F.col("m") * (F.col(a) - F.col(b)))
    return settle(rows.groupBy("x", "y").agg(pull("x", "ox").alias("fx"), pull("y", "oy").alias("fy"), F.sum("z").alias("z"), F.count("*").alias("asked")), "forces")
