"""Lineage and trajectory operators over cells (id, x, y, from, to, time)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import settle
from ..functions.ranks import average_rank_within, exact_quantile, pearson
from . import neighbours as nb


def lineage_edges(cells: DataFrame) -> DataFrame:
    """Distinct (from, to) without missing nodes (the text nan) and loops."""
    return cells.where("`from` <> 'nan' and `to` <> 'nan' and `from` <> `to`").select("from", "to").distinct()


def incident(cells: DataFrame) -> DataFrame:
    """A row for each cell and node at an end of its edge, once if both ends are one."""
    ends = F.array_distinct(F.array("from", "to"))
    return cells.select("*", F.explode(ends).alias("node")).where("node <> 'nan'")


def node_centroids(cells: DataFrame, least: int = 10) -> DataFrame:
    """(node, x, y, n) of nodes with enough incident cells."""
    return incident(cells).groupBy("node").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).where(F.col("n") >= least)


def node_roles(edges: DataFrame) -> DataFrame:
    """(node, indegree, outdegree, role): root, terminal, branchpoint or internal."""
    out = edges.groupBy(F.col("from").alias("node")).agg(F.count("*").alias("outdegree"))
    into = edges.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("indegree"))
    both = out.join(into, "node", "full").fillna(0)
    role = F.when(F.col("indegree") == 0, "root").when(F.col("outdegree") == 0, "terminal").when(F.col("outdegree") > 1, "branchpoint").otherwise("internal")
    return both.select("node", "indegree", "outdegree", role.alias("role"))


def medoids(cells: DataFrame, group: str) -> DataFrame:
    """The point of each group nearest to its coordinate-wise median, ties to the lesser id."""
    mid = exact_quantile(cells, "x", 0.5, "mx", group).join(exact_quantile(cells, "y", 0.5, "my", group), group)
    d2 = (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2
    return cells.join(F.broadcast(mid), group).groupBy(group).agg(F.min_by(F.struct("id", "x", "y"), F.struct(d2, "id")).alias("m")).select(group, "m.id", "m.x", "m.y")


def fate_recovery(cells: DataFrame, probs: DataFrame, terminals: DataFrame) -> DataFrame:
    """Mean over terminals of Pearson's correlation of true and distance-based fate shares.

    probs: (id, terminal, p). A cell's share is the softmax of minus its distance to each terminal's centroid, by the
    median of all those distances. Terminals of constant share or of ten rows or fewer count for nothing.
    """
    far = cells.select("id", "x", "y").join(F.broadcast(terminals.select(F.col("node").alias("terminal"), F.col("x").alias("tx"), F.col("y").alias("ty"))))
    far = far.withColumn("d", F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2))
    scale = exact_quantile(far, "d", 0.5, "scale")
    weight = far.join(F.broadcast(scale)).withColumn("w", F.exp(-F.col("d") / F.greatest("scale", F.lit(1e-12))))
    share = weight.withColumn("q", F.col("w") / F.sum("w").over(Window.partitionBy("id"))).select("id", "terminal", "q")
    each = share.join(probs, ["id", "terminal"]).groupBy("terminal").agg(pearson("p", "q").alias("r"), F.count("*").alias("n"), F.stddev_pop("p").alias("sp"), F.stddev_pop("q").alias("sq"))
    return each.where("n > 10 and sp > 0 and sq > 0").agg(F.avg("r").alias("fate_corr"))


def branch_monotonicity(cells: DataFrame, branch: str, least: int = 20) -> DataFrame:
    """Cell-weighted mean over branches of |Spearman| between time and the first principal axis of the picture.

    Ranks are taken within a branch by sorting it in ranges of time or place; the axis is the 2 x 2 closed form.
    """
    sums = cells.groupBy(branch).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.count("*").alias("n"), F.count_distinct("time").alias("times"))
    half = (F.col("xx") - F.col("yy")) / 2
    top = (F.col("xx") + F.col("yy")) / 2 + F.sqrt(half * half + F.col("xy") ** 2)
    flat = F.abs("xy") < 1e-15
    ax = F.when(flat, (F.col("xx") >= F.col("yy")).cast("double")).otherwise(top - F.col("yy"))
    ay = F.when(flat, (F.col("xx") < F.col("yy")).cast("double")).otherwise(F.col("xy"))
    axis = sums.where((F.col("n") >= least) & (F.col("times") > 1)).select(branch, "mx", "my", "n", ax.alias("ax"), ay.alias("ay"))
    placed = cells.join(F.broadcast(axis), branch).withColumn("place", F.round(((F.col("x") - F.col("mx")) * F.col("ax") + (F.col("y") - F.col("my")) * F.col("ay")) / F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2), 9))

    ranked = average_rank_within(average_rank_within(placed.select(branch, "n", "time", "place"), branch, "time", "rt"), branch, "place", "rp")
    each = ranked.groupBy(branch).agg(F.abs(pearson("rt", "rp")).alias("r"), F.first("n").alias("n")).where("r is not null and not isnan(r)")
    return each.agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("branch_monotonicity"))


def _hull_area(xy: pd.DataFrame) -> float:
    """Area of the convex hull: a monotone chain, then the shoelace sum."""
    pts = sorted(set(map(tuple, xy.to_numpy())))
    if len(pts) < 3:
        return 0.0

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(pts) + chain(pts[::-1])
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def hull_areas(cells: DataFrame, group: str, keep: float = 0.95) -> DataFrame:
    """(group, area) of the convex hull of the points within the ``keep`` quantile of distance to their centroid.

    A hull's corners are found in parts first, in groups of ids of bounded size; only corners of parts meet in one task.
    """
    mid = cells.groupBy(group).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    far = cells.join(F.broadcast(mid), group).withColumn("d", F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2))
    edge = exact_quantile(far, "d", keep, "edge", group)
    near = far.join(F.broadcast(edge), group).where(F.col("d") <= F.col("edge")).select(group, "x", "y", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
    # the extreme points in 64 directions of each part are corners; rows inside their ring can be no corner of the whole
    kind = dict(cells.dtypes)[group]

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(set(map(tuple, pdf[["x", "y"]].to_numpy())))
        keep_ = set(pts) if len(pts) < 3 else set(_ring(pts))
        return pd.DataFrame([(pdf[group].iloc[0], *p) for p in keep_], columns=[group, "x", "y"])

    parts = near.groupBy(group, "part").applyInPandas(corners, f"`{group}` {kind}, x double, y double")

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [pdf[group].iloc[0]], "area": [_hull_area(pdf[["x", "y"]])]})

    return parts.groupBy(group).applyInPandas(area, f"`{group}` {kind}, area double")


def _ring(pts: list[tuple]) -> list[tuple]:
    """Corners of the hull of sorted distinct points."""

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return chain(pts) + chain(pts[::-1])


def mean_pairwise(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, spread): mean Euclidean distance of all pairs of rows of each group, 0 for a single row.

    A group's rows are dealt into blocks by hash of their id; each pair of blocks answers with its sum of distances.
    """
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    rows = df.select(group, "id", F.col(column).alias("v")).join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    rows = rows.withColumn("_blocks", F.ceil(F.col("_n") / nb.BLOCK).cast("int"))
    rows = rows.select(group, "v", "_blocks", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int").alias("_k"))
    own = lambda: (F.col(group).alias(group), F.col("v").alias("v"))  # noqa: E731  # columns of each side's own
    left = rows.select(*own(), F.col("_k").alias("_q"), F.explode(F.sequence("_k", F.col("_blocks") - 1)).alias("_r"))
    right = rows.select(*own(), F.explode(F.sequence(F.lit(0), "_k")).alias("_q"), F.col("_k").alias("_r"))
    kind = dict(df.dtypes)[group]

    def run(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        total = nb.distances(q["v"], r["v"]).sum() if len(q) and len(r) else 0.0
        return pd.DataFrame({group: (q if len(q) else r)[group].iloc[:1].to_numpy(), "total": [total if key[1] == key[2] else 2 * total]})

    keys = [group, "_q", "_r"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"`{group}` {kind}, total double")
    sums = sums.groupBy(group).agg(F.sum("total").alias("_total"))
    pairs = F.col("_n") * (F.col("_n") - 1)
    return sums.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).select(group, F.when(pairs > 0, F.col("_total") / pairs).otherwise(0.0).alias("spread"))


def class_spread_recovery(pts: DataFrame, label: str, least_rows: int = 20, least_classes: int = 8) -> DataFrame:
    """Spearman's correlation over classes of their spread in the data with hull area and spread in the picture.

    Both are NaN where fewer than ``least_classes`` classes have ``least_rows`` rows.
    """
    from ..functions.ranks import spearman
    from .prep import drop_rare

    some = drop_rare(pts, label, least_rows)
    hd = mean_pairwise(some, label, "hd").withColumnRenamed("spread", "s")
    ld = mean_pairwise(some, label, "ld").withColumnRenamed("spread", "m")
    area = hull_areas(some.select("id", label, F.get("ld", F.lit(0)).alias("x"), F.get("ld", F.lit(1)).alias("y")), label)
    each = settle(hd.join(ld, label).join(area, label), "classes")
    if each.count() < least_classes:
        return pts.sparkSession.createDataFrame([(float("nan"), float("nan"))], "asr double, asr_mpd double")
    return spearman(each, "area", "s", "asr", float("nan")).join(spearman(each, "m", "s", "asr_mpd", float("nan")))
