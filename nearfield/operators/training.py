"""What training adds to the objectives: weighted losses, teachers, code books, density terms, forces and schedules.

All are values over tables, one step each; nothing here holds a network. Rows of points: (id, v) or (batch, id, h, l).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distance import cosine_similarity, euclidean, gaussian_kernel, squared_distance
from ..functions.tables import bounded
from . import objective as ob
from .sampling import hash_key, hash_pick, subsample

#: The least positive single-precision number, which keeps logs of shares finite.
TINY = 1.1754943508222875e-38


def total_loss(a: DataFrame, b: DataFrame, weight: float, k: int) -> DataFrame:
    """(batch, manifold, density, loss): the manifold loss and ``weight`` times the density loss, which 0 leaves out."""
    out = ob.manifold_loss(a, b).withColumnRenamed("loss", "manifold")
    dense = ob.density_loss(a, k).withColumnRenamed("loss", "density") if weight else out.select("batch", F.lit(0.0).alias("density"))
    return out.join(dense, "batch").withColumn("loss", F.col("manifold") + weight * F.col("density"))


def z_normalised(df: DataFrame, value: str, by: str, eps: float = 1e-6) -> DataFrame:
    """``value`` less its mean, by its population deviation with a floor, within each ``by``."""
    w = Window.partitionBy(by)
    return df.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(eps)))


def _positions(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(batch, id, x, y): both coordinates centred and scaled within each batch."""
    flat = df.select("batch", "id", F.get("l", F.lit(0)).alias("x"), F.get("l", F.lit(1)).alias("y"))
    return z_normalised(z_normalised(flat, "x", "batch", eps), "y", "batch", eps)


def consistency_loss(student: DataFrame, teacher: DataFrame, distance_weight: float = 1.0, position_weight: float = 0.2) -> DataFrame:
    """(batch, loss): mean squared differences of scaled positions, and of scaled distances, of two views of each batch."""
    s = _positions(student)
    both = s.join(_positions(teacher).select("batch", "id", F.col("x").alias("tx"), F.col("y").alias("ty")), ["batch", "id"])
    gap = ((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2) / 2
    places = both.groupBy("batch").agg(F.avg(gap).alias("place"))
    other = both.select("batch", F.col("id").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("tx").alias("tx2"), F.col("ty").alias("ty2"))
    pairs = both.join(other, "batch").where("id < j")
    far = lambda p: F.sqrt((F.col(f"{p}x") - F.col(f"{p}x2")) ** 2 + (F.col(f"{p}y") - F.col(f"{p}y2")) ** 2)
    d = z_normalised(z_normalised(pairs.select("batch", far("").alias("ds"), far("t").alias("dt")), "ds", "batch"), "dt", "batch")
    return d.groupBy("batch").agg(F.avg((F.col("ds") - F.col("dt")) ** 2).alias("far")).join(places, "batch").select("batch", (distance_weight * F.col("far") + position_weight * F.col("place")).alias("loss"))


def teacher_update(teacher: DataFrame, student: DataFrame, momentum: float) -> DataFrame:
    """(name, pos, value): momentum times the teacher's parameter and the rest of the student's; names of either side stay."""
    both = teacher.withColumnRenamed("value", "t").join(student.withColumnRenamed("value", "s"), ["name", "pos"], "full")
    mixed = momentum * F.col("t") + (1 - momentum) * F.col("s")
    return both.select("name", "pos", F.coalesce(mixed, "t", "s").alias("value"))


def code_loss(rows: DataFrame, codes: DataFrame, column: str, commitment: float = 0.25) -> DataFrame:
    """(loss): mean squared difference of rows and their nearest codes, counted once and ``commitment`` times more."""
    near = ob.nearest_code(rows, codes, column)
    return near.join(rows.select("id", F.size(column).alias("d")), "id").agg(((1 + commitment) * F.sum("d2") / F.sum("d")).alias("loss"))


def tree_route(rows: DataFrame, tree: DataFrame, column: str, levels: int) -> DataFrame:
    """(id, level, node, d2): at each level the nearer of a row's last node's two children, ties to the lesser.

    tree: (node, v), the root being 0 and the children of p being 2 p + 1 and 2 p + 2; one equi-join a level.
    """
    nodes = bounded(tree.select("node", F.floor((F.col("node") - 1) / 2).cast("long").alias("parent"), "v"), "tree")
    at = rows.select("id", F.col(column).alias("x"), F.lit(0).cast("long").alias("parent"))
    out = None
    for level in range(1, levels + 1):
        d2 = F.round(squared_distance("x", "v"), 12)
        best = at.join(nodes, "parent").groupBy("id").agg(F.min(F.struct(d2.alias("d2"), F.col("node").cast("long").alias("node"))).alias("m"), F.first("x").alias("x"))
        one = best.select("id", F.lit(level).alias("level"), "m.node", "m.d2")
        out = one if out is None else out.unionByName(one)
        at = best.select("id", "x", F.col("m.node").alias("parent"))
    return out


def orthogonality_loss(features: DataFrame) -> DataFrame:
    """(loss) of (group, id, v): 1 and the mean over groups of the summed cosines of pairs, by the square of their number."""
    sizes = features.groupBy("group").agg(F.count("*").alias("n"))
    pairs = features.join(features.select("group", F.col("id").alias("j"), F.col("v").alias("w")), "group").where("id < j")
    sums = pairs.groupBy("group").agg(F.sum(cosine_similarity("v", "w")).alias("s"))
    each = sizes.join(sums, "group", "left").select((F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("n"))).alias("m"))
    return each.agg((1 + F.avg("m")).alias("loss"))


def stage(epoch: Column, second: int, third: int) -> Column:
    """The stage of an epoch: none before the second begins, and the later one where both have."""
    return F.when(epoch > third, "step2_r").when(epoch > second, "step2_s").otherwise("step1")


def temperature(epoch: Column, total: int = 900, start: float = 100.0, end: float = 1.001) -> Column:
    """A geometric fall from start to end over all epochs but the last; end from then on."""
    return F.when(epoch >= total, F.lit(end)).otherwise(start * F.pow(F.lit(end / start), epoch / (total - 1)))


def edge_shares(edges: DataFrame, xy: DataFrame, sigma: float) -> DataFrame:
    """(src, dst, p, q, d2, dx, dy): Gaussian shares of data distances and Student-t shares in the picture, each summing to 1."""
    at = lambda key, s: xy.select(F.col("id").alias(key), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    rows = edges.join(at("src", 0), "src").join(at("dst", 1), "dst").withColumns({"dx": F.col("x0") - F.col("x1"), "dy": F.col("y0") - F.col("y1")})
    rows = rows.withColumn("d2", F.col("dx") ** 2 + F.col("dy") ** 2).select("src", "dst", gaussian_kernel(F.col("dist") ** 2, sigma).alias("g"), (1 / (1 + F.col("d2"))).alias("t"), "d2", "dx", "dy")
    sums = rows.agg(F.sum("g").alias("sg"), F.sum("t").alias("st"))  # one row
    return rows.join(F.broadcast(sums)).select("src", "dst", (F.col("g") / F.col("sg")).alias("p"), (F.col("t") / F.col("st")).alias("q"), "d2", "dx", "dy")


def kl_cost(shares: DataFrame) -> DataFrame:
    """(cost): the sum of p ln(p / q) over the edges."""
    return shares.agg(F.sum(F.col("p") * F.log((F.col("p") + TINY) / (F.col("q") + TINY))).alias("cost"))


def edge_forces(shares: DataFrame) -> DataFrame:
    """(id, fx, fy): what a node's edges pull it by: p / (1 + d2) times the difference of places."""
    pull = F.col("p") / (1 + F.col("d2"))
    return shares.groupBy(F.col("src").alias("id")).agg(F.sum(pull * F.col("dx")).alias("fx"), F.sum(pull * F.col("dy")).alias("fy"))


def picture_radius(shares: DataFrame, shift: float = 0.0) -> DataFrame:
    """(id, re): log of the mean squared distance of a node's edges in the picture, weighted by 1 / (1 + d2)."""
    t = 1 / (1 + F.col("d2"))
    return shares.groupBy(F.col("src").alias("id")).agg(F.log(shift + F.sum(F.col("d2") * t) / F.sum(t)).alias("re"))


def shifted_correlation(df: DataFrame, re: str, r: str, shift: float = 0.1) -> DataFrame:
    """(rho): covariance of the picture's radius and a standardised data radius, by the former's deviation, its variance shifted."""
    stats = df.agg(F.avg(r).alias("mr"), F.stddev_samp(r).alias("sr"))
    scaled = df.join(F.broadcast(stats)).withColumn(r, (F.col(r) - F.col("mr")) / F.col("sr"))
    return scaled.agg((F.covar_samp(re, r) / F.sqrt(F.var_samp(re) + shift)).alias("rho"))


def tail_trimmed(df: DataFrame, label: str, column: str, share: float = 0.95) -> DataFrame:
    """Rows of 2-D arrays no farther from their class's centre than its ``share`` quantile of such distances."""
    mid = df.groupBy(F.col(label).alias("_l")).agg(F.array(F.avg(F.get(column, F.lit(0))), F.avg(F.get(column, F.lit(1)))).alias("_m"))
    far = df.join(mid, df[label].eqNullSafe(mid["_l"])).withColumn("_d", euclidean(column, "_m")).drop("_m")
    edge = far.groupBy(F.col("_l").alias("_e")).agg(F.percentile("_d", share).alias("_q"))
    return far.join(edge, F.col("_l").eqNullSafe(F.col("_e"))).where("_d <= _q").select(df.columns)


# ---------------------------------------------------------------- samples
def multi_level(pts: DataFrame, sizes: list[int], k: int, column: str, seed: int = 42) -> DataFrame:
    """(level, src, rank, dst, dist): neighbours within a sample for each level; the last level has all points."""
    from . import neighbours as nb

    out = None
    for level, size in enumerate([*sizes, None]):
        some = subsample(pts, "id", size, seed)
        one = nb.knn(some, k, column).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out.select("level", "src", "rank", "dst", "dist")


def anchor_subsets(pts: DataFrame, anchors: int, k: int, column: str, seed: int = 42) -> DataFrame:
    """(src, rank, dst, dist): the k nearest points of each sampled anchor, itself first."""
    from . import neighbours as nb

    return nb.nearest(subsample(pts, "id", anchors, seed), pts, k, column)


def cluster_batches(pts: DataFrame, knn: DataFrame, seeds: int, size: int, seed: int = 42) -> DataFrame:
    """(batch, id): for each sampled seed the seed and up to size - 1 of its neighbours, in hash order."""
    heads = subsample(pts.select("id"), "id", seeds, seed).withColumnRenamed("id", "batch")
    near = heads.join(knn, heads["batch"] == knn["src"]).select("batch", F.col("dst").alias("id"))
    order = Window.partitionBy("batch").orderBy(hash_key(seed, "batch", "id"), "id")
    some = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") < size).select("batch", "id")
    return heads.select("batch", F.col("batch").alias("id")).unionByName(some)


def gaussian_noise(df: DataFrame, column: str, sigma: float, seed: int = 42) -> DataFrame:
    """``aug``: each value with noise of deviation sigma, from two hashed numbers by Box and Muller's rule."""
    share = lambda i, k: (hash_pick(F.lit(1 << 28), seed, F.col("id"), i, F.lit(k)) + 1).cast("double") / float((1 << 28) + 1)
    noise = lambda i: F.sqrt(-2 * F.log(share(i, 0))) * F.cos(2 * F.pi() * share(i, 1))
    return df.withColumn("aug", F.transform(column, lambda x, i: x + sigma * noise(i)))
