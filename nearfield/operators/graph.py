"""Paths on neighbour graphs as rounds of joins, and what rests on them. Edges: (src, dst, w), in both directions."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import spearman
from ..functions.tables import settle, swept
from . import spanning

#: Sources of a row, nodes of a block, and distances that one set of sources holds at a time, about.
SOURCES, NODES, CELLS = 64, 8192, 32_000_000


def shortest_paths(edges: DataFrame, sources: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(source, node, dist) of all nodes that a source reaches.

    Each round relaxes the edges of the rows that improved in the last one; it ends when none did, as
    weights are positive. A zero weight, or one that is no number, counts as no edge. Every round is a table in the shared folder. With
    ``most_rounds``, paths that are not settled by then are an error.
    """
    edges = settle(edges.where("w > 0 and not isnan(w)").select("src", "dst", "w"), "edges")
    best = settle(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh")), "paths")
    for done in itertools.count():
        if done == most_rounds:
            raise RuntimeError(f"paths still get shorter after {most_rounds} rounds")
        step = best.where("fresh").join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        merged = best.select("source", "node", "dist").join(step, ["source", "node"], "full")
        fresh = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        best = settle(merged.select("source", "node", F.least("dist", "new").alias("dist"), fresh.alias("fresh")), "paths")
        if not best.where("fresh").limit(1).count():
            break
    return best.select("source", "node", "dist")


def landmark_paths(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(source, node, dist) of :func:`shortest_paths` between landmarks (node) only, settled.

    Landmarks first search from both ends (:func:`_met`), which leaves few of them on a graph of one piece. Those left search the whole
    graph: a row is a node with its distances from up to SOURCES landmarks as an array. In each round a block of nodes gets the rows of its
    neighbours that improved in the last one, and takes the least of theirs and the edges. Landmarks go in sets, so that the
    rows at hand are CELLS distances whatever the number of nodes; tables of former rounds are swept.
    """
    edges = settle(edges.where("w > 0 and not isnan(w)").select("src", "dst", "w"), "edges")
    done, left = _met(edges, landmarks.select("node").distinct())
    if not left:
        swept(edges)
        return done
    nodes = landmarks.select("node").union(edges.select("dst")).union(edges.select("src")).distinct()
    n = nodes.count()
    blocks = max(1, -(-n // NODES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.collect_list("src").alias("from"), F.collect_list("w").alias("w"))
    into = settle(into.withColumn("block", block("node")), "into")
    to = edges.groupBy(F.col("src").alias("node")).agg(F.collect_set(block("dst")).alias("to"))
    to = settle(nodes.join(to, "node", "left").select("node", F.coalesce("to", F.expr("cast(array() as array<int>)")).alias("to")), "to")
    names = np.array(sorted(r["node"] for r in landmarks.select("node").distinct().collect()), np.int64)  # landmarks: few by construction
    at_once = max(SOURCES, CELLS // max(1, n) // SOURCES * SOURCES)
    own = np.array(sorted(left), np.int64)
    parts = [_landmark_set(into, to, own[k : k + at_once], names, blocks) for k in range(0, len(own), at_once)]
    swept(edges, into, to)
    rest = edges.sparkSession.createDataFrame([(int(z),) for z in left], "source long")
    parts += [done.join(F.broadcast(rest), "source", "left_anti")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _met(edges: DataFrame, landmarks: DataFrame) -> tuple[DataFrame, list[int]]:
    """((source, node, dist), sources that are left): the paths of the sources not left, and some of the others, settled.

    Each landmark holds the nodes within a radius of it. A path no longer than two radii has an edge from a node within that of its one
    end to a node within that of its other end, so the least sum over such edges is its length if it is no more than that. The
    radius grows until all pairs have met, or no more nodes come, or the rows at hand are more than CELLS. Sums from two ends may differ from a
    sum from one end in the last bit.
    """
    spark = edges.sparkSession
    names = [r["node"] for r in landmarks.collect()]  # few by construction
    m, mean, most, n = edges.agg(F.count("*"), F.avg("w"), F.max("w"), F.approx_count_distinct("src")).first()
    done = [settle(landmarks.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist")), "landmark-paths")]
    if not m or not names:
        return done[0], names if m else []
    ball = settle(landmarks.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh")), "balls")
    left, radius, last, since = names, mean, 0, mean
    while True:
        ball, rows = _grown(ball, edges, radius)
        small = rows < 2 * len(left) * math.sqrt(n * n / m)
        since = since if rows == last else radius
        ended = radius >= since + most  # an edge out of what is held would have added its end
        if not small or ended:
            crossed = ball.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("at"), (F.col("dist") + F.col("w")).alias("x"))
            other = ball.select(F.col("source").alias("node"), F.col("node").alias("at"), F.col("dist").alias("y"))
            pairs = crossed.join(other, "at").where("source < node").groupBy("source", "node").agg(F.min(F.col("x") + F.col("y")).alias("dist"))
            met = settle(pairs.where(F.col("dist") <= 2 * radius * (1 - 1e-9)), "landmark-paths")
            done.append(met)
            own = [x.select(F.col(a).alias("z"), F.col(b).alias("other")) for x in done[1:] for a, b in (("source", "node"), ("node", "source"))]
            counted = functools.reduce(DataFrame.union, own).distinct().groupBy("z").agg(F.count("*").alias("n")).where(F.col("n") == len(names) - 1)
            left = sorted(set(names) - {r["z"] for r in counted.collect()})
            left = [] if ended else left  # pairs that have not met have no path
            if not left:
                break
            some = spark.createDataFrame([(z,) for z in left], "source long")
            ball, old = settle(ball.join(F.broadcast(some), "source", "left_semi"), "balls"), ball
            swept(old)
            rows = ball.count()
        if rows > CELLS:
            break
        last, radius = rows, radius * (1.3 if small else 1.125)
    swept(ball)
    both = done[0]
    if len(done) > 1:
        met = functools.reduce(DataFrame.unionByName, done[1:]).groupBy("source", "node").agg(F.min("dist").alias("dist"))
        both = settle(both.unionByName(met).unionByName(met.select(F.col("node").alias("source"), F.col("source").alias("node"), "dist")), "landmark-paths")
        swept(*done)
    return both, left


def _grown(ball: DataFrame, edges: DataFrame, radius: float) -> tuple[DataFrame, int]:
    """(source, node, dist, fresh) of the nodes within a radius of each source, and how many there are; ball: those within a lesser one."""
    ball, held = ball.withColumn("fresh", F.lit(True)), [ball]
    while True:
        step = ball.where("fresh").join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("new"))
        step = step.where(F.col("new") <= radius).groupBy("source", "node").agg(F.min("new").alias("new"))
        merged = ball.select("source", "node", "dist").join(step, ["source", "node"], "full")
        fresh = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        ball = settle(merged.select("source", "node", F.least("dist", "new").alias("dist"), fresh.alias("fresh")), "balls")
        swept(*held)
        held = [ball]
        rows, more = ball.agg(F.count("*"), F.coalesce(F.max("fresh"), F.lit(False))).first()
        if not more:
            return ball, rows


def _landmark_set(into: DataFrame, to: DataFrame, sources: np.ndarray, all_of: np.ndarray, blocks: int) -> DataFrame:
    """The paths from a set of landmarks to all landmarks."""
    rows = [sources[k : k + SOURCES] for k in range(0, len(sources), SOURCES)]
    spark, tasks = into.sparkSession, min(4096, blocks * len(rows))
    held = "node long, part int, to array<int>, dist array<double>, fresh boolean"
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, own in enumerate(rows):
                dist = np.where(b["node"].to_numpy()[:, None] == own[None, :], 0.0, np.inf)
                yield pd.DataFrame({"node": b["node"], "part": np.int32(part), "to": b["to"], "dist": list(dist), "fresh": (dist == 0).any(1)})

    def relax(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        own, sent = x[~x["sent"]], x[x["sent"]]
        if not len(own) or not len(sent) or not len(y):
            return own.assign(fresh=False)[["node", "part", "to", "dist", "fresh"]]
        place = pd.Index(own["node"])
        y = y[place.get_indexer(y["node"]) >= 0]
        n = y["from"].map(len).to_numpy()
        dst, src = np.repeat(place.get_indexer(y["node"]), n), pd.Index(sent["node"]).get_indexer(np.concatenate(y["from"].to_list() or [[]]))
        w = np.concatenate(y["w"].to_list() or [[]])
        dst, src, w = dst[src >= 0], src[src >= 0], w[src >= 0]
        order = np.argsort(dst, kind="stable")
        dst, src, w = dst[order], src[order], w[order]
        old, given = np.stack(own["dist"].to_numpy()), np.stack(sent["dist"].to_numpy())
        new, step = old.copy(), 20_000
        for k in range(0, len(dst), step):
            d = dst[k : k + step]
            first = np.flatnonzero(np.diff(d, prepend=-1))
            least = np.minimum.reduceat(given[src[k : k + step]] + w[k : k + step, None], first, axis=0)
            new[d[first]] = np.minimum(new[d[first]], least)
        return pd.DataFrame({"node": own["node"].to_numpy(), "part": own["part"].to_numpy(), "to": own["to"].to_numpy(), "dist": list(new), "fresh": (new < old).any(1)})

    each = into.select("node", "from", "w", "block", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("part")).repartition(tasks, "block", "part")
    best = settle(to.mapInPandas(start, held), "paths")
    while best.where("fresh").limit(1).count():
        none = F.expr("cast(array() as array<int>)")
        sent = best.where("fresh").select("node", "part", none.alias("to"), "dist", F.explode("to").alias("block"), F.lit(True).alias("sent"))
        own = best.select("node", "part", "to", "dist", block.alias("block"), F.lit(False).alias("sent"))
        both = own.unionByName(sent).repartition(tasks, "block", "part")
        last, best = best, settle(both.groupBy("block", "part").cogroup(each.groupBy("block", "part")).applyInPandas(relax, held), "paths")
        swept(last)
    wanted = best.join(F.broadcast(spark.createDataFrame([(int(z),) for z in all_of], "node long")), "node", "left_semi")
    names = F.array(*[F.array(*[F.lit(int(z)) for z in own]) for own in rows])
    each = wanted.select("node", F.posexplode("dist").alias("k", "dist"), F.get(names, F.col("part")).alias("own"))
    out = settle(each.where("dist < double('infinity')").select(F.get("own", F.col("k")).alias("source"), "node", "dist"), "landmark-paths")
    swept(best)
    return out


def distance_from_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, dist) to the nearest root."""
    joined = edges.unionByName(roots.select(F.lit(-1).cast("long").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")))
    start = edges.sparkSession.createDataFrame([(-1,)], "node long")
    return shortest_paths(joined, start).where("node <> -1").select("node", (F.col("dist") - 1.0).alias("dist"))


def spanning_tree(nodes: DataFrame) -> DataFrame:
    """(u, v), u < v, of the least spanning tree of all pairs of nodes (node, x, y); nodes without a finite place are left out."""
    named = settle(nodes.select(F.monotonically_increasing_id().alias("id"), "node", F.array("x", "y").alias("v")), "named")
    tree = spanning.least_tree(named.select("id", "v"))
    name = lambda key: named.select(F.col("id").alias(key), F.col("node").alias(f"n{key}"))
    both = tree.select("u", "v").join(name("u"), "u").join(name("v"), "v")
    return both.select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"))


def topology_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the spanning tree of the nodes' places against the true edges between placed nodes."""
    placed = nodes.select("node")
    true = edges.join(placed.withColumnRenamed("node", "from"), "from", "left_semi").join(placed.withColumnRenamed("node", "to"), "to", "left_semi")
    true = true.select(F.least("from", "to").alias("u"), F.greatest("from", "to").alias("v")).distinct()
    tree = spanning_tree(nodes)
    hit = tree.join(true, ["u", "v"]).agg(F.count("*").alias("hit"))
    row = hit.join(tree.agg(F.count("*").alias("n"))).join(true.agg(F.count("*").alias("m")))
    p, r = F.col("hit") / F.greatest("n", F.lit(1)), F.col("hit") / F.greatest("m", F.lit(1))
    return row.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def geodesic_fidelity(edges: DataFrame, landmarks: DataFrame, xy: DataFrame, least: int = 10) -> DataFrame:
    """Spearman's correlation over pairs of landmarks of graph distance in the data and distance in the picture."""
    paths = landmark_paths(edges, landmarks).where("source < node")
    at = lambda key, p: xy.select(F.col("id").alias(key), F.col("x").alias(f"x{p}"), F.col("y").alias(f"y{p}"))
    both = paths.join(at("source", 0), "source").join(at("node", 1), "node")
    both = both.select(F.round("dist", 12).alias("a"), F.sqrt((F.col("x0") - F.col("x1")) ** 2 + (F.col("y0") - F.col("y1")) ** 2).alias("b"))
    both = settle(both, "landmark-pairs")
    if both.count() < least:
        return edges.sparkSession.createDataFrame([(float("nan"),)], "demap double")
    return spearman(both, "a", "b", "demap", float("nan"))


def perplexity_affinity(neighbours: DataFrame, perplexity: float, tolerance: float = 1e-5, steps: int = 200) -> DataFrame:
    """(src, dst, p, d2): each point's Gaussian shares of its neighbours, the bandwidth set by bisection of the entropy."""
    target = float(np.log(perplexity))
    near = neighbours.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist"))).alias("n"))
    near = near.select("src", F.col("n.dst").alias("dst"), F.col("n.dist").alias("dist"))

    def bisected(d2: np.ndarray) -> np.ndarray:
        """Shares of each row; absent neighbours are infinitely far."""
        gap2 = d2 - d2[:, :1]
        held = np.isfinite(gap2)
        low, high, beta = np.zeros(len(d2)), np.full(len(d2), np.inf), np.ones(len(d2))
        w = np.zeros(d2.shape)
        left = np.arange(len(d2))
        for _ in range(steps):
            e = np.where(held[left], np.exp(-beta[left, None] * np.where(held[left], gap2[left], 0.0)), 0.0)
            total = e.sum(1)
            w[left] = e / total[:, None]
            gap = beta[left] * (e * np.where(held[left], gap2[left], 0.0)).sum(1) / total + np.log(total) - target
            wide = np.abs(gap) >= tolerance
            left, gap = left[wide], gap[wide]
            if not len(left):
                break
            up, down = left[gap > 0], left[gap <= 0]
            low[up] = beta[up]
            beta[up] = np.where(np.isinf(high[up]), beta[up] * 2, (beta[up] + np.where(np.isinf(high[up]), 0.0, high[up])) / 2)
            high[down] = beta[down]
            beta[down] = (beta[down] + low[down]) / 2
        return w

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["dist"].map(len).to_numpy()
            d2 = np.full((len(b), max(sizes, default=1)), np.inf)
            for k, row in enumerate(b["dist"]):
                d2[k, : len(row)] = np.asarray(row) ** 2
            p, mask = bisected(d2), np.arange(d2.shape[1])[None, :] < sizes[:, None]
            yield pd.DataFrame({"src": np.repeat(b["src"].to_numpy(), sizes), "dst": np.concatenate([np.asarray(x, np.int64) for x in b["dst"]] or [np.zeros(0, np.int64)]), "p": p[mask], "d2": d2[mask]})

    return near.mapInPandas(run, "src long, dst long, p double, d2 double")


def expected_log_radius(affinity: DataFrame) -> DataFrame:
    """(src, log_radius): the log of the mean squared distance, weighted by affinity."""
    return affinity.groupBy("src").agg(F.log(F.sum(F.col("p") * F.col("d2")) / F.sum("p")).alias("log_radius"))
