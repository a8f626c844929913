"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of equal value are one node, so copies cost nothing beyond their own rows. The distinct fingerprints are the
leaves of a binary trie over 64 bits. Two nodes of the same depth are traversed together; a pair carries the bits in
which its prefixes differ, and is dropped once they exceed the error budget. The upper part of the trie is cut where a
node holds few enough fingerprints; a pair of such nodes within the budget is one group of rows, which Spark deals out
and numpy traverses to the leaves. A group answers with a spanning forest of its links, never with all pairs.

The graph is one of fingerprints, so a component is a set of rows, whatever their doc_ids are; its component_id is the
least doc_id of those rows.

Defined cases: a null or blank text has fingerprint 0, and links like any other; equal texts share a component; a doc_id
whose rows have different texts may have several; a row without doc_id links like any other, and a component of such
rows alone has a null component_id; a very long text is hashed by parts of 65,536 shingles; an empty table gives an empty
result; further columns are ignored by :func:`link_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, documents, settle, small_batches

#: Deepest cut of the upper trie: its counts, at most 2 ** TOP_BITS rows, go to the driver.
TOP_BITS = 12
#: Fewest distinct fingerprints that are worth a node of their own.
LEAST_NODE = 2048
#: Node pairs that numpy expands at a time, which bounds a task's memory.
FRONTIER = 1 << 18
#: A node pair of no more leaf pairs than this is compared leaf by leaf.
LEAF_PAIRS = 8


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    if len(words) > shingle:
        ends, starts = ends[shingle - 1 :], starts[: len(words) - shingle + 1]
    else:
        ends, starts = ends[-1:], starts[:1]
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65536):  # a very long text, by parts
        hashes = np.array([digest(line[s:e], 42) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, ``row_hash`` of all columns, and the fingerprint as a signed long ``fp``; one pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "row_hash": b["row_hash"], "fp": fps})

    slim = docs.select(F.col("doc_id").cast("long"), row_hash(docs), F.col("text").cast("string"))
    return slim.mapInPandas(run, "doc_id long, row_hash long, fp long")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed, so that rows that differ anywhere are told apart."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"]).alias("row_hash")


# ---------------------------------------------------------------- trie traversal within a task
def _expand(zeros_a, zeros_b, front):
    """The children of node pairs, whose nodes are ranges of sorted fingerprints; a node with itself has three."""
    alo, ahi, blo, bhi, dist, own = front
    amid = (alo + zeros_a[ahi] - zeros_a[alo]).astype(np.int32)
    bmid = (blo + zeros_b[bhi] - zeros_b[blo]).astype(np.int32)
    cross = ~own
    one = np.uint8(1)
    no = np.zeros(len(alo), bool)
    parts = [
        (alo, amid, blo, bmid, dist, own),
        (amid, ahi, bmid, bhi, dist, own),
        (alo, amid, bmid, bhi, dist + one, no),
        tuple(x[cross] for x in (amid, ahi, blo, bmid, dist + one, no)),
    ]
    return tuple(np.concatenate(x) for x in zip(*parts))


def trie_links(a: np.ndarray, b: np.ndarray, own: bool, budget: int, base: int = 0, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) of sorted, distinct uint64 within ``budget`` bits; with ``own``, a is b and i < j.

    ``base``: the bits in which the two nodes' prefixes, of ``depth`` bits or more, are known to differ; 0 from the root.
    """
    if not len(a) or not len(b):
        return
    zeros: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counted(x, p):
        return np.concatenate(([0], np.cumsum(((x >> np.uint64(63 - p)) & np.uint64(1)) == 0))).astype(np.int32)

    i32 = lambda *x: np.array(x, np.int32)
    stack = [(depth, (i32(0), i32(len(a)), i32(0), i32(len(b)), np.array([base], np.uint8), np.array([own])))]
    while stack:
        p, front = stack.pop()
        na, nb = front[1] - front[0], front[3] - front[2]
        small = (na.astype(np.int64) * nb <= LEAF_PAIRS) if p < 64 else np.ones(len(na), bool)
        if small.any():
            alo, nas, blo, nbs = front[0][small], na[small], front[2][small], nb[small]
            count = nas * nbs
            at = np.repeat(np.arange(len(count)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = alo[at] + k // nbs[at], blo[at] + k % nbs[at]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if own:
                near &= (i < j)
            if near.any():
                yield i[near], j[near]
            front = tuple(x[~small] for x in front)
        if not len(front[0]):
            continue
        if p not in zeros:
            za = counted(a, p)
            zeros[p] = (za, za if own else counted(b, p))
        front = _expand(*zeros[p], front)
        keep = (front[4] <= budget) & (front[0] < front[1]) & (front[2] < front[3])
        if own:  # a leaf with itself is no link
            keep &= ~(front[5] & (front[1] - front[0] == 1))
        front = tuple(x[keep] for x in front)
        for at in range(0, len(front[0]), FRONTIER):
            stack.append((p + 1, tuple(x[at : at + FRONTIER] for x in front)))


def _join_labels(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of linked indexes; ``lab`` points each index at the least index of its class."""
    while True:
        x, y = lab[i], lab[j]
        differ = x != y
        if not differ.any():
            return
        i, j, x, y = i[differ], j[differ], x[differ], y[differ]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab[:] = up


def _forest(a: np.ndarray, b: np.ndarray, own: bool, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (greater, less) between fingerprints as signed longs, a spanning forest of all links between a and b."""
    fps = (a if own else np.concatenate([a, b])).view(np.int64)
    lab = np.arange(len(fps))
    for i, j in trie_links(a, b, own, budget):
        _join_labels(lab, i.astype(np.int64), j.astype(np.int64) + (0 if own else len(a)))
    moved = np.flatnonzero(lab != np.arange(len(lab)))
    u, v = fps[moved], fps[lab[moved]]
    return np.maximum(u, v), np.minimum(u, v)


# ---------------------------------------------------------------- upper trie on the driver
def upper_nodes(counts: dict[int, int], target: int, bits: int = TOP_BITS) -> list[tuple[int, int]]:
    """(depth, prefix) of the nodes where the trie is cut: at most ``target`` fingerprints, or the full ``bits``."""
    out, stack = [], [(0, 0, counts)]
    while stack:
        depth, prefix, held = stack.pop()
        if not held:
            continue
        if depth == bits or sum(held.values()) <= target:
            out.append((depth, prefix))
            continue
        shift = bits - depth - 1
        for bit in (0, 1):
            child = prefix * 2 + bit
            stack.append((depth + 1, child, {k: n for k, n in held.items() if k >> shift == child}))
    return sorted(out)


def node_pairs(nodes: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs of nodes, each with itself too, whose common prefix bits differ in no more than ``budget``."""
    pairs = []
    for x, (dx, px) in enumerate(nodes):
        for y in range(x, len(nodes)):
            dy, py = nodes[y]
            d = min(dx, dy)
            if ((px >> (dx - d)) ^ (py >> (dy - d))).bit_count() <= budget:
                pairs.append((x, y))
    return pairs


def node_target(total: int) -> int:
    """Fingerprints that a node, or a part of one, holds at most, about."""
    return max(LEAST_NODE, int(80 * math.sqrt(total)))


def fingerprint_links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """Edges (u, v), u > v, that connect all fingerprints within ``budget`` bits. fps: distinct ``fp``.

    The counts of the upper trie, at most 4,096 rows, go to the driver; nodes hold about 80 * sqrt(n) fingerprints each,
    so both the rows a group holds and the copies a row needs grow less than the table. A node of the deepest cut that
    still holds more is dealt by hash into parts, each a node of the same prefix: no group is larger, however the
    fingerprints lie.
    """
    spark = fps.sparkSession
    top = F.shiftrightunsigned("fp", 64 - TOP_BITS).cast("int")
    counts = {r["top"]: r["n"] for r in fps.groupBy(top.alias("top")).agg(F.count("*").alias("n")).collect()}
    target = node_target(sum(counts.values()))
    cut = upper_nodes(counts, target)
    held = [sum(counts.get(p, 0) for p in range(q << (TOP_BITS - d), (q + 1) << (TOP_BITS - d))) for d, q in cut]
    parts = [max(1, -(-n // target)) for n in held]
    nodes = [node for node, n in zip(cut, parts) for _ in range(n)]
    first = [sum(parts[:k]) for k in range(len(parts))]
    partners: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
    for k, (x, y) in enumerate(node_pairs(nodes, budget)):
        partners[x].append((k, 0, int(x == y)))
        if x != y:
            partners[y].append((k, 1, 0))
    rows = [(p, [partners[first[k] + j] for j in range(parts[k])]) for k, (d, q) in enumerate(cut) for p in range(q << (TOP_BITS - d), (q + 1) << (TOP_BITS - d)) if p in counts]
    if not rows:
        return spark.createDataFrame([], "u long, v long")
    plan = spark.createDataFrame(sorted(rows), "top int, parts array<array<struct<g:int,side:int,own:int>>>")
    part = F.get("parts", F.pmod(F.xxhash64("fp"), F.size("parts")).cast("int"))
    dealt = fps.select("fp", top.alias("top")).join(F.broadcast(plan), "top").select("fp", F.explode(part).alias("x")).select("x.g", "x.side", "x.own", "fp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = bool(pdf["own"].iloc[0])
        pdf = pdf.assign(fp=pdf["fp"].to_numpy().view(np.uint64)).sort_values("fp")
        a = pdf.loc[pdf["side"] == 0, "fp"].to_numpy()
        u, v = _forest(a, a if own else pdf.loc[pdf["side"] == 1, "fp"].to_numpy(), own, budget)
        return pd.DataFrame({"u": u, "v": v})

    return dealt.groupBy("g").applyInPandas(run, "u long, v long")


# ---------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the least of its component. edges: (u, v), u > v.

    Each round a node keeps the edge to its least neighbour and hands its others on to that neighbour, until each node
    has one edge; then nodes jump to their parent's parent until nothing changes. Every round is a table in the shared
    folder; only counts reach the driver.
    """
    edges = settle(edges.where("u > v").distinct(), "edges")
    while True:
        least = edges.groupBy("u").agg(F.min("v").alias("p"), F.count("*").alias("n"))
        if not edges.join(least.where("n > 1"), "u", "left_semi").limit(1).count():
            break
        kept = least.select("u", F.col("p").alias("v"))
        passed = edges.join(least.where("n > 1").select("u", "p"), "u").where("v > p").select(F.col("v").alias("u"), F.col("p").alias("v"))
        edges = settle(kept.union(passed).distinct(), "edges")
    tree = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        above = tree.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = settle(tree.join(above, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "tree")
        tree = jumped.select("node", "root")
        if not jumped.where("moved").limit(1).count():
            return tree


def link_rows(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, row_hash, ``fp``, ``root`` (a fingerprint that stands for the component) and component_id of each row."""
    marked = settle(fingerprints(docs, shingle), "fingerprints")
    fps = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(fps.select("fp"), budget))
    rooted = settle(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "row_hash", "fp", "root", "component_id")


def link_documents(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, ``fp`` (signed long) and component_id, one row for each row of ``docs``."""
    return link_rows(docs, shingle, budget).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """One row of ``docs`` for each component: that of the least doc_id, then of the least hash of the row.

    Rows without doc_id come last. Of rows that are equal in all columns one stays, and no component loses its last row.
    Only rows that are repeated and stay are shuffled with their text.
    """
    rows = settle(link_rows(docs, shingle, budget), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_hash")
    stays = rows.groupBy("root").agg(F.min(order).alias("k")).select(F.col("root").alias("s_root"), F.col("k.doc_id").alias("s_id"), F.col("k.row_hash").alias("s_hash"))
    keys = rows.groupBy("root", "doc_id", "row_hash").agg(F.count("*").alias("n"))
    same = (F.col("root") == F.col("s_root")) & (F.col("row_hash") == F.col("s_hash")) & F.col("doc_id").eqNullSafe(F.col("s_id"))
    judged = keys.join(stays, same, "left").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "n", F.col("s_root").isNotNull().alias("stays"))
    acted = settle(judged.where("not stays or n > 1"), "acted")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_doc"), row_hash(docs).alias("_row"))
    match = (F.col("_row") == F.col("_hash")) & F.col("_doc").eqNullSafe(F.col("_id"))
    once = keyed.join(bounded(acted), match, "left_anti")
    several = keyed.join(bounded(acted.where("stays")), match, "left_semi").dropDuplicates(["_doc", "_row"])
    return once.unionByName(several).select("row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    out = link_documents(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
