"""That no row is lost or kept twice: near-duplicates with repeated and missing ids, and sharding with stored maps."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PySparkException

from nearfield.llm import near_dedup, sharding

A, B, C = (" ".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=90)) for k in range(3))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, root string")


def test_keep_one_keeps_each_text_once(spark):
    rows = [(1, B), (5, A), (5, B), (7, C), (7, C), (None, A), (None, None), (None, None), (None, "")]
    kept = near_dedup.keep_one(_docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "root"]
    # a null and an empty text have one fingerprint; which of the two stays is settled by the hash of the row
    got = Counter((r["doc_id"], r["text"] or "") for r in kept.collect())
    assert got == Counter([(1, B), (5, A), (7, C), (None, "")])


def test_rows_that_differ_in_other_columns_are_told_apart(spark):
    df = spark.createDataFrame([(1, A, "en"), (1, A, "de"), (2, A, "en")], "doc_id long, text string, lang string")
    assert near_dedup.keep_one(df).count() == 1


def test_maps_and_structs_beside_the_text(spark):
    df = spark.createDataFrame([(1, A, {"a": 1}, (1,)), (1, A, {"a": 1}, (1,)), (2, B, None, None)], "doc_id long, text string, m map<string,int>, s struct<x:int>")
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(df).collect()) == [1, 2]


@pytest.mark.parametrize("target", [None, 3])
def test_components_with_null_ids_like_brute_force(spark, monkeypatch, target):
    if target:  # many nodes, so that links cross them
        monkeypatch.setattr(near_dedup, "node_target", lambda total: target)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    rows = []
    for k in range(50):
        t = rng.choices(words, k=80)
        rows += [(rng.choice([None, k, k, 3]), " ".join(t))]
        t[rng.randrange(80)] = "changed"
        rows += [(rng.choice([None, 100 + k]), " ".join(t)), (rng.choice([None, 200 + k]), " ".join(t))]
    rows += [(None, None), (None, ""), (9, " ")]
    got = near_dedup.link_documents(_docs(spark, rows)).collect()
    fps = [near_dedup.fingerprint(t) for _, t in rows]
    lab = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and lab[a] != lab[b]:
                lab = [lab[b] if x == lab[a] else x for x in lab]
    ids = defaultdict(list)
    for (i, _), x in zip(rows, lab):
        ids[x] += [i] if i is not None else []
    want = Counter((i, f, min(ids[x], default=None)) for (i, _), f, x in zip(rows, fps, lab))
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want
    kept = near_dedup.keep_one(_docs(spark, rows)).collect()
    assert len(kept) == len(set(lab))
    assert Counter(r["doc_id"] for r in kept) == Counter(min(ids[x], default=None) for x in set(lab))


def test_crowded_nodes_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "node_target", lambda total: 16)
    rng = random.Random(1)
    fps = sorted({rng.getrandbits(9) | (5 << 50) for _ in range(150)})  # all under one node of the deepest cut
    edges = near_dedup.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 1).collect()
    lab = {f: f for f in fps}

    def join(pairs):
        for u, v in pairs:
            a, b = lab[u], lab[v]
            if a != b:
                for k in lab:
                    lab[k] = b if lab[k] == a else lab[k]

    join([(r["u"], r["v"]) for r in edges])
    got = Counter(Counter(lab.values()).values())
    lab = {f: f for f in fps}
    join([(a, b) for a in fps for b in fps if a > b and (a ^ b).bit_count() <= 1])
    assert got == Counter(Counter(lab.values()).values()) and all((r["u"] ^ r["v"]).bit_count() >= 1 for r in edges)


# ---------------------------------------------------------------- sharding
def _records(spark, n, start=0):
    return sharding.sized(spark.range(start, start + n).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) as text"))


def test_stored_map_takes_later_records(spark, tmp_path):
    few = _records(spark, 100)
    path = str(tmp_path / "map")
    sharding.write_map(sharding.first_map(sharding.slot_loads(few), 4), path)
    entries = sharding.read_map(spark, path)
    assert entries.count() == sharding.SLOTS
    many = _records(spark, 1000)
    got = sharding.assign(many, entries, sharding.slot_loads(many)).collect()
    assert len(got) == 1000
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    again = sharding.rebalance(entries, sharding.slot_loads(few).where("rows > 0"), 5)
    assert again.count() == sharding.SLOTS and again.where("shard is null").count() == 0


def test_missing_entries_are_an_error(spark):
    records = _records(spark, 50)
    loads = sharding.slot_loads(records)
    with pytest.raises(PySparkException):
        sharding.assign(records, sharding.first_map(loads, 4).where("vslot < 4000"), loads).collect()
    with pytest.raises(PySparkException):
        sharding.assign(records, sharding.first_map(loads, 4), loads.where("rows = 0")).collect()


def test_first_map_and_rebalance_like_brute_force(spark):
    loads = sharding.slot_loads(_records(spark, 3000))
    sizes = {r["vslot"]: r["bytes"] for r in loads.collect()}
    want, load = {}, [0] * 7
    for b, v in sorted(((b, v) for v, b in sizes.items()), reverse=True):
        to = load.index(min(load))
        want[v], load[to] = to, load[to] + b
    first = sharding.first_map(loads, 7)
    assert {r["vslot"]: r["shard"] for r in first.collect()} == want
    # two more shards: each old one keeps its largest slots up to the new mean, the rest is dealt out
    mean, keep, total = sum(sizes.values()) / 9, {}, [0] * 9
    for s in range(7):
        run = 0
        for b, v in sorted((-sizes[v], v) for v in want if want[v] == s):
            run -= b
            if run <= mean * 1.02:
                keep[v], total[s] = s, total[s] - b
    for b, v in sorted(((b, v) for v, b in sizes.items() if v not in keep), reverse=True):
        to = total.index(min(total))
        keep[v], total[to] = to, total[to] + b
    assert {r["vslot"]: r["shard"] for r in sharding.rebalance(first, loads, 9).collect()} == keep


def test_hot_keys_are_dealt_over_all_slots(spark):
    rows = [(None, "a" * 50)] * 3000 + [(7, "b" * 40)] * 3000 + [(k, "c" * 60) for k in range(3000)]
    records = sharding.spread(sharding.settle(sharding.sized(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "t"))
    loads = sharding.slot_loads(records)
    got = sharding.assign(records, sharding.first_map(loads, 10), loads).collect()
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert len(got) == len(rows) and max(sums.values()) - min(sums.values()) <= 76
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t) + 16) for i, t in rows)
    assert sharding.spread(sharding.settle(sharding.sized(spark.createDataFrame([], "doc_id long, text string")), "t")).count() == 0
