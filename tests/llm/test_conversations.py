"""The auction against a search over all edits, and the query against a plain version, on the table and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from nearfield.llm import conversations as conv


def search(rows):
    """(cost, audit) of (initial, must_go, truncated) rows: cheapest first, then least letters; states are spelled out."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", at, follow[state]))
        if at < len(rows):
            initial, must_go, truncated = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if not must_go:
                more = 3 * truncated
                if initial == follow[state] or initial == "s" and not state:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initial))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, follow[state]))


def plain(table):
    """The contract's rows from (conv_id, turn, role, text) rows."""
    out, rows = {}, {}
    for c, turn, role, text in table:
        rows.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows[c] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, own in rows.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        seen, faults, state = set(), [], []
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
            state.append((role[:1] if role[:1] in ("s", "u", "a") else "o", faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        cost, audit = search(state)
        said, left = [], iter(own)
        want = len(audit) - audit.count("D")
        for k, letter in enumerate(a for a in audit if True):
            if letter == "D":
                next(left)
                continue
            _, role, text = next(left) if letter != "I" else (None, None, "")
            if letter != "K":  # an odd number of rows begins with a system row
                role = ("user", "assistant")[(len(said) - want % 2) % 2]
            said.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 32])
def test_auction_finds_the_least_of_the_cheapest(size, monkeypatch):
    monkeypatch.setattr(conv, "SEGMENT", size)
    conv.segment.cache_clear()
    rng = random.Random(size)
    for _ in range(400):
        signs = "".join(rng.choice("xsuaoSUAOuaua") for _ in range(rng.randint(0, 16)))
        assert conv.cheapest(signs) == search([(s.lower(), s == "x", s.isupper()) for s in signs])
    conv.segment.cache_clear()


def test_prices_are_duals():
    signs = "suxaUAuuo"
    arcs = conv.lattice(signs, conv.STOP)
    arcs = arcs[: 4 * len(signs)] + [arcs[4 * len(signs) + q] if conv.STOP[q] is not None else [("I", 3, 4 * len(signs) + conv.NEXT[q])] for q in range(4)] + [[]]
    price = conv.auction(arcs, (0,))
    assert all(price[n] <= cost + price[end] for n, out in enumerate(arcs) for _, cost, end in out)
    node, ways = 0, conv.tight(arcs, price)
    while node != len(arcs) - 1:
        assert ways[node] and all(price[node] == next(c for letter, c, e in arcs[node] if (letter, e) == way) + price[way[1]] for way in ways[node])
        node = ways[node][0][1]


def test_long_conversation_is_linear():
    rng = random.Random(8)
    signs = "".join(rng.choice("uauauauauauxsUA") for _ in range(20_000))
    cost, audit = conv.cheapest(signs)
    assert len(audit) - audit.count("I") == len(signs) and cost > 0
    conv.segment.cache_clear()


ODD = [(1, 0, "user", "One."), (1, 1, "assistant", "Two."), (1, 1, "assistant", "Two."), (2, None, None, None), (2, None, "user", ""), (2, 5, "assistant", "A!"), (None, None, "system", "S."), (None, 3, "user", "U?"), (None, 3, "user", "V?"), (3, 7, "tool", "x" * 50_000), (4, None, "user", None)]
ODD += [(9, k, ("user", "assistant")[k % 2], f"Said {k % 50}" + "."[: k % 3]) for k in range(500)] + [(k, t, "user", "Gone.") for k in range(100, 180) for t in range(1 + k % 2)]


def _got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_query_as_the_plain_version_on_odd_rows(spark):
    rows = spark.createDataFrame([(*r, "c", 1) for r in ODD], "conv_id long, turn long, role string, text string, audit string, digest int")
    got = _got(conv.digests(conv.damaged(rows)))
    assert got == plain(ODD)
    assert any(r[:7] == (0, 0, 0, 0, 0, 0, "") for r in got.values())  # one whose rows were all dropped
    none = conv.digests(conv.damaged(rows.limit(0)))
    assert none.count() == 0 and "repaired_sha256" in none.columns


def test_query_as_the_plain_version_on_the_table(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(conv.op11_repair(spark, sf_dir)) == plain(table)


def test_repaired_rows_are_the_digest(spark, sf_dir):
    rows = conv.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    made = {}
    for r in sorted(conv.repaired(rows).collect(), key=lambda r: (r["conv_id"], r["place"])):
        made.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert r["role"] in ("system", "user", "assistant") and r["edit"] in "KRI"
    got = conv.digests(rows).collect()
    assert all(hashlib.sha256("\n".join(made.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"] for r in got)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in v)) for v in made.values())
