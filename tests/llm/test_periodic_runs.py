"""Runs from the grammar against a plain scan of every period, extensions against comparing words, the query on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from nearfield.llm import periodic_runs as pr


def plain(words):
    """All runs by a scan of the whole text for each period."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(rng):
    out = []
    for _ in range(rng.randint(1, 12)):
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 3)):
            if words:
                a, p = rng.randrange(len(words)), rng.randint(1, 6)
                words[a:a] = words[a : a + p] * rng.randint(2, 9)
        out.append(words)
    return out


def test_runs_as_a_plain_scan():
    rng = random.Random(5)
    for _ in range(150):
        docs = texts(rng)
        assert pr.runs_of(docs) == [plain(w) for w in docs]


def test_extensions_as_compared_words():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 4):
        body = rng.integers(3, 3 + letters, 400)
        body[200:300] = body[100:200]
        row = np.r_[0, body, 1, body[:150], 2]
        levels = pr.grammar(row, 3)
        back = pr.backwards(levels)
        a, b = rng.integers(1, len(row), 500), rng.integers(1, len(row), 500)
        a, b = a[a != b], b[a != b]

        def far(i, j, way):
            k = 0
            while 0 <= i + way * k < len(row) and 0 <= j + way * k < len(row) and row[i + way * k] == row[j + way * k]:
                k += 1
            return k

        assert pr.agreement(levels, a.copy(), b.copy()).tolist() == [far(i, j, 1) for i, j in zip(a, b)]
        assert pr.agreement(back, len(row) - 1 - a, len(row) - 1 - b).tolist() == [far(i, j, -1) for i, j in zip(a, b)]


def test_levels_shrink_and_spell_the_words():
    rng = np.random.default_rng(4)
    row = np.r_[0, rng.integers(2, 50, 20_000), 1]
    levels = pr.grammar(row, 2)
    assert len(levels[-1].symbols) == 3 and all(level.words.sum() == len(row) for level in levels)
    assert sum(len(level.symbols) for level in levels) < 12 * len(row)


@pytest.mark.parametrize("words", [[b"a"] * 30_000, [b"a", b"b", b"a"] * 10_000, [b"x"] + [b"y", b"z"] * 15_000 + [b"y", b"w"]])
def test_long_texts(words):
    got = pr.runs_of([words])[0]
    assert got == ([(0, 30_000, 1)] if words[1] == b"a" else [(0, 30_000, 3)] if words[0] == b"a" else [(1, 30_001, 2)])


def _want(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    start, length, q = best[0] if best else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), start, length, q, 1000 * length // q if runs else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[-1]))


def test_query_on_odd_rows(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "one two", "la " * 9, "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb", "Ä ö " * 40 + "x", "word\x0bword\x0cword\rword\tword\nword"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k, " ".join(rng.choice("ab") for _ in range(60))) for k in range(100, 160)] + [(None, "b " * 7), (100, "b " * 7), (100, "b " * 7), (2**60 + 1, "c d " * 9)]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, start int, words string")
    got = [tuple(r) for r in pr.digests(docs, damage=True).collect()]
    assert _sorted(got) == _sorted(_want(*r) for r in rows)
    assert pr.digests(docs.limit(0), damage=True).count() == 0
    cut = {r["doc_id"]: r["text"] for r in pr.collapse(docs.where("doc_id < 10")).collect()}
    assert cut[4] == "la" and cut[6] == "Ä ö x" and cut[0] == ""
    each = [tuple(r) for r in pr.run_rows(docs.where("doc_id = 4")).collect()]
    assert each == [(4, 0, 9, 1)]


def test_query_as_a_plain_scan_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000").select("doc_id", "text")
    got = [tuple(r) for r in pr.digests(table, damage=True).collect()]
    assert _sorted(got) == _sorted(_want(r["doc_id"], r["text"]) for r in table.collect())
    assert pr.op12_runs(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_groups_of_texts_change_nothing(monkeypatch):
    docs = texts(random.Random(8))
    monkeypatch.setattr(pr, "QUESTIONS", 3)
    assert pr.runs_of(docs) == [plain(w) for w in docs]
    monkeypatch.setattr(pr, "WORDS", 40)
    said = [b" ".join(w).decode() for w in docs]
    assert [w for _, ws in pr._groups(list(range(len(docs))), said, False) for w in ws] == docs
