"""Runs of words that repeat with a period, found with a recompression grammar.

The words of many texts, with a sign of its own between any two, are one sequence. It is compressed in turns: blocks of equal
symbols become one symbol each, then pairs of a symbol of one half of the alphabet and one of the other become one symbol
each, the halves being drawn anew each time, until every text is one symbol. These levels are a run-length grammar of the
sequence. Equal stretches are compressed alike but at their ends, so how far the sequence agrees from two places on is found by
going up while both places begin their symbols, stepping over one block or pair where they don't, and going down again where
symbols differ: a few steps a level, for all questions at once. The same levels read backwards answer how far it agrees before.

A run of period q and at least 4q words holds two neighbouring places of the grid of step 2q, from which the words q later are
the same. So only such places are asked, for each q: n/2 + n/4 + n/6 ... comparisons. Both answers give the whole stretch of
that period. A stretch with a lesser period has one that divides q, and is found with it too; the least is kept.

Rows are independent: no shuffle, and a worker holds the grammar of a bounded number of words, or of one longer text.

Defined cases: a null or blank text has no words and no runs; a null doc_id is not damaged; repeated rows give equal rows;
texts of any length are read whole, in memory in proportion to it; an empty table gives an empty result; ties between longest
runs go to the first, then to the least period; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Words whose grammar a worker holds at once (a longer text alone), and questions that are asked at once.
WORDS, QUESTIONS = 60_000, 1 << 16


class Level(NamedTuple):
    """A sequence of symbols and how it is compressed: blocks of equal symbols, or pairs."""

    symbols: np.ndarray
    #: Words that a symbol stands for.
    words: np.ndarray
    #: Whether a symbol begins one of the next level, and the place of that; both empty in the last level.
    first: np.ndarray
    parent: np.ndarray
    #: Symbols from here to the end of the block; empty where pairs are compressed.
    left: np.ndarray


def _next(level: np.ndarray, words: np.ndarray, first: np.ndarray, fresh: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols and words of the next level: ``fresh`` keys (0: as before) get new symbols from ``total`` on."""
    starts = np.flatnonzero(first)
    symbols = level[starts]
    new = np.flatnonzero(fresh)
    symbols[new] = total + np.unique(fresh[new], return_inverse=True)[1]
    return symbols, np.add.reduceat(words, starts, dtype=np.int32)


def grammar(symbols: np.ndarray, n_between: int) -> list[Level]:
    """The levels over a sequence whose symbols under ``n_between`` occur once each and part the texts."""
    symbols, words = symbols.astype(np.int32), np.ones(len(symbols), np.int32)
    none = np.empty(0, np.int32)
    levels: list[Level] = []
    total = int(symbols.max()) + 1
    while True:
        # blocks of equal symbols
        first = np.r_[True, symbols[1:] != symbols[:-1]]
        if not first.all():
            starts = np.flatnonzero(first)
            size = np.diff(np.r_[starts, len(symbols)])
            parent = np.cumsum(first, dtype=np.int32) - 1
            levels.append(Level(symbols, words, first, parent, ((starts + size)[parent] - np.arange(len(symbols))).astype(np.int32)))
            fresh = np.where(size > 1, symbols[starts].astype(np.int64) * (len(symbols) + 1) + size, 0)
            symbols, words = _next(symbols, words, first, fresh, total)
            total = max(total, int(symbols.max()) + 1)
        # pairs: a symbol's half is a bit of a product that mixes its number with the level's
        inner = symbols >= n_between
        if not (inner[1:] & inner[:-1]).any():
            return [*levels, Level(symbols, words, none, none, none)]
        mixed = (symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(levels) * 0xBF58476D1CE4E5B9 % 2**64)) * np.uint64(0x94D049BB133111EB)
        half = (mixed >> np.uint64(63)).astype(bool)
        left, right = inner & half, inner & ~half
        ones, others = left[:-1] & right[1:], right[:-1] & left[1:]
        pair = ones if ones.sum() >= others.sum() else others
        if pair.any():
            first = np.r_[True, ~pair]
            levels.append(Level(symbols, words, first, np.cumsum(first, dtype=np.int32) - 1, none))
            starts = np.flatnonzero(first)
            after = np.r_[symbols, 0][starts + 1]
            fresh = np.where(np.r_[pair, False][starts], symbols[starts].astype(np.int64) * total + after + 1, 0)
            symbols, words = _next(symbols, words, first, fresh, total)
            total = max(total, int(symbols.max()) + 1)
        else:  # an unlucky draw: the same sequence again, halved anew
            levels.append(Level(symbols, words, np.ones(len(symbols), bool), np.arange(len(symbols), dtype=np.int32), none))


def backwards(levels: list[Level]) -> list[Level]:
    """The levels as they are read from the end of the sequence."""
    out = []
    for k, level in enumerate(levels):
        symbols, words = level.symbols[::-1].copy(), level.words[::-1].copy()
        if not len(level.first):
            out.append(Level(symbols, words, level.first, level.parent, level.left))
            continue
        first = np.r_[level.first[1:], True][::-1]
        parent = np.int32(len(levels[k + 1].symbols) - 1) - level.parent[::-1]
        starts = np.flatnonzero(first)
        left = (np.r_[starts[1:], len(first)][parent] - np.arange(len(first))).astype(np.int32) if len(level.left) else level.left
        out.append(Level(symbols, words, first, parent, left))
    return out


def agreement(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For places a and b of the first level, not equal: how many words from there on are the same."""
    total = np.zeros(len(a), np.int64)
    who = np.arange(len(a))
    stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in levels[:-1]:
        same = level.symbols[a] == level.symbols[b]
        stopped.append((who[~same], a[~same], b[~same]))
        who, a, b = who[same], a[same], b[same]
        inside = np.flatnonzero(~(level.first[a] & level.first[b]))
        goes_on = np.ones(len(a), bool)
        if len(inside):  # over the rest of a block, or over the second of a pair
            x, y = a[inside], b[inside]
            if len(level.left):
                step = np.minimum(level.left[x], level.left[y])
                goes_on[inside] = level.left[x] == level.left[y]
            else:
                step = np.ones(len(inside), np.int64)
            total[who[inside]] += step * level.words[x]
            a[inside], b[inside] = x + step, y + step
        ends = ~goes_on
        if ends.any():
            s = stopped[-1]
            stopped[-1] = (np.r_[s[0], who[ends]], np.r_[s[1], a[ends]], np.r_[s[2], b[ends]])
            who, a, b = who[goes_on], a[goes_on], b[goes_on]
        a, b = level.parent[a], level.parent[b]
    top = levels[-1]
    while True:
        same = top.symbols[a] == top.symbols[b]
        if len(stopped) < len(levels):
            stopped.append((who[~same], a[~same], b[~same]))
        else:
            s = stopped[-1]
            stopped[-1] = (np.r_[s[0], who[~same]], np.r_[s[1], a[~same]], np.r_[s[2], b[~same]])
        who, a, b = who[same], a[same], b[same]
        if not len(who):
            break
        total[who] += top.words[a]
        a, b = a + 1, b + 1
    # down again: symbols differ, but what they stand for may begin alike
    who = a = b = np.empty(0, np.int64)
    for k in range(len(levels) - 1, 0, -1):
        who, a, b = (np.r_[x, y] for x, y in zip((who, a, b), stopped[k]))
        if not len(who):
            continue
        level = levels[k - 1]
        starts = np.flatnonzero(level.first)
        a, b = starts[a], starts[b]
        same = np.flatnonzero(level.symbols[a] == level.symbols[b])
        if len(same):
            x, y = a[same], b[same]
            step = np.minimum(level.left[x], level.left[y]) if len(level.left) else np.ones(len(same), np.int64)
            total[who[same]] += step * level.words[x]
            a[same], b[same] = x + step, y + step
    return total


def stretches(symbols: np.ndarray, n_between: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a sequence that begins and ends with, and is parted by, symbols under ``n_between``.

    ``longest`` is the number of words of the longest text.
    """
    n = len(symbols)
    at, period = [], []
    for q in range(1, longest // TIMES + 1):
        step = 2 * q
        hit = np.flatnonzero((symbols[: n - q - 1 : step] == symbols[q : n - 1 : step]) & (symbols[1 : n - q : step] == symbols[q + 1 :: step]))
        if len(hit):
            at.append(hit * step)
            period.append(np.full(len(hit), q))
    none = np.empty(0, np.int64)
    if not at:
        return none, none, none
    place, period = np.concatenate(at), np.concatenate(period)
    forward = grammar(symbols, n_between)
    back = backwards(forward)
    found = []
    for k in range(0, len(place), QUESTIONS):
        i, q = place[k : k + QUESTIONS], period[k : k + QUESTIONS]
        end = i + q + agreement(forward, i.copy(), i + q)
        start = i - agreement(back, n - i, n - i - q)
        long = end - start >= np.maximum(LEAST, TIMES * q)
        found.append(np.unique(np.stack([start[long], end[long], q[long]]), axis=1))
    start, end, q = np.unique(np.concatenate(found, axis=1), axis=1)
    least = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    return start[least], end[least], q[least]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: what stands between white space of ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def damaged(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words after the damage of the contract: in every tenth document, by its id, the end repeats with a period."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    number: dict[bytes, int] = {}
    between = len(texts) + 1
    parts = [np.array([0], np.int32)]
    for k, words in enumerate(texts, 1):
        parts += [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)) + np.int32(between), np.array([k], np.int32)]
    first = np.cumsum([1] + [len(w) + 1 for w in texts])
    start, end, period = stretches(np.concatenate(parts), between, max(map(len, texts), default=0))
    which = np.searchsorted(first, start, side="right") - 1
    for k, s, e, q in zip(which.tolist(), (start - first[which]).tolist(), (end - first[which]).tolist(), period.tolist()):
        out[k].append((s, e - s, q))
    return [sorted(o, key=lambda r: (r[0], r[2])) for o in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def _groups(ids: list, texts: list[str | None], damage: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Documents in groups of bounded words."""
    held, words, n = [], [], 0
    for doc_id, text in zip(ids, texts):
        own = words_of(text)
        own = damaged(doc_id, own) if damage else own
        if held and n + len(own) > WORDS:
            yield held, words
            held, words, n = [], [], 0
        held.append(doc_id)
        words.append(own)
        n += len(own)
    if held:
        yield held, words


def _report(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(collapsed(words, runs))
    return (doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _mapped(docs: DataFrame, schema: str, rows, damage: bool) -> DataFrame:
    """Rows made of each document's id, words and runs."""
    small_batches(docs.sparkSession)
    kind = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(kind)
        for b in batches:
            for ids, words in _groups(b.column(0).to_pylist(), b.column(1).to_pylist(), damage):
                out = [row for doc_id, own, runs in zip(ids, words, runs_of(words)) for row in rows(doc_id, own, runs)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def run_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text."""
    return _mapped(docs, "doc_id long, start long, length long, period long", lambda doc_id, words, runs: ((doc_id, *r) for r in runs), False)


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_runs): each text with its runs cut to one period, its words joined by one space."""
    return _mapped(docs, "doc_id long, text string, n_runs long", lambda doc_id, words, runs: [(doc_id, b" ".join(collapsed(words, runs)).decode(), len(runs))], False)


def digests(docs: DataFrame, damage: bool = False) -> DataFrame:
    """One row a document: the number of its runs, the longest of them, and digests of all runs and of the collapsed text."""
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _mapped(docs, schema, lambda doc_id, words, runs: [_report(doc_id, words, runs)], damage)


def op12_runs(spark, sf_dir: str) -> DataFrame:
    """Runs, longest run and digests of every document of the damaged table."""
    return digests(documents(spark, sf_dir), damage=True)
