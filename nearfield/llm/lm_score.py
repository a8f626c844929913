"""Cross-entropy difference: matched target and background bigram models that share one vocabulary, that of the corpus.

The target is the documents labelled as good, the background all documents. Both models have the same order, smoothing
and vocabulary: every distinct word, and every distinct pair of neighbours, has counts of its own, however many there are.
Keys of 62 bits stand for them: of a thousand million distinct pairs, fewer than one pair are expected to share a key.

Documents are dealt into chunks of bounded size by hash. Each chunk sends its distinct entries and their counts, sorted and
packed, to ranges of entries; a range adds them up, and answers each chunk with the sums in the order in which the chunk named
its entries. So no entry goes back, and none is a row: the chunk, built again for the scores, has the same entries in the same
order. No table of counts goes to the driver or to all tasks, and no list of chunks is held by entry.
A document's score is the mean over its words of target loss minus background loss, in nats: the lower, the nearer to
the target.

Defined cases: a null or blank text has no words and scores 0; without target rows both models are the background's,
and scores tell only what taking out a text's own counts does; repeated rows are counted and scored each; a doc_id that has several labels is a target if one of them
says so; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import settle
from .common import bounded, documents, table

#: Bits of the key of a word and of a pair.
WORD_BITS, PAIR_BITS = 62, 62
#: Weight of the pair model, and the count that each entry has beforehand.
PAIR_WEIGHT, PRIOR = 0.6, 0.5
#: Bytes of text in a chunk, about, and those of a range of pairs; words are fewer, and have one range for this many of pairs.
CHUNK_BYTES, RANGE_BYTES, WORD_RANGES = 1 << 21, 1 << 24, 8

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values with each bit spread over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    """An odd factor for each place in a word."""
    return _mixed((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_FACTORS = _factors(64)


def word_ids(text: str | None) -> np.ndarray:
    """The keys of a text's words in order; lower case, split at white space."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    ink = ~_BLANK[raw]
    if not ink.any():
        return np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([0], ink.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = starts[0]
    raw, ink, starts, ends = raw[first:], ink[first:], starts - first, ends - first
    at = np.arange(len(raw)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(raw)]))))
    longest = int(at.max()) + 1
    factors = _FACTORS if longest <= len(_FACTORS) else _factors(longest)
    signed = (raw.astype(np.uint64) + np.uint64(1)) * factors[at] * ink
    h = np.add.reduceat(signed, starts) ^ (ends - starts).astype(np.uint64)
    return (_mixed(h) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def pair_ids(words: np.ndarray) -> np.ndarray:
    """The keys of each word with the one before it."""
    h = words[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (_mixed(h) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and whether the document is of the target."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(bounded(good), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))


def in_chunks(flagged: DataFrame, n: int) -> DataFrame:
    """doc_id, text, good and the chunk, one of ``n``, by hash of doc_id and text."""
    return flagged.select("doc_id", "text", "good", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"))


class Chunk:
    """The entries of a chunk's texts in order, words before pairs, as places in its distinct entries."""

    def __init__(self, texts: pd.Series, good: pd.Series):
        each = [word_ids(t) for t in texts]
        self.good = good.to_numpy(bool).astype(np.int64)
        self.n = np.array([len(w) for w in each], np.int64)
        words = np.concatenate(each) if each else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(each)), self.n)
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1  # places of the words that have one before them
        entries = np.concatenate((words + (1 << PAIR_BITS), pair_ids(words)[self.second - 1]))
        self.of = np.concatenate((self.doc, self.doc[self.second]))
        self.entries, self.at = np.unique(entries, return_inverse=True)
        self.background = np.bincount(self.at, minlength=len(self.entries))
        self.target = np.bincount(self.at, self.good[self.of], len(self.entries)).astype(np.int64)

    def own(self) -> np.ndarray:
        """How often each entry of a text occurs in it."""
        _, back, n = np.unique(self.of * len(self.entries) + self.at, return_inverse=True, return_counts=True)
        return n[back]

    def losses(self, counts: np.ndarray, total: float, vocabulary: int, own: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Each text's mean loss of a word in nats, after ``share`` of its own counts is taken out; the first word has no pair."""
        left = np.maximum(counts[self.at] - own * share[self.of], 0.0)
        seen, both = left[: len(self.doc)], left[len(self.doc) :]
        p = (seen + PRIOR) / (np.maximum(total - self.n * share, 0.0) + PRIOR * vocabulary)[self.doc]
        before = np.maximum(seen[self.second - 1], both)
        alone = p[self.second]
        p[self.second] = np.where(before > 0, PAIR_WEIGHT * both / np.maximum(before, 1e-9) + (1 - PAIR_WEIGHT) * alone, alone)
        return np.bincount(self.doc, -np.log(p), len(self.n)) / np.maximum(self.n, 1)


def _packed(values: np.ndarray, shrink: bool) -> bytes:
    """Numbers from 0 in as few bytes each as the greatest needs, first bytes first; ``shrink``: these are far from random."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width, shrink]) + (zlib.compress(planes, 1) if shrink else planes)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[2:]) if data[1] else data[2:], np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8")[:, 0]


def _edges(size: int) -> np.ndarray:
    """The first entry of each range, for ``size`` bytes of text: ranges of pairs, then of words."""
    pairs = max(1, -(-size // RANGE_BYTES))
    words = -(-pairs // WORD_RANGES)
    return np.concatenate((np.arange(pairs) * ((1 << PAIR_BITS) // pairs), np.arange(words) * ((1 << WORD_BITS) // words) + (1 << PAIR_BITS)))


class Counts(NamedTuple):
    """By entry: its target and background counts over all rows. By chunk and range: the same as ``answers``, packed in the order
    of the chunk's entries; a range's first row has the sums of its words, and how many are distinct. And the number of chunks."""

    entries: DataFrame
    answers: DataFrame
    n_chunks: int

    def toPandas(self) -> pd.DataFrame:  # noqa: N802  # as a DataFrame's
        return self.entries.toPandas()


def counts(flagged: DataFrame) -> Counts:
    """The counts of all entries; those of pairs are below those of words."""
    size = flagged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // CHUNK_BYTES))
    edges = _edges(size)

    def sent(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf["text"], pdf["good"])
        cuts, out = np.concatenate((np.searchsorted(c.entries, edges), [len(c.entries)])), []
        for k in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[k], cuts[k + 1])
            out.append((pdf["chunk"].iloc[0], k, _packed(np.diff(c.entries[s], prepend=edges[k]), False), _packed(c.target[s], True), _packed(c.background[s], True)))
        return pd.DataFrame(out, columns=["chunk", "range", "gaps", "target", "background"]).astype({"chunk": "int32", "range": "int32"})

    def summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct entries of a range and their counts, and of each chunk in turn its entries' places and where they begin."""
        each = [np.cumsum(_unpacked(g)) + edges[k] for g, k in zip(pdf["gaps"], pdf["range"])]
        names, at = np.unique(np.concatenate(each), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([_unpacked(x) for x in pdf[c]]), len(names)).astype(np.int64) for c in ("target", "background")]
        return names, *sums, at, np.cumsum([0] + [len(x) for x in each])

    def listed(pdf: pd.DataFrame) -> pd.DataFrame:
        names, target, background, _, _ = summed(pdf)
        return pd.DataFrame({"entry": names, "target": target, "background": background})

    def answered(pdf: pd.DataFrame) -> pd.DataFrame:
        names, target, background, at, starts = summed(pdf)
        places = [at[a:b] for a, b in zip(starts, starts[1:])]
        out = pd.DataFrame({"chunk": pdf["chunk"], "range": pdf["range"], "target": [_packed(target[x], True) for x in places], "background": [_packed(background[x], True) for x in places]})
        of_words = [target.sum(), background.sum(), len(names)] if names[0] >= 1 << PAIR_BITS else [0, 0, 0]
        for name, total in zip(("n_target", "n_background", "vocabulary"), of_words):
            out[name] = np.where(np.arange(len(out)) == 0, total, 0)
        return out

    parts = in_chunks(flagged, n).groupBy("chunk").applyInPandas(sent, "chunk int, range int, gaps binary, target binary, background binary").groupBy("range")
    entries = parts.applyInPandas(listed, "entry long, target long, background long")
    answers = parts.applyInPandas(answered, "chunk int, range int, target binary, background binary, n_target long, n_background long, vocabulary long")
    return Counts(entries, answers, n)


class Models(NamedTuple):
    """Counts whose answers are settled, words of target and background, distinct words, and the number of chunks."""

    table: Counts
    target: int
    background: int
    vocabulary: int
    n_chunks: int


def models(counted: Counts) -> Models:
    """Target and background from the counts; one row of sums goes to the driver."""
    answers = settle(counted.answers, "counts")
    row = answers.agg(*[F.sum(c) for c in ("n_target", "n_background", "vocabulary")]).first()
    return Models(counted._replace(answers=answers), row[0] or 0, row[1] or 0, row[2] or 0, counted.n_chunks)


def score(flagged: DataFrame, fitted: Models) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score (their difference), each a mean over words.

    ``flagged`` are the rows that were counted. A text's own counts are taken out of the models that hold them, so that its
    being counted doesn't draw its score.
    """
    counted, of_target, of_all, vocabulary, n = fitted
    # matched: smoothing then weighs as much in both
    scale = of_target / of_all if of_target else 1.0

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(docs["text"], docs["good"])
        answers = answers.sort_values("range")
        target, background = (np.concatenate([c.entries[:0], *map(_unpacked, answers[name])]) for name in ("target", "background"))
        if len(target) != len(c.entries):
            raise ValueError("the rows are not those that were counted")
        own = c.own()
        t = c.losses(target if of_target else background, of_target or of_all, vocabulary, own, c.good.astype(float))
        b = c.losses(background * scale, of_all * scale, vocabulary, own, np.full(len(docs), scale))
        return pd.DataFrame({"doc_id": docs["doc_id"], "n_words": c.n, "target_loss": t, "background_loss": b, "score": t - b})

    schema = "doc_id long, n_words long, target_loss double, background_loss double, score double"
    answers = counted.answers.select("chunk", "range", "target", "background")
    return in_chunks(flagged, n).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, schema)


def op4_lm(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, both losses and score of every document."""
    flagged = with_target(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return score(flagged, models(counts(flagged)))


#: The same losses in DuckDB, from words and pairs themselves instead of keys, and without chunks.
ORACLE = f"""
with good as (select distinct doc_id from labels where quality = 1 and doc_id is not null),
d as (
    select row_number() over () as k, doc_id, good.doc_id is not null as is_good,
        regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') as w
    from documents left join good using (doc_id)
),
tokens as (select k, is_good, len(w) as n, j, w[j] as word, case when j > 1 then w[j - 1] end as prev from d, lateral (select unnest(range(1, len(w) + 1)) as j)),
words as (select word, count(*) as in_all, count(*) filter (is_good) as in_good from tokens group by word),
pairs as (select prev, word, count(*) as in_all, count(*) filter (is_good) as in_good from tokens where prev is not null group by prev, word),
own_words as (select k, word, count(*) as own from tokens group by k, word),
own_pairs as (select k, prev, word, count(*) as own from tokens where prev is not null group by k, prev, word),
totals as (select count(*) as n_all, count(*) filter (is_good) as n_good, count(distinct word) as vocabulary from tokens),
models as (
    select false as matched, 1.0::double as scale, case when n_good > 0 then n_good else n_all end::double as total, n_good > 0 as of_good, vocabulary from totals
    union all
    select true, case when n_good > 0 then n_good / n_all else 1.0 end::double, case when n_good > 0 then n_good / n_all * n_all else n_all end::double, false, vocabulary from totals
),
counted as (
    select t.k, t.j, t.n, m.matched, m.total, m.vocabulary, t.prev is not null as paired,
        case when m.matched then m.scale when t.is_good then 1.0 else 0.0 end::double as share,
        greatest(case when m.of_good then w.in_good else w.in_all end * m.scale - ow.own * share, 0.0) as seen,
        greatest(case when m.of_good then v.in_good else v.in_all end * m.scale - ov.own * share, 0.0) as seen_prev,
        greatest(case when m.of_good then p.in_good else p.in_all end * m.scale - op.own * share, 0.0) as both_seen
    from tokens t cross join models m
    join words w on w.word = t.word join own_words ow on ow.k = t.k and ow.word = t.word
    left join words v on v.word = t.prev left join own_words ov on ov.k = t.k and ov.word = t.prev
    left join pairs p on p.prev = t.prev and p.word = t.word left join own_pairs op on op.k = t.k and op.prev = t.prev and op.word = t.word
),
alone as (select *, (seen + {PRIOR}) / (greatest(total - n * share, 0.0) + {PRIOR} * vocabulary) as p, greatest(seen_prev, both_seen) as before from counted),
losses as (
    select k, matched, sum(-ln(case when paired and before > 0 then {PAIR_WEIGHT} * both_seen / before + {1 - PAIR_WEIGHT} * p else p end)) / max(n) as loss
    from alone group by k, matched
)
select d.doc_id, len(d.w) as n_words, coalesce(t.loss, 0.0) as target_loss, coalesce(b.loss, 0.0) as background_loss,
    coalesce(t.loss - b.loss, 0.0) as score
from d left join losses t on t.k = d.k and not t.matched left join losses b on b.k = d.k and b.matched
"""
