"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A subword is a run of N letters (N in LENGTHS) with one mark at word ends, hashed into BUCKETS. A text is the mean of
its subwords' embeddings; a linear layer and a softmax give probabilities. Training takes a bounded, documented sample of
labelled rows, for each language the PER_LANG distinct texts of least hash, so that a rare language is learned at any
size; their subwords are counted in the tasks, over whole texts, and only those counts go to the driver. As the layer is
linear, a bucket's embedding times the layer is one row of scores, so a whole text is one sum of rows.

A temperature, fitted on part of the sample kept apart, calibrates the probabilities; ``rejected`` marks rows whose
calibrated probability lies under the quantile that keeps all but REJECT of the right answers there.

Defined cases: a null text, or one without letters, is ``und`` with score 0; with no labelled rows, or an empty table,
every row there is is ``und``; repeated rows are predicted alike and a text counts once in training; of equal
probabilities the first language by name wins; a very long text is read whole, in parts that end between words; lang,
source and doc_id are never inputs of a prediction; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, documents, settle, small_batches

#: Distinct texts of each language that training takes at most.
PER_LANG = 1000
#: Buckets (a power of two), lengths of subwords, width of embeddings, steps, rows of a step and its first rate.
BUCKETS, LENGTHS, WIDTH, STEPS, BATCH, RATE = 1 << 14, (1, 2, 3), 16, 800, 64, 2.0
#: Share of right answers that the rejection threshold may lose; rows kept apart to calibrate, one in so many.
REJECT, APART = 0.01, 5
#: Characters of a text that are turned into subwords at a time, about: a part ends at a space.
PART = 1 << 16
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


class Model(NamedTuple):
    """Scores of each bucket and language, the languages, the temperature and the rejection threshold."""

    scores: np.ndarray
    langs: list[str]
    temperature: float
    threshold: float


def _letters(text: str) -> np.ndarray:
    """Code points in lower case, with 0 for each run of others, at both ends too."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    if low.isascii():
        alpha = (points >= 97) & (points <= 122)
    else:
        seen, back = np.unique(points, return_inverse=True)
        alpha = np.array([chr(c).isalpha() for c in seen])[back]
    kept = np.where(alpha, points, 0)
    kept = np.concatenate(([0], kept, [0])).astype(np.uint32)
    return kept[np.concatenate(([True], (kept[1:] != 0) | (kept[:-1] != 0)))]


def _parts(text: str) -> Iterator[str]:
    """A text in parts that end at a space, so that none cuts a word; a stretch without spaces stays whole."""
    at = 0
    while len(text) - at > PART:
        end = text.rfind(" ", at, at + PART)
        if end <= at:
            end = text.find(" ", at + PART)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def bucket_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket occurs in a whole text; None if it has no letters."""
    if not text:
        return None
    counts = np.zeros(BUCKETS, np.int64)
    any_letter = False
    for part in _parts(text):
        points = _letters(part)
        any_letter |= bool(points.any())
        for n in LENGTHS:
            if len(points) < n:
                continue
            h = np.zeros(len(points) - n + 1, np.uint32)
            whole = np.ones(len(h), bool)
            for k in range(n):
                place = points[k : len(points) - n + 1 + k]
                h = (h ^ place) * _MIX[(n + k) % 3]
                h ^= h >> np.uint32(15)
                if 0 < k < n - 1 or n == 1:
                    whole &= place != 0  # a mark only at an end
            counts += np.bincount(h[whole] & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return counts if any_letter else None


def train(used: list[np.ndarray], weight: list[np.ndarray], said: list[str], seed: int = 7) -> Model | None:
    """Stochastic gradient descent on a bounded sample of buckets, their shares and languages; None if it is empty."""
    names = sorted(set(said))
    if not names:
        return None
    y = np.array([names.index(lang) for lang in said])
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
    out = (rng.standard_normal((WIDTH, len(names))) * 0.1).astype(np.float32)
    apart = np.arange(len(said)) % APART == 0 if len(said) >= 10 * APART else np.zeros(len(said), bool)
    fit = np.flatnonzero(~apart)
    for step in range(STEPS if len(fit) else 0):
        rate = RATE * (1 - step / STEPS)
        ids = fit[rng.integers(0, len(fit), BATCH)]
        mean = np.stack([weight[i] @ emb[used[i]] for i in ids])
        z = mean @ out
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(ids)), y[ids]] -= 1
        back = p @ out.T * (rate / len(ids))
        out -= rate / len(ids) * mean.T @ p
        for i, g in zip(ids, back):
            emb[used[i]] -= 40 * weight[i][:, None] * g  # a mean spreads a step thin over its subwords
    scores = (emb @ out).astype(np.float32)
    held = np.flatnonzero(apart) if apart.any() else np.arange(len(said))
    z = np.stack([weight[i] @ scores[used[i]] for i in held])
    best = min(np.geomspace(0.5, 5, 40), key=lambda t: _loss(z / t, y[held]))
    p = _softmax(z / best)
    right = p.argmax(1) == y[held]
    return Model(scores, names, float(best), float(np.quantile(p.max(1)[right], REJECT)) if right.any() else 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(_softmax(z)[np.arange(len(y)), y] + 1e-12).mean())


def fold(doc_id: Column | str) -> Column:
    """The remainder by 4 of the checksum of a doc_id's text; 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def training_sample(docs: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
    """Buckets, their shares, and languages of at most PER_LANG distinct texts of each lang outside the held-out fold.

    Hashes of texts are thinned by lang first, by an estimate of how many there are, and then cut exactly: no task sorts a
    whole language. Texts stay where they are; tasks count the subwords of those chosen, each text once.
    """
    small_batches(docs.sparkSession)
    rows = docs.where((F.coalesce(fold("doc_id"), F.lit(0)) != 2) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    rows = rows.select(F.xxhash64("text").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    share = F.pmod("h", F.lit(1 << 31)) / float(1 << 31)
    sizes = settle(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "lang-sizes")
    some = rows.select("h", "lang").join(bounded(sizes), "lang").where(share * F.col("n") <= 2 * PER_LANG).select("h", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(share, "h")
    chosen = settle(some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PER_LANG).select("h", "lang"), "sample")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, str]] = set()
        for b in batches:
            out = []
            for h, lang, text in zip(b["h"], b["lang"], b["text"]):
                if (h, lang) not in seen and (c := bucket_counts(text)) is not None:
                    seen.add((h, lang))
                    used = np.flatnonzero(c)
                    out.append((h, lang, used.astype("<u2").tobytes(), (c[used] / c.sum()).astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["h", "lang", "used", "weight"])

    counted = rows.join(bounded(chosen), ["h", "lang"], "left_semi").mapInPandas(run, "h long, lang string, used binary, weight binary")
    got = sorted(counted.dropDuplicates(["h", "lang"]).collect(), key=lambda r: (r["h"], r["lang"]))
    return [np.frombuffer(r["used"], "<u2") for r in got], [np.frombuffer(r["weight"], "<f4") for r in got], [r["lang"] for r in got]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row, from its whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            names, scores = [], []
            for text in b["text"]:
                counts = bucket_counts(text) if m else None
                if counts is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                used = np.flatnonzero(counts)
                p = _softmax((counts[used] / counts.sum()) @ m.scores[used] / m.temperature)
                names.append(m.langs[int(p.argmax())])
                scores.append(float(p.max()))
            out = pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "lang_pred": names, "score": scores})
            yield out.assign(rejected=out["score"] < (m.threshold if m else 1.0))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_langid(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    docs = documents(spark, sf_dir)
    out = predict(docs, train(*training_sample(docs)))
    return out.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
