"""Exact token counts of every prefix by dynamic programming.

In a BPE encoding every two adjacent tokens encode their joined text as those two tokens, and a sequence of tokens of which
that is true is the encoding. So the encoding of a prefix is that of a shorter one and one token more: the only token that
ends there and agrees with the last one of the shorter prefix. Going over the places of a run from left to right, the last
token and the count of every prefix are found with a bounded number of lookups each, and nothing is encoded twice. Whether
two tokens agree is worked out by merging them once, and remembered.

The last symbol of a run carries the suffix of word ends, also where a text is cut within a word. So two tables are kept for
a run: prefixes that go on, and prefixes that end there. Counts of words add up, as no token spans two words.

With the counts of all prefixes stored, the longest prefix within a budget, the tokens of a cut text, and whether a text is
over a limit are lookups. Prefixes are counted in code points of the normal form (NFC, small letters), in which a text of
ASCII keeps its places.

Defined cases: a null or blank text has no tokens, and null has no bytes and one prefix, the empty one; special tokens in a
text count one, and a cut within one leaves plain signs; repeated rows are counted alike; a very long text or word takes
time in proportion to its length; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _SPACE, LONG, Codec, Vocabulary, default_vocabulary, load_vocabulary, normal, words_of
from .common import documents, small_batches

#: Words (and heads of runs), and pairs of tokens, that a worker remembers; of words, as many from before the last clearing too.
REMEMBER, REMEMBER_PAIRS = 200_000, 400_000
#: Symbols of a run whose tables are remembered for the runs that begin alike.
HEAD = 4
#: Tokens that a text may have in the registered query.
LIMIT = 2048

_STRETCH = regex.compile(f"[^{_SPACE}]+")


class PrefixCounter(Codec):
    """Counts of every prefix of one text at a time; what it remembers is bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        ends = {t for t in vocabulary.ids if vocabulary.suffix and t.endswith(vocabulary.suffix)}
        self.inside = {t: k for t, k in vocabulary.ids.items() if t not in ends}
        self.ending = {t.removesuffix(vocabulary.suffix): vocabulary.ids[t] for t in ends} if ends else self.inside
        self.longest = max(map(len, [*self.inside, *self.ending]), default=1)
        self.agreed: dict[int, bool] = {}
        self.heads: dict[str, tuple[list[int], list[int]]] = {}
        self.counts: dict[str, int] = {}
        self.counts_before: dict[str, int] = {}

    def _symbols(self, token: int) -> list[str]:
        text = self.tokens[token]
        if self.v.suffix and text.endswith(self.v.suffix):
            body = list(text.removesuffix(self.v.suffix))
            body[-1] += self.v.suffix
            return body
        return list(text)

    def agree(self, left: int, right: int) -> bool:
        """Whether two tokens side by side encode as themselves; with left -1, whether the right one does alone."""
        key = (left + 1) << 24 | right
        known = self.agreed.get(key)
        if known is None:
            symbols = (self._symbols(left) if left >= 0 else []) + self._symbols(right)
            known = self.merged(symbols) == ([self.tokens[left]] if left >= 0 else []) + [self.tokens[right]]
            if len(self.agreed) >= REMEMBER_PAIRS:
                self.agreed.clear()
            self.agreed[key] = known
        return known

    def _ends(self, line: str, end: int, tokens: dict[str, int], last: list[int]) -> tuple[int, int]:
        """Start and id of the last token of ``line[:end]``: the one that ends there and agrees with what was before it."""
        get, agreed = tokens.get, self.agreed.get
        for start in range(end - self.longest if end > self.longest else 0, end):
            token = get(line[start:end])
            if token is not None:
                known = agreed((last[start] + 1) << 24 | token)
                if known or known is None and self.agree(last[start], token):
                    return start, token
        raise ValueError(f"no token of the vocabulary ends {line[:end]!r}")

    def _open(self, line: str, most: int) -> tuple[list[int], list[int]]:
        """Last token and count of the first ``most`` prefixes of a run that goes on; short ones start from a known head."""
        head = line[:HEAD] if most >= HEAD else ""
        known = self.heads.get(head)
        if known is None:
            known = [-1], [0]
            self._more(head, HEAD, *known)
            if len(self.heads) >= REMEMBER:
                self.heads.clear()
            self.heads[head] = known
        last, n = known[0].copy(), known[1].copy()
        self._more(line, most, last, n)
        return last, n

    def _more(self, line: str, most: int, last: list[int], n: list[int]) -> None:
        tokens = self.inside
        for end in range(len(last), min(most, len(line)) + 1):
            start, token = self._ends(line, end, tokens, last)
            last.append(token)
            n.append(n[start] + 1)

    def run_counts(self, line: str, at: list[int]) -> list[int]:
        """Counts of the prefixes of a run of byte symbols that end at the places ``at``."""
        last, n = self._open(line, len(line) - 1)
        return [n[self._ends(line, end, self.ending, last)[0]] + 1 for end in at]

    def _line(self, run: str) -> str:
        return run if run.isascii() and run.isprintable() else "".join([self.symbols[b] for b in run.encode("utf-8", "surrogatepass")])

    def word_count(self, word: str) -> int:
        """Tokens of a stretch without white space."""
        got = self.counts_before.get(word)
        if got is None:
            got = 0
            for run in self.find(word):
                line = self._line(run)
                got += self.run_counts(line, [len(line)])[0]
        if len(word) <= LONG:
            if len(self.counts) >= REMEMBER:
                self.counts_before = dict(self.counts)
                self.counts.clear()
            self.counts[word] = got
        return got

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of a stretch without white space, by code points, from the empty one on."""
        out = [0]
        for run in self.find(word):
            base = out[-1]
            if run[0] == "'" and len(run) > 1 and run[1].isalpha():  # a contraction's end that is cut falls apart
                out += [base + sum(self.word_count(r) for r in self.find(run[:k])) for k in range(1, len(run) + 1)]
                continue
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in run]).tolist()
            out += [base + c for c in self.run_counts(self._line(run), ends)]
        return out

    def pieces(self, text: str | None) -> list[tuple[str, bool]]:
        """The text in normal form, cut at special tokens, and whether a piece is one."""
        parts = self.specials.split(text) if text and any(t in text for t in self.v.special) else [text or ""]
        return [(p, True) if k % 2 else (normal(p), False) for k, p in enumerate(parts)]

    def _words_count(self, line: str) -> int:
        known, total = self.counts.get, 0
        for w in words_of(line):
            c = known(w)
            total += self.word_count(w) if c is None else c
        return total

    def count(self, text: str | None) -> tuple[int, int]:
        """Tokens of a whole text, the count of its last prefix, and the code points of its normal form."""
        pieces = self.pieces(text)
        return sum(1 if special else self._words_count(piece) for piece, special in pieces), sum(len(piece) for piece, _ in pieces)

    def prefixes(self, text: str | None) -> list[int]:
        """Tokens of every prefix of the normal form, from the empty one to the whole."""
        out, tail = [0], ""
        for piece, special in self.pieces(text):
            if special:  # cut short it is plain text, and joins the stretch before it
                whole = out[-1] + 1
                start = out[-1 - len(tail)]
                out += [start + c for c in self.word_prefixes(tail + piece)[len(tail) + 1 :]]
                out[-1], tail = whole, ""
                continue
            at, tail = len(out) - 1, ""
            for m in _STRETCH.finditer(piece):
                tail = m.group() if m.end() == len(piece) else ""
                out += [out[-1]] * (at + m.start() + 1 - len(out))
                start = out[-1]
                out += [start + c for c in self.word_prefixes(m.group())[1:]]
            out += [out[-1]] * (at + len(piece) + 1 - len(out))
        return out

    def fitting(self, text: str | None, budget: int) -> int:
        """Code points of the longest prefix of the normal form with at most ``budget`` tokens.

        Each word has a token at least, so that prefix ends within the first word that passes the budget.
        """
        pieces = self.pieces(text)
        if len(pieces) > 1:
            return max((k for k, c in enumerate(self.prefixes(text)) if c <= budget), default=0)
        used, piece = 0, pieces[0][0]
        for m in _STRETCH.finditer(piece):
            c = self.counts.get(m.group())
            c = self.word_count(m.group()) if c is None else c
            if used + c > budget:
                return m.start() + max((k for k, p in enumerate(self.word_prefixes(m.group())) if used + p <= budget), default=0)
            used += c
        return len(piece)


#: The counter of this Python worker, which outlives a task; what it remembers is only ever a shortcut.
_COUNTER: dict[str, PrefixCounter] = {}


def _counter(key: str, vocabulary: Vocabulary) -> PrefixCounter:
    if key not in _COUNTER:
        _COUNTER.clear()
        _COUNTER[key] = PrefixCounter(vocabulary)
    return _COUNTER[key]


def count_documents(docs: DataFrame, path: str, budget: int = LIMIT, keep_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars of each row: whether it has more than ``budget`` tokens, and the
    code points of the longest prefix of its normal form that has not. Where asked for, the counts of all prefixes too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    loaded = load_vocabulary(path)
    with open(path, "rb") as f:
        key = hashlib.file_digest(f, "sha256").hexdigest()
    vocabulary = spark.sparkContext.broadcast(loaded)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + (", prefix_tokens array<int>" if keep_prefixes else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, vocabulary.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [counter.count(t) for t in texts]
            fit = [counter.fitting(t, budget) if c > budget else length for t, (c, length) in zip(texts, n)]
            out = {"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "n_tokens": pa.array([c for c, _ in n], pa.int64()), "over_limit": pa.array([c > budget for c, _ in n], pa.bool_()), "fit_chars": pa.array(fit, pa.int64())}
            if keep_prefixes:
                out["prefix_tokens"] = pa.array([counter.prefixes(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, schema)


def op13_prefix_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars of every document."""
    return count_documents(documents(spark, sf_dir), default_vocabulary())
