"""BPE encoding and decoding with forced-boundary splitting.

A pair of adjacent symbols that no token of the vocabulary contains can never be merged over, so a cut there is certain:
the parts are encoded on their own and their ids put in a row. Parts recur, so a worker remembers the ids of the words
and parts it has seen, up to a bound; what it forgets it encodes again.

The vocabulary file is read once on the driver, a fixed few MB, and sent to the executors with the task. Normal form,
lower case and the splitting of words follow the tokenizer file: NFC, one case mapping for each character, runs of
letters, single digits, runs of other signs, and a suffix on the last symbol of each.

Defined cases: a null or blank text has no ids and decodes to the empty text; special tokens in a text become their ids,
as in the library; repeated rows are encoded alike; a very long text, or a very long word, takes n log n steps; an empty
table gives an empty result; ties between equal pairs go to the leftmost; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

#: White space of the tokenizer's pattern; Python's own also counts four ASCII separators.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: First and last code point of letters and digits that the tokenizer's pattern takes for other signs, as
#: they are newer than its tables.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Capital letters newer than Python's tables, first, last and the distance to the small letter.
CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]
_NEWER_SET = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]"
_NEWER = regex.compile(_NEWER_SET)
_SMALL = {c: c + d for a, b, d in CAPITALS for c in range(a, b + 1)}
_CAPITAL = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in CAPITALS) + "]")
#: What Python's split() takes for white space and the pattern does not.
_NOT_SPACE = regex.compile(r"[\x1c-\x1f]")
#: Words, parts and their ids that a worker remembers; of words, as many from before the last clearing too.
REMEMBER = 150_000
#: Beyond so many symbols a part's merges are found with a heap.
LONG = 64


class Vocabulary(NamedTuple):
    """What encoding and decoding need of a tokenizer file."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    suffix: str
    special: dict[str, int]
    pattern: str


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer file of this kind: BPE over byte symbols with a suffix at word ends; no decoder."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Vocabulary(model["vocab"], {p: k for k, p in enumerate(pairs)}, model["end_of_word_suffix"] or "", {t["content"]: t["id"] for t in spec["added_tokens"]}, split["pattern"]["Regex"])


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is printable, else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def inner_pairs(vocabulary: Vocabulary) -> frozenset[tuple[str, str]]:
    """The pairs of symbols that some token contains; any other pair is a certain cut."""
    found = set()
    for token in vocabulary.ids:
        body = token.removesuffix(vocabulary.suffix) if vocabulary.suffix else token
        found.update(zip(body, body[1:]))
    return frozenset(found)


def normal(text: str) -> str:
    """The normal form that is split into words: NFC, and one case mapping for each character.

    Python alone makes a last capital sigma a final one, and does not know the newest capitals.
    """
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.translate(_SMALL) if _CAPITAL.search(text) else text).replace("Σ", "σ").lower()


def words_of(line: str) -> list[str]:
    """The stretches of a normal form between white space."""
    return line.split() if not _NOT_SPACE.search(line) else [w for w in regex.split(f"[{_SPACE}]+", line) if w]


class Codec:
    """Encodes and decodes one text at a time; what it remembers is bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.inner = inner_pairs(vocabulary)
        self.tokens = {k: t for t, k in vocabulary.ids.items()} | {k: t for t, k in vocabulary.special.items()}
        self.packed = {t: k.to_bytes(4, "little") for t, k in (vocabulary.ids | vocabulary.special).items()}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        pattern = vocabulary.pattern.replace(r"\s", _SPACE)
        self.usual = regex.compile(pattern).findall
        for c in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(c, f"[{c}--{_NEWER_SET}]")
        self.newest = regex.compile(pattern, regex.V1).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.symbols = byte_symbols()

    def find(self, word: str) -> list[str]:
        """The runs of a word: a contraction's end, letters, one digit, other signs."""
        return self.usual(word) if word.isascii() or not _NEWER.search(word) else self.newest(word)

    def merged(self, part: list[str]) -> list[str]:
        """The merges of a short part: the pair of least rank first, the leftmost of equals."""
        get, none = self.v.ranks.get, len(self.v.ranks)
        ranks = [get(p, none) for p in zip(part, part[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            part[k : k + 2] = [part[k] + part[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((part[k - 1], part[k]), none)
            if k < len(ranks):
                ranks[k] = get((part[k], part[k + 1]), none)
        return part

    def merged_long(self, part: list[str]) -> list[str]:
        """The same for a long part in n log n steps: a heap of ranked pairs over a linked list."""
        ranks, n = self.v.ranks, len(part)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k, part[k], part[k + 1]) for k in range(n - 1) if (r := ranks.get((part[k], part[k + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if gone[k] or j < 0 or part[k] != left or part[j] != right:
                continue
            part[k], gone[j] = left + right, True
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a in (before[k], k):
                if a >= 0 and (b := after[a]) >= 0 and (r := ranks.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, part[a], part[b]))
        return [p for k, p in enumerate(part) if not gone[k]]

    def part_ids(self, part: str, last: bool) -> bytes:
        """The packed ids of a part between two cuts; the last of a run ends in the suffix."""
        known = self.parts[last]
        got = known.get(part)
        if got is None:
            symbols = list(part)
            if last:
                symbols[-1] += self.v.suffix
            merged = self.merged(symbols) if len(symbols) <= LONG else self.merged_long(symbols)
            got = b"".join([self.packed[s] for s in merged])
            if len(part) <= LONG:
                if len(known) >= REMEMBER:
                    known.clear()
                known[part] = got
        return got

    def word_ids(self, word: str) -> bytes:
        """The packed ids of a stretch without white space, which may hold several runs."""
        out: list[bytes] = []
        plain = word.isascii() and word.isprintable()  # then bytes are their own symbols
        for run in [word] if plain and word.isalpha() else self.find(word):
            line = run if plain else "".join([self.symbols[b] for b in run.encode("utf-8", "surrogatepass")])
            at = 0
            if not self.inner.issuperset(zip(line, line[1:])):
                for k, pair in enumerate(zip(line, line[1:]), 1):
                    if pair not in self.inner:
                        out.append(self.part_ids(line[at:k], False))
                        at = k
            out.append(self.part_ids(line[at:] if at else line, True))
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Packed ids of a word, from what was remembered before the last clearing or worked out now."""
        got = self.older.get(word)
        if got is None:
            got = self.word_ids(word)
        if len(word) <= LONG:
            if len(self.words) >= REMEMBER:
                self.older = dict(self.words)
                self.words.clear()
            self.words[word] = got
        return got

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and their decoded text."""
        pieces = self.specials.split(text) if text and any(t in text for t in self.v.special) else [text or ""]
        ids: list[bytes] = []
        known = self.words
        for k, piece in enumerate(pieces):
            if k % 2:
                ids.append(self.packed[piece])
                continue
            ids += [known.get(w) or self._word(w) for w in words_of(normal(piece))]
        packed = b"".join(ids)
        return packed, self.decode(np.frombuffer(packed, "<u4").tolist())

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids with a space between them: the file has no decoder of its own."""
        return " ".join([self.tokens[k] for k in ids])


#: The codec of this Python worker, which outlives a task; what it remembers is only ever a shortcut.
_CODEC: dict[str, Codec] = {}


def _codec(key: str, vocabulary: Vocabulary) -> Codec:
    if key not in _CODEC:
        _CODEC.clear()
        _CODEC[key] = Codec(vocabulary)
    return _CODEC[key]


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False, keep_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; where asked for, the ids and the decoded text too."""
    spark = docs.sparkSession
    small_batches(spark)
    loaded = load_vocabulary(path)
    with open(path, "rb") as f:
        key = hashlib.file_digest(f, "sha256").hexdigest()
    vocabulary = spark.sparkContext.broadcast(loaded)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_decoded else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(key, vocabulary.value)
        for b in batches:
            rows = []
            for text in b["text"]:
                ids, said = codec.encode(text)
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()]
                rows.append(row + ([np.frombuffer(ids, "<u4").astype(np.int32)] if keep_ids else []) + ([said] if keep_decoded else []))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")][1:])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def default_vocabulary() -> str:
    """The public word BPE of 49,408 ids."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encode_documents(documents(spark, sf_dir), default_vocabulary())
