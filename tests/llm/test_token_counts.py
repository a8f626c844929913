"""Counts of every prefix against the library on the cut texts, and the query on odd rows."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearfield.llm import bpe, token_counts

BITS = ["'s", "'re", "'ll", " ", "!", "?!", "hello", "World", "1", "23", "'", "ß", "É", "<|endoftext|>", "<|start", "\n", "  ", "日本", "ab", "th", "the", "...", "=", "😀", "don't", "'v", "anders", "\x1c", " "]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(bpe.load_vocabulary(bpe.default_vocabulary()))


def test_every_prefix_as_the_library_encodes_the_cut_text(counter, library):
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
        want = [library(text[:k]) for k in range(len(text) + 1)]
        assert counter.prefixes(text) == want
        for budget in (0, 1, 3, 6):
            assert counter.fitting(text, budget) == max(k for k, c in enumerate(want) if c <= budget)


def test_prefixes_of_long_runs(counter, library):
    for word in ("a" * 300, "abc" * 120, "é" * 150, "!?" * 90, "internationalization" * 9):
        assert counter.word_prefixes(word) == [library(word[:k]) for k in range(len(word) + 1)]


def test_every_code_point_as_the_library(library):
    codec = bpe.Codec(bpe.load_vocabulary(bpe.default_vocabulary()))
    newer = [c for a, b in bpe.NEWER for c in (a, (a + b) // 2, b)] + [c for a, b, _ in bpe.CAPITALS for c in (a, b)]
    for c in newer + list(range(0x20, 0x3000, 7)):
        text = f"a{chr(c)}b1{chr(c)}{chr(c)}"
        assert len(codec.encode(text)[0]) // 4 == library(text), hex(c)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBER", 3)
    monkeypatch.setattr(token_counts, "REMEMBER_PAIRS", 2)
    small = token_counts.PrefixCounter(bpe.load_vocabulary(bpe.default_vocabulary()))
    text = "The rain in Spain stays mainly in the plain, the rain in the plain again; a thing apart"
    assert small.count(text) == (library(text), len(text))


def test_query_on_odd_rows(spark, library):
    texts = [None, "", " \n\t", "plain text, twice", "plain text, twice", "x<|endoftext|>y", "word " * 3000, "a" * 50_000]
    docs = spark.createDataFrame([(k, t, "n", 7) for k, t in enumerate(texts)] + [(None, "no id", "n", 7)], "doc_id long, text string, n_bytes string, n_tokens int")
    got = {r["doc_id"]: r for r in token_counts.count_documents(docs, bpe.default_vocabulary(), keep_prefixes=True).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        t = t or ""
        r = got[k]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), library(t), library(t) > 2048)
        assert r["fit_chars"] == max(i for i, c in enumerate(r["prefix_tokens"]) if c <= 2048) and r["prefix_tokens"][-1] == r["n_tokens"]
    none = token_counts.count_documents(docs.limit(0), bpe.default_vocabulary())
    assert none.count() == 0 and none.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]


def test_query_over_the_table(spark, sf_dir, library):
    got = token_counts.op13_prefix_counts(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")), "doc_id").collect()
    assert got and all(r["n_tokens"] == library(r["text"] or "") and r["n_bytes"] == len((r["text"] or "").encode()) for r in got)
