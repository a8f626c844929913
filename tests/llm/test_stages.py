"""Each pipeline stage on odd rows: nulls, empty and long texts, repeats, clashing columns, and no rows at all."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, words string, ids string, n_tokens int, root int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    pool = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    a, b = text(120), text(90)
    out = [(k, text(100), "en", "s") for k in range(30)] + [(50, a, "en", "s"), (51, a, "en", "s"), (50, b, None, None), (None, text(80), "en", None), (None, None, None, None)]
    out += [(60, None, "en", "s"), (61, "", "en", "s"), (62, " \n\t", None, "s"), (63, text(60_000), "en", "s"), (64, b + " mail that.92@mail2.example.com now", "en", "s"), (70, a, "en", "s"), (70, a, "en", "s")]
    return [(*r, len(r[1] or ""), "r", 1, "w", "i", 2, 3) for r in out]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, sf_dir, rows, name, stage):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, sf_dir)
    got = out.collect()
    if name == "bpe_encoding":
        assert len(got) == len(rows) and all(len(r["ids"]) == r["n_tokens"] for r in got)
    else:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    every = sorted((r[0] is None, r[0] or 0) for r in rows)
    if name == "quality_rules":  # what has under 50 words goes, and the one text that is 600 times as long as the rest
        assert kept == sorted((r[0] is None, r[0] or 0) for r in rows if 50 <= len((r[1] or "").split()) < 60_000)
    if name == "simhash_near_dedup":
        assert [i for n, i in kept if not n] == [*range(30), 50, 50, 60, 63]
    if name in ("benchmark_decontamination", "pii_surrogates", "bpe_encoding"):
        assert kept == every
    if name == "pii_surrogates":
        changed = {r["doc_id"]: r for r in got}[64]
        assert "that.92@" not in changed["text"] and changed["n_chars"] == len(changed["text"])
    none = stage(spark, docs.limit(0), sf_dir)
    assert none.count() == 0 and none.columns == out.columns


def test_run_sweeps_what_stages_needed(spark, sf_dir):
    held = len(common.settled(spark))
    out = corpus_pipeline.run(spark, sf_dir)
    assert len(common.settled(spark)) <= held + 1  # the input of the last stage
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0 and out.count() > 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default):
            return default

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        common.shared_folder(Fake())
