"""The corpus pipeline: quality rules, near-duplicates, decontamination, PII surrogates, BPE.

Each stage reads what its predecessor kept, and its decisions take effect: rejected, repeated and contaminated rows go,
personal data is replaced, and the last stage encodes what is left. Stages work row by row: rows that share a doc_id, or
have none, are judged by their own text, and columns beyond those of ``documents`` go along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import bpe, decontaminate, near_dedup, pii, quality
from nearfield.llm.common import documents, settle, settled, sweep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and blank texts have no words and go; texts of any length are counted whole; null languages and sources are
    groups like others; repeated rows stay or go together; an empty table stays empty.
    """
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the least doc_id, then of the least hash of its columns.

    Rows that are equal in all columns leave one; a doc_id with different texts keeps each that has no earlier near copy;
    rows without doc_id come last in their group; null and empty texts are one group; an empty table stays empty.
    """
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go.

    Null and empty texts have no words and stay; an empty benchmark leaves all; long texts are read whole; repeated rows
    stay or go together; an empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; n_chars follows the new text. No row goes.

    Null and empty texts stay as they are; texts of any length take linear time; repeated rows are changed alike; an empty
    table stays empty. A real run sets ``pii.KEY`` to a key of its own.
    """
    return pii.replace_in_documents(docs, pii.KEY)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids themselves, of each document.

    Null and empty texts have no ids; repeated rows are encoded alike; an empty table gives an empty result.
    """
    return bpe.encode_documents(docs, bpe.default_vocabulary(), keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("bpe_encoding", bpe_encoding),
]

#: Fingerprints, surrogates and encoding are not SQL-expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again; tables that a stage needed go once it is written."""
    docs = documents(spark, sf_dir)
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        at = len(settled(spark))
        docs = settle(stage(spark, docs, sf_dir), name)
        made = settled(spark)[at:]
        sweep(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
