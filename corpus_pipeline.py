"""Documents through toxicity, exact and near duplicates, benchmark leaks and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm import encoding, exact, latent, packing, simhash, toxicity
from postroom.llm.common import drop, kept_rows, noted, table, text_of, written

VOCABULARY = "byte_bpe_50k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of largest id stays."""
    content = F.sha2(exact.normalised(text_of()), 256)
    return kept_rows(docs, content, exact.kept_of_equal(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near fingerprints (four words, four bits) the row of smallest id stays."""
    return kept_rows(docs, F.xxhash64(text_of()), simhash.kept_of_near(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return latent.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.packed(docs, encoding.vocabulary(VOCABULARY))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Learning, fingerprints and tokenising have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next.

    What a stage wrote besides its result, and the result before it, goes once its own is
    written. The rows returned are read from the last two tables, which stay.
    """
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with noted() as paths:
            docs = written(stage(spark, docs, sf_dir), name)
        drop(spark, before + paths[:-1])
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
