"""From raw documents to packed training sequences, a table between any two stages.

Every stage takes the table its predecessor wrote; all but the last return the columns of ``documents``. Texts that no classifier
claims go, of equal texts one row stays, of each class of near copies one row stays, sources are mixed (a row may come
twice), and what is left is packed into sequences of 1,024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelake.llm import exact_dedup, language_id, mixing, near_dedup, packing
from sitelake.llm.common import stored, table
from sitelake.session import ship_package

# A score of 0.5 is a classifier that neither claims nor disowns a text; texts in two languages come close to it and stay.
# Unlearned languages come close to it too: texts that the landmarks don't cover go whatever their score.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted_rows(docs, least=LEAST_SCORE, learned_only=True)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

# Language ID, near-dedup and tokenization can't be expressed in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
