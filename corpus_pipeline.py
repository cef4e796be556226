"""The corpus pipeline: language, exact copies, near copies, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
Each works on all rows it is given; the docstrings of the operators say what nulls, empty texts, ties,
repeated rows, empty tables and extra columns give. Stages with Python workers ask for small Arrow batches,
since an executor keeps what earlier stages took outside the heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterline.catalog.registry import table
from rosterline.llm import exact, language, mixing, neardup, packing
from rosterline.llm.common import written
from rosterline.session import small_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter or resemble no language."""
    small_batches(spark)
    return language.drop_unknown(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    small_batches(spark)
    return exact.drop_equal(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    small_batches(spark)
    return neardup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions; rows repeat, and one per source is cut to the word."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces at their places in sequences of 2048."""
    small_batches(spark)
    return packing.pack(docs).drop("_row")


STAGES = [
    ("language", identify_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

# Language prototypes and packing have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from the written output of the one before."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
