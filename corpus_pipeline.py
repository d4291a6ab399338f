"""From raw documents to a training mix: language identification, line dedup, near-duplicate removal, decontamination, mixing.

Each stage gets what its predecessor kept, as a table, and returns the documents it keeps in their own columns; the last adds what
the mix takes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studylake.llm.common import materialize, read_table
from studylake.llm.decontaminate import drop_contaminated
from studylake.llm.languages import drop_unknown
from studylake.llm.line_dedup import drop_lines
from studylake.llm.mixing import mixed
from studylake.llm.near_dedup import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language has at least half of the text go, and those without a letter."""
    return drop_unknown(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than three in ten documents of a source share go out of the texts, and sentences that one in a hundred share."""
    return drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1, … in whole copies; adds mix_size, mix_target, mix_taken and mix_copies, drops what is not taken."""
    return mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Learned languages and components have no SQL; the tests hold the stages against plain readings.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
