"""The corpus pipeline: five stages over the documents table, each written and read again by the next.

All stages but the last return the columns of documents. ``n_chars`` follows a changed text.

Null texts, null ids, repeated rows, further columns of any name and an empty table pass as the
docstrings of the operators say: a stage drops a row only by its own rule, and rows equal in id and
text are one document for line dedup, near dedup and decontamination.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, linededup, nearcopies, packing, quality
from docloom.llm.common import discard, finished, table, unlike


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; every document stays."""
    total, removed = unlike(docs, "lines_total", "lines_removed")
    cleaned = linededup.dedup_lines(docs, total=total, removed=removed)
    counted = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", counted).drop(total, removed)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles with a similarity of 0.8 or more."""
    return nearcopies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document that is left, with its sequence."""
    return packing.packed_pieces(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Learning, shingle sets and packing aren't SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        after = finished(spark, partial(stage, spark, docs, sf_dir), name)
        if number:
            discard(docs)  # what the stage before wrote is read no more
        docs = after
    return docs
