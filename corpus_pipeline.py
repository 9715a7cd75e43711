"""The corpus pipeline: five filtering and arranging stages over ``documents``.

Each stage takes (spark, docs, sf_dir) with the columns of documents and returns a DataFrame,
which is written as Parquet and read again as the next stage's docs.  Documents that the
quality rules reject go; then repeated lines go; of each group of near-duplicates one document
stays; sources are mixed to their targets, documents repeating as their epochs say; the last
stage packs what is left into training sequences.

In every stage a null text counts as an empty one, very long texts are taken whole, and an
empty table gives an empty result.  All but the last return the columns of docs, whatever they
are called; rows are told apart by all their columns, not by doc_id alone, so rows of one id or
without an id are judged one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwright.llm import lines, mixing, packing, quality, simhash
from cellwright.llm.common import ROW_KEY, shared_folder, with_row_key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep; null and empty texts go, repeated rows share a verdict."""
    keyed = with_row_key(docs)
    kept = quality.quality_rules(keyed, *ROW_KEY).where("kept").select(*ROW_KEY).distinct()
    return keyed.join(kept, list(ROW_KEY), "left_semi").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without lines whose first like one stands elsewhere; a row left without a word goes.

    Rows without a line to lose, null and empty texts among them, are unchanged; equal rows
    keep the same lines.
    """
    return lines.without_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component; empty and null texts are one component."""
    return simhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, at most twice; rows without a word go, a null source is one source."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places; an empty text is one piece of one id, repeated rows are packed one by one."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Fingerprints, tokens and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are written to the shared folder."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
