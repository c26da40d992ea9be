"""Corpus pipeline over documents: language ID, line dedup, near-dedup, benchmark decontamination, tokens.

Every stage takes all that its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm.common import read, table
from trackweave.llm.decontaminate import drop_contaminated
from trackweave.llm.language import recognised
from trackweave.llm.lines import dedup_lines
from trackweave.llm.pieces import encode_documents
from trackweave.llm.simhash import drop_near_duplicates


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go."""
    return recognised(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; a document all of whose lines go stays, with an empty text."""
    return dedup_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with merge dropout, drawn anew for each occurrence of a word, and whether they decode to the text."""
    return encode_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", token_stage),
]
#: SQL expresses neither the fitted language model nor the merge segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
