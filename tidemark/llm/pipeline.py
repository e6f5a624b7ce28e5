"""A corpus pipeline: each stage works on all documents that the stage before it kept.

``documents`` lose those of poor quality, then repeated lines, then all but one of each group of near
duplicates, then those that hold benchmark items; the rest is packed into token sequences.  All stages but
the last return the columns of ``documents``; ``n_chars`` follows the text.

Defined results, of each stage: a null text counts as empty, and stays null where it stays; empty and very long
texts are read whole like any others; rows that repeat an id or a text are judged one by one, except that near
duplicates keep one row of each id and text; ties go to the smallest id; an empty table gives an empty table; further
columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, ngram_join, packing, quality
from tidemark.llm.common import store, table
from tidemark.llm.tokens import default_path
from tidemark.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or place has."""
    ship_package(spark)
    out = line_dedup.without_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents."""
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    ship_package(spark)
    return packing.pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, the tokenizer or the linear program; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
