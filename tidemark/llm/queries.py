"""Queries of the text operators with their SQL equivalents, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, exact_dedup, line_dedup, ngram_join, packing, pipeline, quality, secrets, token_counts, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_packing": packing.op3_packing,
    "op4_token_files": token_files.op4_token_files,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_quality": quality.op10_quality,
    "pipeline": pipeline.run,
}
ORACLES: dict[str, str] = {"op1_ngram_join": ngram_join.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op8_secret_scan": secrets.ORACLE}
if pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = pipeline.ORACLE_SQL
