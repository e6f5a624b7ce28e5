"""Inverted attribute index: one row for each (field, key, id)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.attrs import subset


def build(rows: DataFrame, fields: Iterable[str] = ()) -> DataFrame:
    """Index of ``rows (id, attributes)`` over the named fields; no names mean all."""
    entries = rows.select("id", F.explode(subset(F.col("attributes"), fields)).alias("field", "attr"))
    return entries.select("field", F.col("attr.key").alias("key"), "id").distinct()


def maintain(index: DataFrame, touched: DataFrame, live: DataFrame, fields: Iterable[str] = ()) -> DataFrame:
    """The index without the touched ids, and with the live rows."""
    return index.join(touched.select("id"), "id", "left_anti").select("field", "key", "id").unionByName(build(live, fields))


def matching(index: DataFrame, filters: Mapping[str, str]) -> DataFrame | None:
    """Distinct ids that match every clause; None if there is no clause.

    One pass over the postings of the clauses, which Parquet prunes by field: an id matches if it has
    them all, so no posting list meets another in a join.
    """
    if not filters:
        return None
    clauses = F.lit(False)
    for field, key in filters.items():
        clauses = clauses | ((F.col("field") == field) & (F.col("key") == key))
    hits = index.where(clauses).select("id", "field").distinct()
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(filters)).select("id")


def postings(index: DataFrame) -> DataFrame:
    """Posting sizes ``(field, key, n)``."""
    return index.groupBy("field", "key").agg(F.count(F.lit(1)).alias("n"))
