"""Merge on read: one set of rules for queries and for compaction.

Base rows come from a snapshot, the tail from replaying the log after it.  A tombstone hides a base row
that is not newer; a pending patch changes one that is not newer than the patch, unless a tombstone of the
same log came first; of two rows for an id the newer stays, and the tail's if they are as old.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.attrs import overlay

#: Ids of logs with no more records than this are broadcast.
BROADCAST_RECORDS = 100_000


def mask_tombstones(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Base rows without those deleted at or after their timestamp."""
    dead = tombstones.select(F.col("id").alias("dead_id"), "del_ts")
    return base.join(dead, (F.col("id") == F.col("dead_id")) & (F.col("del_ts") >= F.col("timestamp")), "left_anti")


def overlay_patches(base: DataFrame, pending: DataFrame) -> DataFrame:
    """Base rows with pending patches that are not older applied, at the patch's timestamp."""
    joined = base.join(pending.select("id", "pend_ts", "pend"), "id", "left")
    due = F.coalesce(F.col("pend_ts") >= F.col("timestamp"), F.lit(False))
    changed = joined.withColumns({"attributes": F.when(due, overlay(F.col("attributes"), F.col("pend"))).otherwise(F.col("attributes")), "timestamp": F.when(due, F.col("pend_ts")).otherwise(F.col("timestamp"))})
    return changed.select(*base.columns)


def newest_wins(base: DataFrame, tail: DataFrame) -> DataFrame:
    """One row for each id of either side."""
    names = [c for c in base.columns if c != "id"]
    own = base.select("id", F.struct(*names).alias("b"))
    new = tail.select("id", F.struct(*names).alias("t"))
    both = own.join(new, "id", "full_outer")
    tail_wins = F.col("b").isNull() | F.coalesce(F.col("t.timestamp") >= F.col("b.timestamp"), F.lit(False))
    return both.select("id", F.when(tail_wins, F.col("t")).otherwise(F.col("b")).alias("x")).select("id", *[F.col(f"x.{c}").alias(c) for c in names]).select(*base.columns)


def bounded(ids: DataFrame, records: int) -> DataFrame:
    """``ids`` of a log's state, to be broadcast if the log has few enough records; else joins shuffle as usual."""
    return F.broadcast(ids) if records <= BROADCAST_RECORDS else ids


def merge_tail(base: DataFrame, state: DataFrame, records: int) -> DataFrame:
    """``merge``, with ``records`` in the log: base rows whose ids a short log does not have are not shuffled.

    Only ids are broadcast.  The base is read twice instead, once without the ids of the log and once with no others.
    """
    if records > BROADCAST_RECORDS:
        return merge(base, state)
    touched = bounded(state.select("id"), records)
    return base.join(touched, "id", "left_anti").select(*base.columns).unionByName(merge(base.join(touched, "id", "left_semi").select(*base.columns), state))


def merge(base: DataFrame, state: DataFrame) -> DataFrame:
    """The rows that are live: ``base`` under the state of the log after it (see ``replay``).

    One full outer join by id does all four rules, so base and tail are shuffled once.
    """
    names = [c for c in base.columns if c != "id"]
    own = base.select("id", F.struct(*names).alias("b"))
    new = state.select("id", F.when(F.col("timestamp").isNotNull(), F.struct(*names)).alias("t"), "del_ts", "pend_ts", "pend")
    both = own.join(new, "id", "full_outer")
    hidden = F.coalesce(F.col("del_ts") >= F.col("b.timestamp"), F.lit(False))
    due = F.coalesce(F.col("pend_ts") >= F.col("b.timestamp"), F.lit(False))
    fixed = [
        F.when(due, overlay(F.col("b.attributes"), F.col("pend"))).otherwise(F.col("b.attributes")).alias(c) if c == "attributes"
        else F.when(due, F.col("pend_ts")).otherwise(F.col("b.timestamp")).alias(c) if c == "timestamp"
        else F.col(f"b.{c}").alias(c)
        for c in names
    ]
    base_row = F.when(F.col("b").isNotNull() & ~hidden, F.struct(*fixed))
    both = both.select("id", base_row.alias("b"), "t")
    tail_wins = F.col("b").isNull() | F.coalesce(F.col("t.timestamp") >= F.col("b.timestamp"), F.lit(False))
    out = both.select("id", F.when(tail_wins, F.col("t")).otherwise(F.col("b")).alias("x")).where("x is not null")
    return out.select("id", *[F.col(f"x.{c}").alias(c) for c in names]).select(*base.columns)
