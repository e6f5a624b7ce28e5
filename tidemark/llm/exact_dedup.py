"""Exact dedup as a log-structured merge index, in DataFrame operations only.

* **Memtable flush.**  Each input task is one memtable: it digests its texts, sorts the entries by
  digest and writes them as one run, without a shuffle.  Runs are Parquet files whose digest column
  carries a Parquet Bloom filter, so a later point lookup skips runs that cannot hold a digest.
* **Compaction.**  All runs are merged by digest into the next level: one entry per digest with the
  identifier that stays and the number of entries.  Only digests and ids move; map-side combining
  makes a digest with a third of all rows as cheap as any other.  One table is one batch, whose runs
  are merged at once, as one merge of any number of runs moves each entry once.
* **Levels.**  ``MergeIndex`` takes further batches: each adds a table to level 0, and ``FAN_IN`` tables
  of a level are merged into one of the next, so an entry is moved once for each level.  A batch is
  first held against the filters of all tables; only what they let through is joined with entries.
* **Byte verification.**  Texts of digests with several entries (found through a filter of bounded
  size, so other texts stay where they are) are compared byte for byte: a class is sound exactly if
  its smallest and its largest text are equal, which also combines map-side.  Digests that fail are
  regrouped by the text itself.

Defined results: a null text counts as empty; empty texts are equal to one another; very long texts count
whole; ties are of one id; rows that repeat both id and text count in ``group_size`` and share one verdict; a null id never stays if its class has
another id; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import KeyFilter, drop_stored, store, table

#: Tables of a level that are merged into one of the next.
FAN_IN = 4
FILTERED_RUN = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"}


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Level 0: one sorted run per input task, ``(digest, sha, doc_id)``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    entries = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), sha256_digest(text).alias("sha"))
    return store(entries.sortWithinPartitions("digest", "doc_id"), "runs", FILTERED_RUN)


def compact(runs: list[DataFrame], keep: str = "max") -> DataFrame:
    """The next level: runs merged by digest, ``(digest, keep_id, group_size)``."""
    pick = {"max": F.max, "min": F.min}[keep]
    merged = runs[0].select("digest", F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("n")) if "doc_id" in runs[0].columns else runs[0].select("digest", F.col("keep_id").alias("id"), F.col("group_size").alias("n"))
    for run in runs[1:]:
        part = run.select("digest", F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("n")) if "doc_id" in run.columns else run.select("digest", F.col("keep_id").alias("id"), F.col("group_size").alias("n"))
        merged = merged.unionByName(part)
    level = merged.groupBy("digest").agg(pick("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return store(level.sortWithinPartitions("digest"), "level", FILTERED_RUN)


def unsound(docs: DataFrame, level: DataFrame, digest: Callable[[Column], Column] = sha256_digest, text_col: str = "text") -> DataFrame:
    """Digests shared by texts that differ in some byte."""
    hits = level.where("group_size > 1").select("digest")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("body")).withColumn("digest", digest(F.col("body")))
    suspects = KeyFilter(hits, "digest").keep(rows, F.col("digest"))
    return suspects.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("digest")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row."""
    pick = {"max": F.max, "min": F.min}[keep]
    runs = flush(docs, digest, id_col, text_col)
    level = compact([runs], keep)
    bad = store(unsound(docs, level, digest, text_col), "unsound")
    entries = runs.select("doc_id", "digest", "sha")
    if not bad.isEmpty():  # different texts under one digest: their classes are those of the whole text
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("body")).withColumn("digest", digest(F.col("body")))
        rows = KeyFilter(bad, "digest").keep(rows, F.col("digest")).join(bad, "digest", "left_semi")
        rows = store(rows.select("doc_id", "body", F.concat(F.col("digest"), sha256_digest(F.col("body"))).alias("digest"), sha256_digest(F.col("body")).alias("sha")), "regrouped")
        fixed = rows.groupBy("digest", "body").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("digest", "keep_id", "group_size")
        level = store(level.join(bad, "digest", "left_anti").unionByName(fixed), "level")
        entries = entries.join(bad, "digest", "left_anti").unionByName(rows.select("doc_id", "digest", "sha"))
    out = entries.join(level.hint("merge"), "digest")
    return out.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


class MergeIndex:
    """An index that grows by batches: ``levels[n]`` holds tables ``(digest, keep_id, group_size)`` with their filters."""

    def __init__(self, digest: Callable[[Column], Column] = sha256_digest, keep: str = "min", fan_in: int = FAN_IN):
        self.digest, self.keep, self.fan_in = digest, keep, fan_in
        self.levels: list[list[tuple[DataFrame, KeyFilter]]] = []

    def tables(self) -> list[tuple[DataFrame, KeyFilter]]:
        return [table for level in self.levels for table in level]

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Flush a batch and merge the levels that are full."""
        runs = flush(docs, self.digest, id_col, text_col)
        self._put(0, compact([runs], self.keep))
        drop_stored(runs)

    def _put(self, n: int, table: DataFrame) -> None:
        while len(self.levels) <= n:
            self.levels.append([])
        self.levels[n].append((table, KeyFilter(table, "digest")))
        if len(self.levels[n]) >= self.fan_in:
            full = [t for t, _ in self.levels[n]]
            self.levels[n] = []
            self._put(n + 1, compact(full, self.keep))
            for t in full:
                drop_stored(t)

    def suspects(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``(id, body, digest)`` of rows that some table's filter lets through; no table is read for the others."""
        body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = docs.select(F.struct(*docs.columns).alias("row"), body.alias("body"), self.digest(body).alias("digest"))
        parts, rest = [], rows
        for _, filter_ in self.tables():
            parts.append(filter_.keep(rest, F.col("digest")))
            rest = filter_.drop(rest, F.col("digest"))
        return reduce(DataFrame.unionByName, parts) if parts else rows.limit(0)

    def lookup(self, docs: DataFrame, earlier: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, keep_id)`` of rows whose text the index holds, after byte verification against ``earlier``, the indexed documents."""
        held = reduce(DataFrame.unionByName, [t.select("digest", "keep_id") for t, _ in self.tables()]) if self.levels else None
        if held is None:
            return docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).alias("keep_id")).limit(0)
        pick = {"max": F.max, "min": F.min}[self.keep]
        hits = store(self.suspects(docs, text_col).select(F.col("row")[id_col].alias("doc_id"), "body", "digest"), "hits")
        mine = KeyFilter(hits, "digest").keep(held, F.col("digest")).groupBy("digest").agg(pick("keep_id").alias("keep_id"))
        found = hits.join(mine, "digest")
        own = earlier.select(F.col(id_col).alias("keep_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("own"))
        own = KeyFilter(found.select("keep_id"), "keep_id").keep(own, F.col("keep_id")).distinct()
        same = F.col("found.body") == F.col("own.own")
        return found.alias("found").join(own.alias("own"), F.col("found.keep_id").eqNullSafe(F.col("own.keep_id")) & same).select(F.col("found.doc_id").alias("doc_id"), F.col("found.keep_id").alias("keep_id"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
with d as (select doc_id, coalesce(text, '') as body from documents),
g as (select body, max(doc_id) as keep_id, count(*) as group_size from d group by body)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.body) as text_sha256
from d join g on d.body = g.body
"""

__all__ = ["MergeIndex", "compact", "exact_dedup", "flush", "op6_exact_dedup", "unsound"]
