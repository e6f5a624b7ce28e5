"""Shared pieces: reading tables, scratch tables, a bounded key filter, component labelling.

Scratch tables live under ``spark.checkpoint.dir``, which executors and the driver share, so a lost
executor costs a re-run task and never a lost intermediate result.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship_package

#: A key filter never has more than 2**MAX_FILTER_BITS bits: 16 MiB, whatever the input.
MAX_FILTER_BITS = 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder, or one of our own in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-scratch-')}"
    else:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path, removed when the application ends."""
    path = f"{scratch_root(spark)}/tidemark-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def store(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to scratch and read it back: cuts the lineage and keeps partial work once."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark-" in path:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan refers to any more, instead of waiting for the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(taken: list[str], name: str) -> str:
    """``name``, or a longer one that no column in ``taken`` has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def whole_rows(df: DataFrame, text_col: str) -> DataFrame:
    """``(row, body)``: the text, and all other columns as one struct, so that no name in it meets a name of ours."""
    ship_package(df.sparkSession)
    others = [c for c in df.columns if c != text_col or df.schema[c].dataType != T.StringType()]
    return df.select(F.struct(*others or [F.lit(0).alias("nothing")]).alias("row"), F.col(text_col).cast("string").alias("body"))


def columns_of(df: DataFrame, text_col: str, but: tuple[str, ...] = (), text: str = "body") -> list[Column]:
    """The columns of ``df`` from a table that kept its ``row``; the text from the column ``text``."""
    return [(F.col(text) if c == text_col and (text != "body" or df.schema[c].dataType == T.StringType()) else F.col("row")[c]).alias(c) for c in df.columns if c not in but]


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(bits)), F.lit(1 << bits))


class Bits:
    """A fixed-size bit set over longs for Python workers."""

    def __init__(self, bits: int, pages: dict[int, bytes]):
        self.mask, self.pages = (1 << bits) - 1, pages

    def holds(self, key: int) -> bool:
        slot = key & self.mask
        page = self.pages.get(slot >> 15)
        return page is not None and bool(page[(slot & 32767) >> 3] >> (slot & 7) & 1)


def bits_of(keys: DataFrame, column: str, n_keys: int | None = None) -> Bits:
    """The low bits of evenly spread long keys as a bit set of at most 16 MiB, whatever the input."""
    n = keys.count() if n_keys is None else n_keys
    bits = min(MAX_FILTER_BITS, max(16, (16 * max(n, 1)).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    # slots count from 1 so that Spark's pages and positions are those of slot // 32768 and slot % 32768
    pages = keys.select((slot + 1).alias("slot")).groupBy((F.expr("bitmap_bucket_number(slot)") - 1).alias("f_page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("f_bits"))
    return Bits(bits, {r["f_page"]: bytes(r["f_bits"]) for r in pages.collect()})


class KeyFilter:
    """A one-hash Bloom filter of a key column, built by aggregation, never larger than 16 MiB.

    ``keep`` drops rows whose key is surely absent without moving them; false positives stay.  The
    filter is a table of at most 4,096 rows of 4 KiB, so broadcasting it has a proven bound.
    """

    def __init__(self, keys: DataFrame, column: str, n_keys: int | None = None):
        n = keys.count() if n_keys is None else n_keys
        self.bits = min(MAX_FILTER_BITS, max(16, (16 * max(n, 1)).bit_length()))
        slot = _slot(F.col(column), self.bits)
        self.pages = (
            keys.select(slot.alias("slot"))
            .groupBy(F.expr("bitmap_bucket_number(slot)").alias("f_page"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("f_bits"))
        )

    def keep(self, df: DataFrame, key: Column) -> DataFrame:
        """Rows whose key may be in the filter."""
        return self._join(df, key, "left_semi")

    def drop(self, df: DataFrame, key: Column) -> DataFrame:
        """The other rows: their key is surely not among the filter's."""
        return self._join(df, key, "left_anti")

    def _join(self, df: DataFrame, key: Column, how: str) -> DataFrame:
        slot, page, bits = (fresh(df.columns, c) for c in ("f_slot", "f_page", "f_bits"))
        rows = df.withColumn(slot, _slot(key, self.bits))
        pages = self.pages.select(F.col("f_page").alias(page), F.col("f_bits").alias(bits))
        byte = f"cast(conv(hex(substring({bits}, cast(bitmap_bit_position({slot}) / 8 as int) + 1, 1)), 16, 10) as int)"
        is_set = F.expr(f"({byte} & shiftleft(1, cast(bitmap_bit_position({slot}) % 8 as int))) <> 0")
        on = (F.expr(f"bitmap_bucket_number({slot})") == F.col(page)) & is_set
        return rows.join(F.broadcast(pages), on, how).drop(slot)
