"""Small reports: latency percentiles, throughput, and the choice of files for a compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, column: str, *by: str) -> DataFrame:
    """p50, p95 and p99 with linear interpolation, mean and maximum."""
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = df.groupBy(*by).agg(p.alias("p"), F.avg(column).alias("mean"), F.max(column).alias("max"))
    return out.select(*by, *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "mean", "max")


def throughput(df: DataFrame, items: str, seconds: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(items) / F.sum(seconds)).alias("per_second"))


def batch_pick(files: DataFrame, order: str, size: str, most_files: int, most_bytes: int, by: str | None = None) -> DataFrame:
    """The files that one compaction takes: the first ``most_files``, up to ``most_bytes``, but always one."""
    w = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy(order)
    numbered = files.withColumns({"pick": F.row_number().over(w), "running": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return numbered.where((F.col("pick") <= most_files) & ((F.col("running") <= most_bytes) | (F.col("pick") == 1)))


def latest(df: DataFrame, key: str, *order: object) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")
