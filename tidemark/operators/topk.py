"""Nearest neighbours: exact top-k for one query vector and for a table of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import COSINE, EUCLIDEAN, distance, literal

#: Query vectors shipped to the workers at a time: at 1,000 dimensions 32 MB.
QUERY_BLOCK = 4096


def topk(rows: DataFrame, query: Sequence[float], k: int, metric: str = COSINE, id_col: str = "id", vector_col: str = "vector", dist_col: str = "dist", ties: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows, ties by id, or by ``ties``.  Each task keeps k rows; only those are merged."""
    return rows.withColumn(dist_col, distance(metric, F.col(vector_col), literal(query))).orderBy(dist_col, id_col if ties is None else ties).limit(k)


def ranked(distances: DataFrame, k: int, by: str = "query_id", id_col: str = "id") -> DataFrame:
    """The ``k`` nearest of each query, with their rank."""
    w = Window.partitionBy(by).orderBy("dist", id_col)
    return distances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def batch_topk(rows: DataFrame, queries: DataFrame, k: int, metric: str = COSINE, id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """``(query_id, id, dist, rank)``: the ``k`` nearest rows of each query, ties by id.

    The stated queries are shipped in blocks of bounded size; each task keeps the best ``k`` of every query
    of a block, so only ``k`` rows per task and query are shuffled.  Distances add up dimension by dimension
    in 64 bits, as the column expressions do.
    """
    id_type = rows.schema[id_col].dataType
    fields = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("id", id_type), T.StructField("dist", T.DoubleType())])
    n = queries.count()
    out: DataFrame | None = None
    numbered = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("query_vector"))
    blocks = max(1, -(-n // QUERY_BLOCK))
    for block in range(blocks):
        held = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        some = held.orderBy("query_id").collect()  # one block
        if not some:
            continue
        ids, vectors = [r["query_id"] for r in some], np.array([r["query_vector"] for r in some], np.float64)
        part = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null").mapInArrow(_nearest(ids, vectors, k, metric, fields), fields)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], fields)
    return ranked(out, k)


def _nearest(ids: list, vectors: np.ndarray, k: int, metric: str, fields: T.StructType):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, object]]] = [[] for _ in ids]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                x = np.array(some["vector"].flatten().to_numpy(zero_copy_only=False)).reshape(some.num_rows, -1)
                total = np.zeros((len(vectors), len(x)))
                for d in range(x.shape[1]):  # in order, so that sums do not depend on the batch
                    total += vectors[:, d, None] * x[None, :, d] if metric != EUCLIDEAN else (x[None, :, d] - vectors[:, d, None]) ** 2
                dist = total if metric == EUCLIDEAN else 1.0 - total
                row_ids = some["id"].to_pylist()
                for q in range(len(vectors)):
                    near = np.argpartition(dist[q], k - 1)[:k] if len(x) > k else np.arange(len(x))
                    edge = dist[q][near].max()
                    near = np.flatnonzero(dist[q] <= edge) if len(x) > k else near  # ties stay for the order by id
                    best[q] = sorted(best[q] + [(float(dist[q, i]), row_ids[i]) for i in near])[:k]
        if id_type is not None:
            flat = [(q, i, d) for q, held in zip(ids, best, strict=True) for d, i in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat]), pa.array([r[1] for r in flat], id_type), pa.array([r[2] for r in flat], pa.float64())], names=["query_id", "id", "dist"])

    return nearest


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``(recall double)``: the share of true neighbours found, over ``(query_id, id)`` tables."""
    hits = truth.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
