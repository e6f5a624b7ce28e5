"""Clustered approximate nearest neighbours, as whole-set operations on immutable tables.

``postings`` holds rows with the id of their cluster, ``centroids (posting_id, centroid, n)`` the means.
A build seeds centroids, assigns every row to its nearest and takes means, a few times; postings above the
limit are split in two, and rows near a split move to a better neighbour under a guard.  Row counts are
always exact, and every row is in one posting.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import COSINE, EUCLIDEAN, wide
from tidemark.operators.topk import batch_topk, topk

#: Centroids that are shipped to every task; above this a two-level build is needed: 100,000 x 128 dimensions is 100 MB.
MAX_CENTROIDS = 100_000
#: Share of the true neighbours that a search has to find.
RECALL = 0.9


@dataclass(frozen=True)
class AnnConfig:
    max_posting_size: int = 1000
    min_posting_size: int = 100
    neighbor_fanout: int = 32
    search_fanout: int = 4
    rounds: int = 4
    seed: int = 42
    gain: float = 0.1  #: the least relative improvement for which a row moves
    layer_rows: int = 10_000  #: an index of no more rows is written anew by each compaction
    layer_share: int = 4  #: and one that has at most this many times the rows of its newest layer


def means(rows: DataFrame, by: str = "posting_id", vector_col: str = "vector") -> DataFrame:
    """``(posting_id, centroid, n)``: component means.  Dimensions are summed apart, with map-side combining."""
    parts = rows.select(by, F.posexplode(wide(F.col(vector_col))).alias("dim", "x"))
    sums = parts.groupBy(by, "dim").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    listed = sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("m"), F.max("n").alias("n"))
    return listed.select(by, F.transform("m", lambda s: s["mean"]).alias("centroid"), "n")


def _matrix(centroids: DataFrame) -> tuple[list[int], np.ndarray]:
    held = centroids.select("posting_id", "centroid").orderBy("posting_id").limit(MAX_CENTROIDS + 1).collect()
    if len(held) > MAX_CENTROIDS:
        raise ValueError("too many centroids for one level")
    return [r["posting_id"] for r in held], np.array([r["centroid"] for r in held], np.float64)


def _distances(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    total = np.zeros((len(x), len(centroids)))
    for d in range(centroids.shape[1]):
        total += (x[:, d, None] - centroids[None, :, d]) ** 2 if metric == EUCLIDEAN else x[:, d, None] * centroids[None, :, d]
    return total if metric == EUCLIDEAN else 1.0 - total


def assign(rows: DataFrame, centroids: DataFrame, metric: str = COSINE, vector_col: str = "vector") -> DataFrame:
    """``rows`` with ``posting_id`` of the nearest centroid (ties: the smallest) and ``posting_dist``."""
    ids, matrix = _matrix(centroids)
    names = [c for c in rows.columns if c not in ("posting_id", "posting_dist")]
    fields = T.StructType([*(rows.schema[c] for c in names), T.StructField("posting_id", T.IntegerType()), T.StructField("posting_dist", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                x = some[vector_col].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                dist = _distances(x, matrix, metric)
                at = dist.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.array(ids, np.int32)[at]), pa.array(dist[np.arange(len(x)), at])], names=[*names, "posting_id", "posting_dist"])

    return rows.select(*names).mapInArrow(nearest, fields)


def posting_sizes(postings: DataFrame) -> DataFrame:
    return postings.groupBy("posting_id").agg(F.count(F.lit(1)).alias("n"))


def two_means(vectors: np.ndarray, seed: int = 42, iterations: int = 10, seeds: tuple[int, int] | None = None) -> np.ndarray:
    """Which half each vector joins; ties go to the first, and neither half is empty."""
    x = np.asarray(vectors, np.float64)
    n = len(x)
    if n < 2:
        return np.zeros(n, np.int8)
    a, b = seeds or np.random.default_rng(seed).choice(n, 2, replace=False)
    centers = x[[a, b]].copy()
    half = np.zeros(n, np.int8)
    for step in range(iterations + 1):
        gaps = _distances(x, centers, EUCLIDEAN)
        half = (gaps[:, 1] < gaps[:, 0]).astype(np.int8)
        if half.all() or not half.any():
            half[:] = 0
            half[int(gaps[:, 0].argmax())] = 1
        if step < iterations:
            centers = np.stack([x[half == h].mean(axis=0) for h in (0, 1)])
    return half


def split_oversize(postings: DataFrame, config: AnnConfig, first_new_id: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Postings above the limit in two; the first half keeps its id.  Returns ``(postings, [(old, new)])``.

    A posting to be split holds at most the rows that a build or a batch put there, which the limit bounds.
    """
    large = [r["posting_id"] for r in posting_sizes(postings).where(F.col("n") > config.max_posting_size).orderBy("posting_id").collect()]
    if not large:
        return postings, []
    pairs = [(old, first_new_id + k) for k, old in enumerate(large)]
    names, new_of, seed = postings.columns, dict(pairs), config.seed

    def split(group: pa.Table) -> pa.Table:
        old = group["posting_id"][0].as_py()
        order = pc.sort_indices(pa.table({"i": pc.struct_field(group["id"], "bytes") if pa.types.is_struct(group.schema.field("id").type) else group["id"]}), [("i", "ascending")])
        group = group.take(order)  # the same split whatever the order of arrival
        x = np.array([v for v in group["vector"].to_pylist()], np.float64)
        ids = pa.array(np.where(two_means(x, seed) == 1, new_of[old], old).astype(np.int32))
        return group.set_column(group.schema.get_field_index("posting_id"), "posting_id", ids)

    changed = postings.where(F.col("posting_id").isin(large)).groupBy("posting_id").applyInArrow(split, postings.schema)
    return postings.where(~F.col("posting_id").isin(large)).unionByName(changed.select(*names)), pairs


def lire_moves(postings: DataFrame, centroids: DataFrame, splits: Sequence[Sequence[int]], config: AnnConfig, metric: str = COSINE) -> DataFrame:
    """Rows of the neighbours of split postings that another of them suits better: ``(id, posting_id, target, cur, tgt)``.

    Each split, the postings that came of one, has its own nearest neighbours.  A row moves if its distance
    falls by at least the gain, the target has room (80 % of the limit) and its own posting stays above the
    minimum by more than one row.
    """
    held, matrix = _matrix(centroids)
    sizes = {r["posting_id"]: r["n"] for r in centroids.select("posting_id", "n").collect()}  # MAX_CENTROIDS at most
    at = {p: k for k, p in enumerate(held)}
    split = [p for group in splits for p in group if p in at]
    fields = T.StructType([postings.schema["id"], postings.schema["posting_id"], T.StructField("target", T.IntegerType()), T.StructField("cur", T.DoubleType()), T.StructField("tgt", T.DoubleType())])
    others = [p for p in held if p not in set(split)]
    neighbours: set[int] = set()
    for group in splits:
        own = [at[p] for p in group if p in at]
        if own and others:
            gap = _distances(matrix[own], matrix[[at[p] for p in others]], metric).min(axis=0)
            neighbours.update(others[k] for k in np.lexsort((others, gap))[: config.neighbor_fanout].tolist())
    options = sorted({*split, *neighbours})
    rows = postings.where(F.col("posting_id").isin(sorted(neighbours))) if split and neighbours else postings.limit(0)
    choices = matrix[[at[p] for p in options]] if options else np.zeros((0, 0))
    step = max(1, (1 << 21) // max(1, len(options)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(options)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                x = some["vector"].flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                dist = _distances(x, choices, metric)
                first, line = dist.argmin(axis=1), np.arange(some.num_rows)  # of equal ones the smallest id
                own = np.searchsorted(names, some["posting_id"].to_numpy())
                columns = [some["id"], some["posting_id"], pa.array(names[first].astype(np.int32)), pa.array(dist[line, own]), pa.array(dist[line, first])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "posting_id", "target", "cur", "tgt"])

    wide_rows = rows.select("id", "posting_id", F.col("vector").cast("array<double>").alias("vector"))
    scored = wide_rows.mapInArrow(best, fields)
    if not options:
        return scored
    size = F.create_map(*[F.lit(x) for p in options for x in (p, sizes[p])])
    ok = move_guard(F.col("cur"), F.col("tgt"), F.element_at(size, F.col("target")), F.element_at(size, F.col("posting_id")), config)
    return scored.where((F.col("target") != F.col("posting_id")) & ok)


def move_guard(cur: Column, tgt: Column, target_n: Column, own_n: Column, config: AnnConfig) -> Column:
    gain = F.when(cur != 0, (cur - tgt) / cur).otherwise(F.lit(0.0))
    return (gain >= config.gain) & (target_n < 0.8 * config.max_posting_size) & (own_n > config.min_posting_size + 1)


def build(rows: DataFrame, config: AnnConfig = AnnConfig(), metric: str = COSINE, n_rows: int | None = None, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """``(postings, centroids)`` from rows ``(id, vector, ...)``.  ``settle`` cuts lineage between rounds, for instance by writing a table."""
    n = rows.count() if n_rows is None else n_rows
    k = min(MAX_CENTROIDS, max(1, math.ceil(n / (0.5 * config.max_posting_size))))
    seeds = rows.orderBy(F.xxhash64(F.to_json(F.struct("id")), F.lit(config.seed))).limit(k).select("vector").collect()
    centroids = rows.sparkSession.createDataFrame([(i, [float(x) for x in r["vector"]], 0) for i, r in enumerate(seeds)], "posting_id int, centroid array<double>, n long")
    for _ in range(config.rounds):
        centroids = settle(means(assign(rows, centroids, metric)))
    postings = settle(assign(rows, centroids, metric).drop("posting_dist"))
    return settle_sizes(postings, config, metric, settle)


def settle_sizes(postings: DataFrame, config: AnnConfig, metric: str, settle: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Splits until no posting is above the limit, moving neighbours after each pass."""
    while True:
        top = postings.agg(F.max("posting_id")).first()[0]
        postings, pairs = split_oversize(postings, config, (top if top is not None else -1) + 1)
        if not pairs:
            return postings, settle(means(postings))
        postings = settle(postings)
        centroids = means(postings)
        moves = lire_moves(postings, centroids, pairs, config, metric).select("id", "target")
        postings = settle(postings.join(moves, "id", "left").withColumn("posting_id", F.coalesce("target", "posting_id")).select(*postings.columns))


def update(postings: DataFrame, centroids: DataFrame, removed: DataFrame, added: DataFrame, config: AnnConfig = AnnConfig(), metric: str = COSINE, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Postings without the removed ids and with the added rows, each in its nearest posting."""
    kept = postings.join(removed.select("id"), "id", "left_anti").select(*postings.columns)
    if centroids.isEmpty():
        return build(added.select(*[c for c in postings.columns if c != "posting_id"]), config, metric, settle=settle)
    placed = assign(added, centroids, metric).drop("posting_dist")
    return settle_sizes(settle(kept.unionByName(placed.select(*kept.columns))), config, metric, settle)


def contains(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted (id)`` with ``held boolean``: whether the index has the id."""
    return wanted.select("id").distinct().join(postings.select("id", F.lit(True).alias("held")), "id", "left").select("id", F.coalesce("held", F.lit(False)).alias("held"))


def count(centroids: DataFrame) -> int:
    """Rows of the index, from the counts that its centroids carry."""
    return centroids.agg(F.sum("n")).first()[0] or 0


def probe_ids(centroids: DataFrame, query: Sequence[float], fanout: int, metric: str = COSINE) -> list[int]:
    """Ids of the nearest postings."""
    return [r["posting_id"] for r in topk(centroids, query, fanout, metric, "posting_id", "centroid").collect()]


def probe_order(centroids: DataFrame, query: Sequence[float], metric: str = COSINE) -> list[tuple[int, int]]:
    """``(posting id, rows)`` of all postings, nearest first."""
    return [(r["posting_id"], r["n"]) for r in topk(centroids, query, MAX_CENTROIDS, metric, "posting_id", "centroid").collect()]


def neighbour_places(postings: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, metric: str = COSINE) -> DataFrame:
    """``(query_id, id, rank, place)``: the ``k`` true neighbours of each query other than itself, by brute force.

    ``place`` counts from 1 how near the neighbour's posting is to the query among all postings.  A search
    compares all rows of the postings it probes, so it finds a true neighbour if and only if its place is
    within the fan-out: the places give the recall at every fan-out.
    """
    truth = batch_topk(postings, queries, k + 1, metric).where("query_id <> id")
    truth = truth.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k).drop("dist")
    held, matrix = _matrix(centroids)
    rows = truth.join(postings.select("id", "posting_id"), "id").join(queries.select("query_id", "query_vector"), "query_id")
    rows = rows.select("query_id", "id", "rank", "posting_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    fields = T.StructType([*(rows.schema[c] for c in ("query_id", "id", "rank")), T.StructField("place", T.IntegerType())])
    step = max(1, (1 << 21) // max(1, len(held)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                x = some["query_vector"].flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                dist = _distances(x, matrix, metric)
                at = np.searchsorted(held, some["posting_id"].to_numpy())
                own = dist[np.arange(len(x)), at][:, None]
                before = (dist < own) | ((dist == own) & (np.arange(len(held))[None, :] < at[:, None]))
                yield pa.RecordBatch.from_arrays([some["query_id"], some["id"], some["rank"], pa.array(before.sum(axis=1).astype(np.int32) + 1)], names=["query_id", "id", "rank", "place"])

    return rows.mapInArrow(placed, fields)


def recall_by_fanout(places: DataFrame, k: int) -> list[tuple[int, float, float]]:
    """``(fan-out, recall, its standard error)`` for the fan-outs at which recall at ``k`` changes.

    The error is of the mean over queries, bounded by that of independent queries of one variance.
    """
    near = places.where(F.col("rank") <= k)
    total = near.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("queries")).first()
    out, found = [], 0
    for r in near.groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect():  # at most a row for each centroid
        found += r["n"]
        recall = found / total["n"]
        out.append((r["place"], recall, math.sqrt(recall * (1 - recall) / total["queries"])))
    return out


def least_fanout(curve: Sequence[tuple[int, float, float]], target: float = RECALL) -> int | None:
    """The least fan-out whose recall reaches the target by one standard error; None without a measurement."""
    return next((fanout for fanout, recall, error in curve if recall - error >= target), None)


def search(postings: DataFrame, centroids: DataFrame, query: Sequence[float], k: int, config: AnnConfig = AnnConfig(), metric: str = COSINE) -> DataFrame:
    """The nearest rows of the probed postings; literal ids prune the files that are read."""
    return topk(postings.where(F.col("posting_id").isin(probe_ids(centroids, query, config.search_fanout, metric))), query, k, metric)
