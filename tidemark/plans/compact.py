"""Compaction: folds the oldest commits into new tables, which no reader of an older version touches.

Most compactions of a large index write a layer: the rows that the commits changed, placed at the centroids
of the snapshot, and what they hide in older layers.  A layer takes in the layers before it that are not much
larger than itself, so their sizes grow geometrically and a row is written again a number of times that grows
with the logarithm of the index.  When the layers would come to a share of the index, it is written anew: postings
are split, rows move between them and fan-outs are measured then, and not before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace as with_values

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ann, inverted, merge
from tidemark.operators.replay import MAX_FOLDED, replay
from tidemark.plans.query import EXACT_ROWS, ROW, Snapshot, empty, hidden, layered, read_snapshot
from tidemark.sources import log
from tidemark.sources.files import HadoopFiles, LocalFiles
from tidemark.sources.manifest import Layer, Manifest, Manifests, WalFile

#: Numbers of rows asked for whose fan-outs are measured; queries for more are exact.
MEASURED_K = (10, 100)
#: Rows that are asked for as queries to choose a fan-out: every 50th by hash, as ids need not be numbers, and no more than this.
MEASURED_QUERIES = 1000
#: A layer takes in an older one of at most this many times its size.
TIER = 2
#: Postings named in the condition of a scan; rows of more are found by a join alone.
NAMED_POSTINGS = 1000


def compact(spark: SparkSession, files: LocalFiles | HadoopFiles, manifests: Manifests, config: ann.AnnConfig = ann.AnnConfig(), force: bool = False) -> Manifest | None:
    """One cycle, or None if there is nothing to do (or one commit only, unless forced)."""
    manifest = manifests.latest()
    taken = log.batch(manifest, force)
    if not taken or (not force and len(manifest.wal) <= 1):
        return None
    snapshot = read_snapshot(spark, files, manifest)
    run = f"{manifests.namespace}/snapshots/{manifest.version:012d}-{uuid.uuid4().hex[:8]}"
    at, rounds = files.path(run), iter(range(1 << 30))

    def settle(df: DataFrame) -> DataFrame:
        path = f"{at}/work/{next(rounds)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    records = sum(w.records for w in taken)
    state = settle(replay(log.scan(spark, files, taken), max_folded=MAX_FOLDED if records > MAX_FOLDED else None))
    touched = merge.bounded(state.select("id"), records)
    older, newer, size = _tiers(manifest, records, config)
    old = settle(_rows_of(snapshot.postings, touched, records)) if snapshot else None
    # the same rules as a query's: the newest wins, a tombstone or patch may not reach a newer row
    changed = settle(merge.merge(old.drop("posting_id") if snapshot else empty(spark, ROW), state))
    if older is not None:
        _write_layer(spark, files, at, snapshot, newer, old, touched, changed, manifest)
        rows = manifest.indexed_rows - old.count() + changed.count()
        values = {"layers": (*older, Layer(run, size)), "indexed_rows": rows}
        replaced = [x.key for x in newer]
        return _swap(files, manifests, manifest, run, taken, values, replaced)
    if snapshot is None or manifest.indexed_rows == 0:
        postings, centroids = ann.build(changed, config, manifest.metric, settle=settle)
        index = inverted.build(changed, manifest.index_attributes)
    else:
        postings, centroids = ann.update(snapshot.postings, snapshot.centroids, touched, changed, config, manifest.metric, settle)
        index = inverted.maintain(snapshot.inverted, touched, changed, manifest.index_attributes)
    _write(postings, ["posting_id"], f"{at}/postings")
    centroids.write.parquet(f"{at}/centroids")
    _write_entries(index, f"{at}/inverted")
    rows = spark.read.parquet(f"{at}/postings").agg(F.count(F.lit(1))).first()[0]
    fanouts = measured_fanouts(spark.read.schema(postings.schema).parquet(f"{at}/postings"), spark.read.schema(centroids.schema).parquet(f"{at}/centroids"), rows, manifest.metric, settle) if rows > EXACT_ROWS else ()
    values = {"snapshot": run, "layers": (), "indexed_rows": rows, "fanouts": fanouts}
    return _swap(files, manifests, manifest, run, taken, values, [*([manifest.snapshot] if manifest.snapshot else []), *(x.key for x in manifest.layers)])


def _swap(files: LocalFiles | HadoopFiles, manifests: Manifests, base: Manifest, run: str, taken: tuple[WalFile, ...], values: dict[str, object], replaced: list[str]) -> Manifest:
    """Commits the tables of ``run`` in place of the commits taken and of the folders replaced."""
    files.delete(f"{run}/work")
    gone = {w.key for w in taken}

    def swap(now: Manifest) -> Manifest:
        if (now.snapshot, now.layers) != (base.snapshot, base.layers) or not gone <= {w.key for w in now.wal}:
            files.delete(run)
            raise RuntimeError("another compaction was faster")
        return with_values(now, **values, wal=tuple(w for w in now.wal if w.key not in gone), retired=(*now.retired, *sorted(gone), *replaced))

    return manifests.commit(swap)


def _tiers(manifest: Manifest, records: int, config: ann.AnnConfig) -> tuple[tuple[Layer, ...] | None, tuple[Layer, ...], int]:
    """``(layers that stay, layers to be merged, size of the new one)``; None stay if the index is to be written anew."""
    stay, size = len(manifest.layers), records
    while stay and manifest.layers[stay - 1].size <= TIER * size:
        stay -= 1
        size += manifest.layers[stay].size
    whole = manifest.snapshot is None or manifest.indexed_rows <= max(config.layer_rows, config.layer_share * size)
    return None if whole else manifest.layers[:stay], manifest.layers[stay:], size


def _rows_of(postings: DataFrame, touched: DataFrame, records: int) -> DataFrame:
    """The rows of the touched ids.  Their postings are found from ids alone; if they are few, only those are read whole."""
    if records <= merge.BROADCAST_RECORDS:
        own = [r[0] for r in postings.select("id", "posting_id").join(touched, "id", "left_semi").select("posting_id").distinct().limit(NAMED_POSTINGS + 1).collect()]
        if len(own) <= NAMED_POSTINGS:
            postings = postings.where(F.col("posting_id").isin(own))
    return postings.join(touched, "id", "left_semi").select(*postings.columns)


def _write_layer(spark: SparkSession, files: LocalFiles | HadoopFiles, at: str, snapshot: Snapshot, merged: tuple[Layer, ...], old: DataFrame, touched: DataFrame, changed: DataFrame, manifest: Manifest) -> None:
    """The changed rows and those of the ``merged`` layers that stay, and what they hide: the ``old`` rows of touched ids."""
    postings = ann.assign(changed, snapshot.centroids, manifest.metric).drop("posting_dist")
    entries = inverted.build(changed, manifest.index_attributes)
    mask, gone = old.select("id", "posting_id"), inverted.build(old)  # all attributes, whichever were indexed
    if merged:
        held = layered(spark, files, merged, "postings")
        postings = held.join(touched, "id", "left_anti").select(*held.columns).unionByName(postings)
        entries = inverted.maintain(layered(spark, files, merged, "inverted"), touched, changed, manifest.index_attributes)
        mask = hidden(spark, files, merged, "postings").unionByName(mask).distinct()
        gone = hidden(spark, files, merged, "inverted").unionByName(gone).distinct()
    _write(postings, ["posting_id"], f"{at}/postings")
    _write(mask, ["posting_id"], f"{at}/mask")
    _write_entries(entries, f"{at}/inverted")
    _write_entries(gone, f"{at}/gone")


def measured_fanouts(postings: DataFrame, centroids: DataFrame, n_rows: int, metric: str, settle: Callable[[DataFrame], DataFrame]) -> tuple[tuple[int, int], ...]:
    """``(k, fan-out)``: the postings to probe so that recall at ``k``, measured against brute force, reaches the target."""
    keyed = postings.select(F.concat_ws(":", F.hex("id.bytes"), F.col("id.id_type").cast("string")).alias("id"), "vector", "posting_id")
    share = max(50, -(-n_rows // MEASURED_QUERIES))
    queries = settle(keyed.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")))
    places = settle(ann.neighbour_places(keyed, centroids, queries, MEASURED_K[-1], metric))
    chosen = [(k, ann.least_fanout(ann.recall_by_fanout(places, k))) for k in MEASURED_K]
    return tuple((k, fanout) for k, fanout in chosen if fanout is not None)


def _write(df: DataFrame, by: list[str], path: str) -> None:
    """Sorted files, so that row group statistics prune postings and fields."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)


def _write_entries(index: DataFrame, path: str) -> None:
    """The id is part of the range, so a value that very many rows have is spread over files."""
    _write(index.select("key", "id", "field"), ["field", "key", "id"], path)


def sweep(files: LocalFiles | HadoopFiles, manifests: Manifests, keep_versions: int = 20) -> int:
    """Deletes what earlier compactions retired; run it later than queries of those versions end."""
    retired = manifests.latest().retired
    for key in retired:
        files.delete(key)
    if retired:
        manifests.commit(lambda now: with_values(now, retired=tuple(k for k in now.retired if k not in retired)))
    manifests.forget(keep_versions)
    return len(retired)
