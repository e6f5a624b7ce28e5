"""Query plans: what to scan is chosen from the manifest, the rest is one DataFrame plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import IndexNotBuilt
from tidemark.functions.attrs import ATTRS_TYPE
from tidemark.functions.ids import ID_TYPE, value_order
from tidemark.operators import ann, inverted, merge, topk
from tidemark.operators.replay import MAX_FOLDED, replay
from tidemark.sources import log
from tidemark.sources.files import HadoopFiles, LocalFiles
from tidemark.sources.manifest import Layer, Manifest

ROW = f"id {ID_TYPE}, vector array<float>, attributes {ATTRS_TYPE}, timestamp long"
POSTING = f"{ROW}, posting_id int"
CENTROID = "posting_id int, centroid array<double>, n long"
INVERTED = f"key string, id {ID_TYPE}, field string"
MASK = f"id {ID_TYPE}, posting_id int"
#: Below this many indexed rows an exact scan is as cheap as a probe.
EXACT_ROWS = 10_000
#: A filter that leaves no more than this is answered by an exact scan of its ids.
SELECTIVE_IDS = 100_000


@dataclass(frozen=True)
class Snapshot:
    postings: DataFrame
    centroids: DataFrame
    inverted: DataFrame


def read_snapshot(spark: SparkSession, files: LocalFiles | HadoopFiles, manifest: Manifest) -> Snapshot | None:
    if manifest.snapshot is None:
        return None
    postings, entries = (layered(spark, files, manifest.layers, name, manifest.snapshot) for name in ("postings", "inverted"))
    return Snapshot(postings, _table(spark, files, manifest.snapshot, "centroids"), entries)


TABLES = {"postings": POSTING, "centroids": CENTROID, "inverted": INVERTED, "mask": MASK, "gone": INVERTED}
#: What hides rows of a table in older layers, and by which columns; a probe's or filter's conditions reach both sides.
HIDDEN_BY = {"postings": ("mask", ["id", "posting_id"]), "inverted": ("gone", ["field", "key", "id"])}


def _table(spark: SparkSession, files: LocalFiles | HadoopFiles, key: str, name: str) -> DataFrame:
    return spark.read.schema(log.schema(TABLES[name])).parquet(f"{files.path(key)}/{name}")


def hidden(spark: SparkSession, files: LocalFiles | HadoopFiles, layers: Sequence[Layer], name: str) -> DataFrame:
    """What ``layers`` hide of a table in older ones; bounded by their log records, so that of small ones it is broadcast."""
    rows = reduce(DataFrame.unionByName, [_table(spark, files, x.key, HIDDEN_BY[name][0]) for x in layers])
    return merge.bounded(rows, sum(x.size for x in layers)) if name == "postings" else rows


def layered(spark: SparkSession, files: LocalFiles | HadoopFiles, layers: Sequence[Layer], name: str, base: str | None = None) -> DataFrame:
    """A table of the rows of ``base`` and of ``layers`` (oldest first) that no later layer hides."""
    keys = [*([base] if base else []), *(x.key for x in layers)]
    parts = []
    for n, key in enumerate(keys):
        part = _table(spark, files, key, name)
        if later := layers[n + (0 if base else 1) :]:
            part = part.join(hidden(spark, files, later, name), HIDDEN_BY[name][1], "left_anti").select(*part.columns)
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


class SnapshotCache:
    """Tables of recent snapshots, which never change; those of small indexes are kept in memory once read.

    Bounded by the number of snapshots and by their rows: larger ones are left to the page cache.
    """

    def __init__(self, spark: SparkSession, files: LocalFiles | HadoopFiles, most: int = 10, most_rows: int = 200_000):
        self.spark, self.files, self.most, self.most_rows = spark, files, most, most_rows
        self.held: dict[tuple[str, ...], Snapshot] = {}

    def get(self, manifest: Manifest) -> Snapshot | None:
        if manifest.snapshot is None:
            return None
        key = (manifest.snapshot, *(x.key for x in manifest.layers))
        if key not in self.held:
            snapshot = read_snapshot(self.spark, self.files, manifest)
            if manifest.indexed_rows <= self.most_rows:
                snapshot = Snapshot(snapshot.postings.coalesce(8).persist(), snapshot.centroids, snapshot.inverted.coalesce(8).persist())
            self.held[key] = snapshot
            while len(self.held) > self.most:
                old = self.held.pop(next(iter(self.held)))
                old.postings.unpersist()
                old.inverted.unpersist()
        return self.held[key]


def empty(spark: SparkSession, spec: str) -> DataFrame:
    return spark.createDataFrame([], log.schema(spec))


def tail_state(spark: SparkSession, files: LocalFiles | HadoopFiles, manifest: Manifest) -> DataFrame:
    """The state of the log that no snapshot holds."""
    return replay(log.scan(spark, files, manifest.wal), max_folded=MAX_FOLDED if manifest.pending_records > MAX_FOLDED else None)


def live_rows(spark: SparkSession, files: LocalFiles | HadoopFiles, manifest: Manifest) -> DataFrame:
    """All rows, as a reader of this version sees them."""
    snapshot = read_snapshot(spark, files, manifest)
    base = snapshot.postings.drop("posting_id") if snapshot else empty(spark, ROW)
    return merge.merge_tail(base, tail_state(spark, files, manifest), manifest.pending_records) if manifest.wal else base


def lookup(spark: SparkSession, files: LocalFiles | HadoopFiles, manifest: Manifest, raw: bytes, id_type: int) -> DataFrame:
    """The live row of one id: the id is compared in the scans of the postings and of the log, so nothing else is merged."""
    own = (F.col("id.bytes") == F.lit(raw)) & (F.col("id.id_type") == F.lit(id_type).cast("tinyint"))
    snapshot = read_snapshot(spark, files, manifest)
    base = snapshot.postings.where(own).drop("posting_id") if snapshot else empty(spark, ROW)
    return merge.merge(base, replay(log.scan(spark, files, manifest.wal).where(own))) if manifest.wal else base


def search(spark: SparkSession, files: LocalFiles | HadoopFiles, manifest: Manifest, query: Sequence[float], k: int, filters: Mapping[str, str] | None = None, config: ann.AnnConfig = ann.AnnConfig(), exact: bool = False, cache: SnapshotCache | None = None) -> DataFrame:
    """The nearest live rows ``(id, vector, attributes, timestamp, dist)``.

    Base rows come from the nearest postings, as many as the measured recall of the snapshot asks for, and
    further ones until ``k`` rows are left; all of them are read if the index is small or has no measured
    fan-out for ``k``, the caller asks for it, or a filter leaves few enough ids.  Tombstones, patches and newer rows are applied before the
    limit, so a query returns ``k`` rows if there are as many.  Filters compare with attributes as they
    were indexed, for rows of the log as well.
    """
    snapshot = cache.get(manifest) if cache else read_snapshot(spark, files, manifest)
    allowed = None
    if filters:
        if snapshot is None:
            raise IndexNotBuilt("a filter needs an index; compact first")
        allowed = inverted.matching(snapshot.inverted, filters)
        if not exact and manifest.indexed_rows > EXACT_ROWS:
            exact = allowed.limit(SELECTIVE_IDS + 1).count() <= SELECTIVE_IDS
    order: list[tuple[int, int]] = []
    fanout = None if exact or snapshot is None or manifest.indexed_rows <= EXACT_ROWS else manifest.fanout(k)
    if fanout is not None:  # without a measured fan-out the scan is exact
        order = ann.probe_order(snapshot.centroids, query, manifest.metric)
        fanout = max(fanout, config.search_fanout)
        while fanout < len(order) and sum(n for _, n in order[:fanout]) < k:
            fanout += 1
    state = None
    if manifest.wal:
        state = tail_state(spark, files, manifest)
        if allowed is not None:
            state = state.join(allowed, "id", "left_semi").select(*state.columns)

    def merged(probed: list[int] | None) -> tuple[DataFrame, DataFrame]:
        base = empty(spark, ROW)
        if snapshot is not None:
            base = (snapshot.postings if probed is None else snapshot.postings.where(F.col("posting_id").isin(probed))).drop("posting_id")
            if allowed is not None:
                base = base.join(allowed, "id", "left_semi").select(*base.columns)
        if state is None:
            return base, base
        rows = merge.merge_tail(base, state, manifest.pending_records)
        if probed is not None:  # a row of the log may be older than one in a posting that was not probed
            held = snapshot.postings.select("id", "timestamp").join(merge.bounded(state.select("id"), manifest.pending_records), "id", "left_semi")
            newer = merge.bounded(held.select(F.col("id").alias("base_id"), F.col("timestamp").alias("base_ts")), manifest.pending_records)
            rows = rows.join(newer, (F.col("id") == F.col("base_id")) & (F.col("base_ts") > F.col("timestamp")), "left_anti")
        return base, rows

    while fanout is not None and fanout < len(order):
        base, rows = merged([p for p, _ in order[:fanout]])
        if allowed is None and state is None and not manifest.layers or all(df.limit(k).count() >= k for df in (base, rows)):
            return topk.topk(rows, query, k, manifest.metric, ties=value_order("id"))
        fanout *= 2  # filters, layers or the log left too few of the probed rows
    return topk.topk(merged(None)[1], query, k, manifest.metric, ties=value_order("id"))
