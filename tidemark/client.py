"""The client: namespaces of documents that are written, searched and compacted."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace as with_values
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import DimensionMismatch, DistanceMetricConflict, InvalidRequest, ManifestUnreadable
from tidemark.functions import attrs, ids, names, vectors
from tidemark.operators import ann
from tidemark.operators.replay import DELETE, PATCH, UPSERT
from tidemark.plans import compact as compaction
from tidemark.plans import query as plans
from tidemark.session import ship_package
from tidemark.sources import log
from tidemark.sources.files import Cached, Counted, open_files
from tidemark.sources.manifest import Manifest, Manifests, WalFile

MAX_TOP_K, DEFAULT_TOP_K = 1000, 10
COMPACT_FILES, COMPACT_BYTES = 8, 32 << 20


class Client:
    """All namespaces under one folder."""

    def __init__(self, spark: SparkSession, root: str, config: ann.AnnConfig = ann.AnnConfig(), max_top_k: int = MAX_TOP_K, auto_compact: bool = False, cache_folder: str | None = None):
        """``cache_folder`` on the driver's disk keeps control objects of remote stores; tables are Spark's to cache."""
        self.files = Counted(open_files(spark, root))
        if cache_folder:
            self.files = Cached(self.files, cache_folder)
        self.spark, self.config, self.max_top_k, self.auto_compact = spark, config, max_top_k, auto_compact
        ship_package(spark)
        self.snapshots = plans.SnapshotCache(spark, self.files)

    def create_namespace(self, name: str, metric: str = vectors.COSINE, index_attributes: Iterable[str] = ()) -> Namespace:
        if metric not in vectors.METRICS:
            raise InvalidRequest(f"unknown metric {metric!r}")
        Manifests(self.files, names.check(name)).create(metric=metric, index_attributes=tuple(sorted(set(index_attributes))))
        return Namespace(self, name)

    def namespace(self, name: str) -> Namespace:
        """An existing namespace."""
        space = Namespace(self, names.check(name))
        space.manifest()
        return space

    def round_trips(self) -> dict[str, int]:
        """Requests to the store so far, by kind; Spark's own reads and writes of tables are not among them."""
        return dict((self.files.files if isinstance(self.files, Cached) else self.files).counts)

    def namespaces(self) -> list[str]:
        return [n for n in self.files.list("") if self.files.list(f"{n}/manifest")]


class Namespace:
    def __init__(self, client: Client, name: str):
        self.client, self.name, self.spark = client, name, client.spark
        self.manifests = Manifests(client.files, name)

    def manifest(self) -> Manifest:
        return self.manifests.latest()

    # writing

    def upsert(self, rows: Sequence[Mapping[str, Any]], metric: str | None = None, timestamp: int | None = None) -> int:
        """Whole rows ``{"id", "vector", "attributes"}``; an id that exists is replaced."""
        if not rows:
            raise InvalidRequest("no rows")
        now = _now(timestamp)
        return self._write(self._records(_upserts(rows, now)), metric)

    def delete(self, doc_ids: Sequence[Any], timestamp: int | None = None) -> int:
        """Tombstones; the count is of tombstones, not of matches."""
        if not doc_ids:
            raise InvalidRequest("no ids")
        now = _now(timestamp)
        return self._write(self._records(_deletes(doc_ids, now)))

    def patch(self, rows: Sequence[Mapping[str, Any]], timestamp: int | None = None) -> int:
        """Attributes ``{"id", "attributes"}`` laid over those of a row; vectors can't be patched."""
        if not rows:
            raise InvalidRequest("no rows")
        now = _now(timestamp)
        return self._write(self._records(_patches(rows, now)))

    def write_frame(self, records: DataFrame, metric: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """A table of log records (see ``sources.log.RECORD``): the way in for large loads and for streams.

        ``batch`` names a stream and the number of its batch: the number is part of the commit, so a batch
        that was committed before is not written again, and 0 is returned.
        """
        return self._write(records.select(*[f.name for f in log.schema(log.RECORD)]), metric, batch)

    def batcher(self, **limits: int) -> Batcher:
        """A buffer of writes that become one commit."""
        return Batcher(self, **limits)

    def _records(self, records: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame([(k, *r) for k, r in enumerate(records)], log.schema(log.RECORD))

    def _write(self, records: DataFrame, metric: str | None = None, batch: tuple[str, int] | None = None) -> int:
        if metric is not None and metric not in vectors.METRICS:
            raise InvalidRequest(f"unknown metric {metric!r}")
        base = self.manifest()
        if batch and dict(base.streams).get(batch[0], -1) >= batch[1]:
            return 0
        wanted = metric or base.metric
        _check_metric(base, metric)
        if wanted == vectors.COSINE:
            records = records.withColumn("vector", F.when(F.col("vector").isNotNull(), vectors.normalize(F.col("vector"))).cast("array<float>"))
        key = f"{self.name}/wal/{uuid.uuid4().hex}"
        log.append(records, self.client.files, key)
        seen = self._seen(key)
        size = self.client.files.size(key)
        if seen["low"] != seen["high"]:
            self.client.files.delete(key)
            raise DimensionMismatch(f"vectors of {seen['low']} and {seen['high']} dimensions")

        def add(now: Manifest) -> Manifest:
            _check_metric(now, metric)
            if batch and dict(now.streams).get(batch[0], -1) >= batch[1]:
                raise _Committed
            if seen["low"] is not None and now.dimensions not in (None, seen["low"]):
                raise DimensionMismatch(f"{self.name} holds {now.dimensions} dimensions, not {seen['low']}")
            if wanted != (metric or now.metric):
                raise DistanceMetricConflict("the metric changed while this was written")
            file = WalFile(now.next_seq, key, seen["n"], size)
            return with_values(now, wal=(*now.wal, file), next_seq=now.next_seq + 1, approx_rows=now.approx_rows + seen["upserts"], dimensions=now.dimensions if seen["low"] is None else seen["low"], metric=wanted, streams=tuple(sorted((dict(now.streams) | dict([batch])).items())) if batch else now.streams)

        try:
            manifest = self.manifests.commit(add)
        except _Committed:
            self.client.files.delete(key)
            return 0
        except Exception:
            self.client.files.delete(key)
            raise
        if self.client.auto_compact and (manifest.pending_wal_files >= COMPACT_FILES or manifest.unindexed_bytes >= COMPACT_BYTES):
            self.compact()
        return seen["n"]

    def _seen(self, key: str) -> Row:
        """What a folder of the log holds: its records, its upserts, and the least and largest dimensions."""
        written = self.spark.read.schema(log.schema(log.RECORD)).parquet(self.client.files.path(key))
        upsert = F.col("op") == UPSERT
        return written.agg(F.count(F.lit(1)).alias("n"), F.count_if(upsert).alias("upserts"), F.min(F.when(upsert, F.size("vector"))).alias("low"), F.max(F.when(upsert, F.size("vector"))).alias("high")).first()

    # reading

    def query(self, vector: Sequence[float], top_k: int = DEFAULT_TOP_K, filters: Mapping[str, str] | None = None, exact: bool = False) -> DataFrame:
        """The nearest rows ``(id, vector, attributes, timestamp, dist)``, nearest first."""
        query = [float(x) for x in vector]
        if not query:
            raise InvalidRequest("a query needs a vector")
        if not 1 <= top_k <= self.client.max_top_k:
            raise InvalidRequest(f"top_k is 1 to {self.client.max_top_k}")
        manifest = self.manifest()
        if manifest.dimensions is not None and len(query) != manifest.dimensions:
            raise DimensionMismatch(f"{self.name} holds {manifest.dimensions} dimensions, not {len(query)}")
        if manifest.metric == vectors.COSINE:
            query = vectors.normalized(query)
        return plans.search(self.spark, self.client.files, manifest, query, top_k, filters, self.client.config, exact, self.client.snapshots)

    def results(self, found: DataFrame) -> list[dict[str, Any]]:
        """Query rows as JSON values; at most ``top_k`` of them."""
        return [{"id": ids.display(r["id"]["bytes"], r["id"]["id_type"]), "vector": list(r["vector"]), "attributes": {k: json.loads(a["json"]) for k, a in (r["attributes"] or {}).items()}, "timestamp": r["timestamp"], "dist": r["dist"]} for r in found.collect()]

    def rows(self) -> DataFrame:
        """All live rows."""
        return plans.live_rows(self.spark, self.client.files, self.manifest())

    def get(self, doc_id: Any) -> dict[str, Any] | None:
        """One live row."""
        raw, kind = ids.encode(doc_id)
        found = plans.lookup(self.spark, self.client.files, self.manifest(), raw, kind).withColumn("dist", F.lit(None).cast("double"))
        return next(iter(self.results(found)), None)

    def metadata(self) -> dict[str, Any]:
        m = self.manifest()
        return {
            "name": self.name, "approx_row_count": m.approx_rows, "indexed_row_count": m.indexed_rows, "pending_wal_files": m.pending_wal_files, "unindexed_bytes": m.unindexed_bytes,
            "vector_dimensions": m.dimensions, "distance_metric": m.metric, "index_status": m.index_status, "created_at": m.created_at, "updated_at": m.updated_at,
        }

    def schema(self) -> list[str]:
        return list(self.manifest().index_attributes)

    def set_schema(self, index_attributes: Iterable[str]) -> None:
        """Which attributes later compactions index (none named: all); indexed rows are not gone over again."""
        wanted = tuple(sorted(set(index_attributes)))
        self.manifests.commit(lambda now: with_values(now, index_attributes=wanted))

    # maintenance

    def compact(self, force: bool = False) -> bool:
        return compaction.compact(self.spark, self.client.files, self.manifests, self.client.config, force) is not None

    def repair(self) -> int:
        """Makes a namespace readable again whose newest manifest is not; the number of commits found in the listing of the log.

        The newest readable version is taken up, with the folders of the log that it does not know, in the order
        of their writing.  Writes that were never acknowledged may be among them; those that were cut short, or
        whose vectors have other dimensions, are not.  If a sweep deleted what that version needs, it fails.
        """
        base, newest = self.manifests.readable()
        if base.version == newest:
            return 0
        needed = [w.key for w in base.wal] + ([base.snapshot] if base.snapshot else []) + [x.key for x in base.layers]
        if missing := [key for key in needed if not self.client.files.list(key)]:
            raise ManifestUnreadable(f"{self.name}: version {base.version} needs {', '.join(missing)}")
        known, dimensions, approx, wal = {w.key for w in base.wal} | set(base.retired), base.dimensions, base.approx_rows, list(base.wal)
        folders = [f"{self.name}/wal/{name}" for name in self.client.files.list(f"{self.name}/wal")]
        done = [(self.client.files.modified(f"{key}/_SUCCESS"), key) for key in folders if key not in known]
        for written, key in sorted(done):
            if not written:
                continue
            seen = self._seen(key)
            if seen["low"] != seen["high"] or seen["low"] is not None and dimensions not in (None, seen["low"]):
                continue
            dimensions = dimensions if seen["low"] is None else seen["low"]
            approx += seen["upserts"]
            wal.append(WalFile(base.next_seq + len(wal) - len(base.wal), key, seen["n"], self.client.files.size(key)))
        found = len(wal) - len(base.wal)
        self.manifests.put(with_values(base, version=newest + 1, updated_at=int(time.time()), wal=tuple(wal), next_seq=base.next_seq + found, dimensions=dimensions, approx_rows=approx))
        return found

    def sweep(self) -> int:
        return compaction.sweep(self.client.files, self.manifests)


class Batcher:
    """Writes of one namespace, committed together in their order: by number, bytes of vectors and attributes, or age.

    Ages are looked at with each write and by ``poll``; leaving the ``with`` block commits what is left.
    """

    def __init__(self, space: Namespace, max_rows: int = 1000, max_bytes: int = 8 << 20, max_age_ms: int = 200):
        self.space, self.max_rows, self.max_bytes, self.max_age_ms = space, max_rows, max_bytes, max_age_ms
        self.held: list[tuple] = []
        self.bytes, self.since = 0, 0.0

    def upsert(self, rows: Sequence[Mapping[str, Any]], timestamp: int | None = None) -> None:
        self._hold(_upserts(rows, _now(timestamp)))

    def delete(self, doc_ids: Sequence[Any], timestamp: int | None = None) -> None:
        self._hold(_deletes(doc_ids, _now(timestamp)))

    def patch(self, rows: Sequence[Mapping[str, Any]], timestamp: int | None = None) -> None:
        self._hold(_patches(rows, _now(timestamp)))

    def _hold(self, records: list[tuple]) -> None:
        self.since = self.since if self.held else time.monotonic()
        self.held += records
        self.bytes += sum(len(i[0]) + 4 * len(vector or ()) + sum(len(x["json"]) for x in (attributes or {}).values()) for _, i, vector, attributes, _ in records)
        self.poll()

    def poll(self) -> int:
        """Commits if a limit is reached; the number of records committed."""
        old = self.held and (time.monotonic() - self.since) * 1000 >= self.max_age_ms
        return self.flush() if len(self.held) >= self.max_rows or self.bytes >= self.max_bytes or old else 0

    def flush(self) -> int:
        if not self.held:
            return 0
        n = self.space._write(self.space._records(self.held))
        self.held, self.bytes = [], 0
        return n

    def __enter__(self) -> Batcher:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            self.flush()


class _Committed(Exception):
    """A stream's batch is in the manifest already."""


def _upserts(rows: Sequence[Mapping[str, Any]], now: int) -> list[tuple]:
    out = []
    for row in rows:
        vector = [float(x) for x in row.get("vector") or ()]
        if not vector:
            raise InvalidRequest("a row needs a vector")
        out.append((UPSERT, ids.encode(row["id"]), vector, _attributes(row.get("attributes")), now))
    return out


def _deletes(doc_ids: Sequence[Any], now: int) -> list[tuple]:
    return [(DELETE, ids.encode(i), None, None, now) for i in doc_ids]


def _patches(rows: Sequence[Mapping[str, Any]], now: int) -> list[tuple]:
    if any("vector" in row for row in rows):
        raise InvalidRequest("a patch has no vector")
    return [(PATCH, ids.encode(r["id"]), None, _attributes(r.get("attributes")), now) for r in rows]


def _now(timestamp: int | None) -> int:
    return int(time.time() * 1000) if timestamp is None else timestamp


def _attributes(values: Mapping[str, Any] | None) -> dict[str, dict[str, str]]:
    return {name: attrs.encode(value, name) for name, value in (values or {}).items()}


def _check_metric(manifest: Manifest, metric: str | None) -> None:
    if metric is not None and metric != manifest.metric and (manifest.approx_rows or manifest.wal or manifest.indexed_rows):
        raise DistanceMetricConflict(f"the metric is {manifest.metric}")
