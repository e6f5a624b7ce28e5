"""Manifests: one immutable JSON file for each version of a namespace.

A commit creates the file of the next version, which must not exist.  Whoever loses the race reads the new
version and applies the same change to it again, so no change is lost and none is undone.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from tidemark.errors import CommitConflict, ManifestUnreadable, NamespaceExists, NamespaceNotFound
from tidemark.functions.vectors import COSINE
from tidemark.sources.files import HadoopFiles, LocalFiles

RETRIES = 5


@dataclass(frozen=True)
class WalFile:
    seq: int
    key: str
    records: int
    bytes: int


@dataclass(frozen=True)
class Layer:
    """What compactions laid over the snapshot: new rows, and which rows of older layers they hide."""

    key: str
    size: int  #: log records, of all compactions that are merged in it


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    created_at: int = 0  #: seconds
    updated_at: int = 0
    next_seq: int = 0
    wal: tuple[WalFile, ...] = ()
    snapshot: str | None = None  #: folder of the indexed tables
    layers: tuple[Layer, ...] = ()  #: over the snapshot, oldest first
    indexed_rows: int = 0
    approx_rows: int = 0  #: upserts ever written
    dimensions: int | None = None
    metric: str = COSINE
    index_attributes: tuple[str, ...] = ()
    fanouts: tuple[tuple[int, int], ...] = ()  #: ``(k, postings to probe)`` as measured on the snapshot, k ascending
    retired: tuple[str, ...] = field(default=())  #: keys that the next sweep may delete
    streams: tuple[tuple[str, int], ...] = ()  #: ``(stream, number of its last batch)`` of what streams have committed

    @property
    def pending_wal_files(self) -> int:
        return len(self.wal)

    @property
    def unindexed_bytes(self) -> int:
        return sum(w.bytes for w in self.wal)

    @property
    def pending_records(self) -> int:
        return sum(w.records for w in self.wal)

    @property
    def index_status(self) -> str:
        return "updating" if self.wal else "up-to-date"

    def fanout(self, k: int) -> int | None:
        """Postings to probe for ``k`` rows; None if that was not measured."""
        return next((fanout for most, fanout in self.fanouts if k <= most), None)

    def to_json(self) -> bytes:
        return json.dumps(asdict(self), indent=1).encode()

    @staticmethod
    def from_json(raw: bytes) -> Manifest:
        values = json.loads(raw)
        return Manifest(**values | {"wal": tuple(WalFile(**w) for w in values["wal"]), "layers": tuple(Layer(**x) for x in values.get("layers", ())), "index_attributes": tuple(values["index_attributes"]), "retired": tuple(values["retired"]), "fanouts": tuple(tuple(f) for f in values.get("fanouts", ())), "streams": tuple(tuple(s) for s in values.get("streams", ()))})


class Manifests:
    """The versions of one namespace."""

    def __init__(self, files: LocalFiles | HadoopFiles, namespace: str):
        self.files, self.namespace = files, namespace
        self._read: tuple[str, Manifest] | None = None  #: the version read last; versions never change

    def _key(self, version: int) -> str:
        return f"{self.namespace}/manifest/v{version:012d}.json"

    def latest(self) -> Manifest:
        names = [n for n in self.files.list(f"{self.namespace}/manifest") if n.endswith(".json")]
        if not names:
            raise NamespaceNotFound(self.namespace)
        if self._read is None or self._read[0] != names[-1]:
            self._read = names[-1], self._parse(names[-1])
        return self._read[1]

    def _parse(self, name: str) -> Manifest:
        try:
            return Manifest.from_json(self.files.get(f"{self.namespace}/manifest/{name}") or b"")
        except (ValueError, KeyError, TypeError) as e:
            raise ManifestUnreadable(f"{self.namespace}/manifest/{name}") from e

    def readable(self) -> tuple[Manifest, int]:
        """The newest version that can be read, and the number of the newest of all."""
        names = [n for n in self.files.list(f"{self.namespace}/manifest") if n.endswith(".json")]
        if not names:
            raise NamespaceNotFound(self.namespace)
        for name in reversed(names):
            try:
                return self._parse(name), int(names[-1][1:-5])
            except ManifestUnreadable:
                continue
        raise ManifestUnreadable(self.namespace)

    def put(self, manifest: Manifest) -> Manifest:
        """Writes a version that must be new."""
        self.files.put_new(self._key(manifest.version), manifest.to_json())
        return manifest

    def create(self, **values: object) -> Manifest:
        now = int(time.time())
        first = Manifest(created_at=now, updated_at=now, **values)
        try:
            self.files.put_new(self._key(0), first.to_json())
        except CommitConflict as e:
            raise NamespaceExists(self.namespace) from e
        return first

    def commit(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        """Applies ``change`` to the newest version; it must check what it needs each time it is called."""
        for attempt in range(RETRIES):
            base = self.latest()
            new = replace(change(base), version=base.version + 1, created_at=base.created_at, updated_at=int(time.time()))
            try:
                self.files.put_new(self._key(new.version), new.to_json())
                return new
            except CommitConflict:
                time.sleep(0.01 * 2**attempt)
        raise CommitConflict(f"{self.namespace}: {RETRIES} writers were faster")

    def forget(self, keep: int) -> None:
        """Delete all but the newest versions."""
        for name in self.files.list(f"{self.namespace}/manifest")[:-keep]:
            self.files.delete(f"{self.namespace}/manifest/{name}")
