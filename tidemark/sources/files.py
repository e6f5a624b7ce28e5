"""Objects in a folder: whole reads and writes, writes that must be the first, listings.

Local folders use the operating system, other URIs the Hadoop file system of the session.  Only small
control objects pass through here; tables are read and written by Spark.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections import Counter
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.errors import CommitConflict


class LocalFiles:
    def __init__(self, root: str):
        self.root = Path(root.removeprefix("file://"))

    def path(self, key: str) -> str:
        return str(self.root / key)

    def get(self, key: str) -> bytes | None:
        try:
            return (self.root / key).read_bytes()
        except FileNotFoundError:
            return None

    def put_new(self, key: str, data: bytes) -> None:
        """Writes an object that must not exist; readers see it whole or not at all."""
        target = self.root / key
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        part.write_bytes(data)
        try:
            os.link(part, target)  # fails if the name is taken
        except FileExistsError as e:
            raise CommitConflict(key) from e
        finally:
            part.unlink()

    def list(self, prefix: str) -> list[str]:
        """Names directly under a folder, sorted."""
        folder = self.root / prefix
        return sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) if folder.is_dir() else []

    def delete(self, key: str) -> None:
        target = self.root / key
        if target.is_dir():
            shutil.rmtree(target, ignore_errors=True)
        else:
            target.unlink(missing_ok=True)

    def size(self, key: str) -> int:
        target = self.root / key
        return sum(p.stat().st_size for p in target.rglob("*") if p.is_file()) if target.is_dir() else target.stat().st_size if target.exists() else 0

    def modified(self, key: str) -> int:
        """Milliseconds of the last change, 0 if there is no such object."""
        target = self.root / key
        return target.stat().st_mtime_ns // 1_000_000 if target.exists() else 0


class HadoopFiles:
    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def get(self, key: str) -> bytes | None:
        where = self._path(key)
        if not self.fs.exists(where):
            return None
        stream = self.fs.open(where)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put_new(self, key: str, data: bytes) -> None:
        """The store must create atomically; object stores need a connector with conditional writes."""
        try:
            stream = self.fs.create(self._path(key), False)
        except Exception as e:
            if self.fs.exists(self._path(key)):
                raise CommitConflict(key) from e
            raise
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def list(self, prefix: str) -> list[str]:
        where = self._path(prefix)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where) if not s.getPath().getName().startswith(".")) if self.fs.exists(where) else []

    def delete(self, key: str) -> None:
        self.fs.delete(self._path(key), True)

    def size(self, key: str) -> int:
        where = self._path(key)
        return self.fs.getContentSummary(where).getLength() if self.fs.exists(where) else 0

    def modified(self, key: str) -> int:
        where = self._path(key)
        return self.fs.getFileStatus(where).getModificationTime() if self.fs.exists(where) else 0


class Counted:
    """A store that counts its requests by kind."""

    def __init__(self, files: LocalFiles | HadoopFiles):
        self.files, self.counts = files, Counter()

    def path(self, key: str) -> str:
        return self.files.path(key)

    def get(self, key: str) -> bytes | None:
        self.counts["get"] += 1
        return self.files.get(key)

    def put_new(self, key: str, data: bytes) -> None:
        self.counts["put"] += 1
        self.files.put_new(key, data)

    def list(self, prefix: str) -> list[str]:
        self.counts["list"] += 1
        return self.files.list(prefix)

    def delete(self, key: str) -> None:
        self.counts["delete"] += 1
        self.files.delete(key)

    def size(self, key: str) -> int:
        self.counts["size"] += 1
        return self.files.size(key)

    def modified(self, key: str) -> int:
        self.counts["modified"] += 1
        return self.files.modified(key)


class Cached:
    """A store whose written and read objects are kept in a folder of the driver's disk, the oldest dropped beyond a size.

    For objects that never change once written, as manifests are.  What a name holds can differ only after a
    ``delete``, which drops it here as well; deletes by others are not seen, so listings always ask the store.
    A disk that fails is passed over: the store answers.
    """

    def __init__(self, files: LocalFiles | HadoopFiles, folder: str, most_bytes: int = 256 << 20):
        self.files, self.folder, self.most_bytes = files, Path(folder), most_bytes
        self.folder.mkdir(parents=True, exist_ok=True)
        self.hits = 0

    def _place(self, key: str) -> Path:
        return self.folder / hashlib.sha256(key.encode()).hexdigest()

    def _keep(self, key: str, data: bytes) -> None:
        if len(data) > self.most_bytes:
            return
        part = self.folder / f".{uuid.uuid4().hex}"
        try:
            part.write_bytes(data)
            part.replace(self._place(key))  # readers see it whole or not at all
            held = sorted(((p.stat().st_mtime_ns, p.stat().st_size, p) for p in self.folder.iterdir() if not p.name.startswith(".")), reverse=True)
            total = 0
            for _, size, place in held:
                total += size
                if total > self.most_bytes:
                    place.unlink(missing_ok=True)
        except OSError:
            part.unlink(missing_ok=True)

    def path(self, key: str) -> str:
        return self.files.path(key)

    def get(self, key: str) -> bytes | None:
        try:
            data = self._place(key).read_bytes()
            self.hits += 1
            return data
        except OSError:
            data = self.files.get(key)
        if data is not None:
            self._keep(key, data)
        return data

    def put_new(self, key: str, data: bytes) -> None:
        self.files.put_new(key, data)  # first the store: a lost race must not be cached
        self._keep(key, data)

    def list(self, prefix: str) -> list[str]:
        return self.files.list(prefix)

    def delete(self, key: str) -> None:
        self._place(key).unlink(missing_ok=True)
        self.files.delete(key)

    def size(self, key: str) -> int:
        return self.files.size(key)

    def modified(self, key: str) -> int:
        return self.files.modified(key)


def open_files(spark: SparkSession, root: str) -> LocalFiles | HadoopFiles:
    return LocalFiles(root) if root.startswith(("/", "file://")) else HadoopFiles(spark, root)
