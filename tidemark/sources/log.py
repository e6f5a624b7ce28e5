"""The log: one folder of Parquet for each commit, in the order of the manifest's sequence numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.attrs import ATTRS_TYPE
from tidemark.functions.ids import ID_TYPE
from tidemark.sources.files import HadoopFiles, LocalFiles
from tidemark.sources.manifest import Manifest, WalFile

#: ``offset`` orders the records of one commit.
RECORD = f"offset long, op string, id {ID_TYPE}, vector array<float>, attributes {ATTRS_TYPE}, timestamp long"
LOG = f"wal_seq long, {RECORD}"
MAX_FILES, MAX_BYTES = 32, 64 << 20


def schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


def append(records: DataFrame, files: LocalFiles | HadoopFiles, key: str) -> None:
    """Write records durably; they count once a manifest names the folder."""
    records.write.parquet(files.path(key))


def scan(spark: SparkSession, files: LocalFiles | HadoopFiles, wal: tuple[WalFile, ...]) -> DataFrame:
    """All records of the named commits with their sequence number, which the manifest gives each folder."""
    if not wal:
        return spark.createDataFrame([], schema(LOG))
    rows = spark.read.schema(schema(RECORD)).parquet(*[files.path(w.key) for w in wal])
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/wal/([0-9a-f]+)/", 1)
    seq = F.create_map(*[F.lit(x) for w in wal for x in (w.key.rsplit("/", 1)[1], w.seq)])
    return rows.select(F.element_at(seq, folder).cast("long").alias("wal_seq"), *rows.columns)


def batch(manifest: Manifest, force: bool = False, most_files: int = MAX_FILES, most_bytes: int = MAX_BYTES) -> tuple[WalFile, ...]:
    """The commits that one compaction takes: the oldest, up to both limits unless forced, but always one."""
    out: list[WalFile] = []
    total = 0
    for w in manifest.wal[:most_files]:
        if out and not force and total + w.bytes > most_bytes:
            break
        out.append(w)
        total += w.bytes
    return tuple(out)
