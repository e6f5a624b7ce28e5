"""Token ids in patched frame-of-reference blocks.

A *segment* is a self-contained byte string of whole documents in ascending id order:

    magic "PFR1" | u32 n_docs | u32 n_ids | u32 n_blocks | u32 n_exceptions
    u64 id[n_docs] (two's complement) | u8 has_id[n_docs] | u64 n_tokens[n_docs]
    u32 block_start[n_blocks + 1]   byte offset of each block's packed values, relative to their area
    u32 exception_start[n_blocks + 1]
    u32 minimum[n_blocks] | u8 width[n_blocks]
    u16 exception_slot[n_exceptions] | u32 exception_value[n_exceptions]
    packed values, little-endian bit order

A block holds 512 ids less the block's minimum.  Its width is the number of bits that a fixed percentile
of its values needs; larger values leave their slot's low bits and are stored whole in the exception
list.  Block starts are indexed, so one block can be read alone.

Segments are the rows of a table that Spark writes and commits, so a lost executor or a repeated task
leaves no torn file, and any store that Spark can write to will do.  Texts are range-partitioned by id and
sorted before they are encoded; a file's first id offset follows from the id counts of the files before it.

Defined results: a null text counts as empty and holds the end id alone; rows are ordered by id, null ids
first, rows that repeat an id by a hash of their text; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, table
from tidemark.llm.tokens import KEPT, default_path, encoder, gathered, slices

BLOCK = 512
PERCENTILE = 0.98
SEGMENT_IDS = 1 << 16
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIIII")
SEGMENTS = "part int, part_start long, n_docs long, n_ids long, payload binary"


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], percentile: float = PERCENTILE) -> bytes:
    """One segment."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    grid = np.zeros((n_blocks, BLOCK), np.int64)
    grid.reshape(-1)[:n] = ids
    if n_blocks:
        grid.reshape(-1)[n:] = ids[-1]
    low = grid.min(axis=1) if n_blocks else np.zeros(0, np.int64)
    rest = grid - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    bound = np.partition(rest, rank, axis=1)[:, rank] if n_blocks else low
    width = np.array([int(b).bit_length() for b in bound], np.uint8)
    block, slot = np.nonzero(rest >> width[:, None].astype(np.int64))
    inside = block * BLOCK + slot < n
    block, slot = block[inside], slot[inside]
    exception_start = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=n_blocks))]).astype("<u4")
    block_start = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))]).astype("<u4")
    packed = np.zeros(int(block_start[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            if w == 16:
                packed[block_start[rows].astype(np.int64)[:, None] + np.arange(2 * BLOCK)] = (rest[rows] & 0xFFFF).astype("<u2").view(np.uint8)
                continue
            bits = np.unpackbits((rest[rows] & ((1 << int(w)) - 1)).astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little", count=int(w))
            size = int(w) * (BLOCK // 8)
            packed[block_start[rows].astype(np.int64)[:, None] + np.arange(size)] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
    has = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        x if isinstance(x, bytes) else x.tobytes()
        for x in (
            HEAD.pack(MAGIC, len(doc_ids), n, n_blocks, len(block)),
            np.array([0 if d is None else d for d in doc_ids], "<i8"), has, np.array(lengths, "<u8"),
            block_start, exception_start, low.astype("<u4"), width, slot.astype("<u2"), grid[block, slot].astype("<u4"), packed,
        )
    )


def unpack(payload: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """``(ids, doc_ids, lengths)`` of one segment."""
    magic, n_docs, n, n_blocks, n_exceptions = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEAD.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, dtype, count, at)
        at += out.nbytes
        return out

    raw, has, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    block_start, exception_start = take("<u4", n_blocks + 1).astype(np.int64), take("<u4", n_blocks + 1).astype(np.int64)
    low, width = take("<u4", n_blocks), take("u1", n_blocks)
    slot, value = take("<u2", n_exceptions), take("<u4", n_exceptions)
    packed = np.frombuffer(payload, np.uint8, offset=at)
    grid = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            size = int(w) * (BLOCK // 8)
            if w == 16:
                grid[rows] = packed[block_start[rows][:, None] + np.arange(size)].view("<u2")
                continue
            bits = np.unpackbits(packed[block_start[rows][:, None] + np.arange(size)], axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            wide = np.packbits(bits, axis=2, bitorder="little")
            full = np.zeros((len(rows), BLOCK, 4), np.uint8)
            full[:, :, : wide.shape[2]] = wide
            grid[rows] = full.view("<u4")[:, :, 0]
    grid += low[:, None]
    grid[np.repeat(np.arange(n_blocks), np.diff(exception_start)), slot] = value
    return grid.reshape(-1)[:n], [int(d) if h else None for d, h in zip(raw, has, strict=True)], lengths


def write_segments(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, in ascending id order, into a table of segments at ``path``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body")).withColumn("tie", F.xxhash64("body"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer, KEPT), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def segment(docs_held: int, n: int) -> pa.RecordBatch:
            """Flush the first documents that are held, with their ids."""
            nonlocal at
            ids = np.concatenate(held) if len(held) > 1 else held[0]
            row = [[part], [at], [docs_held], [n], [pack(ids[:n], doc_ids[:docs_held], lengths[:docs_held])]]
            at += n
            held[:] = [ids[n:]]
            del doc_ids[:docs_held], lengths[:docs_held]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "part_start", "n_docs", "n_ids", "payload"])

        for batch in gathered(batches, "body", 1 << 23):
            for some in slices(batch, "body", 1 << 23, keep=True):
                ids, n = enc.encode(some["body"])
                held.append(np.insert(ids, np.cumsum(n), enc.dtype.type(end_id)))
                doc_ids += some["doc_id"].to_pylist()
                lengths += (n + 1).tolist()
                ends = np.cumsum(lengths)
                done = 0
                while len(ends) and ends[-1] - done >= SEGMENT_IDS:
                    k = int(np.searchsorted(ends, done + SEGMENT_IDS)) + 1
                    k_docs = k - int(np.searchsorted(ends, done, side="right"))
                    yield segment(k_docs, int(ends[k - 1]) - done)
                    done = int(ends[k - 1])
        if doc_ids:
            yield segment(len(doc_ids), sum(lengths))

    rows.select("doc_id", "body").mapInArrow(encode, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document in the files at ``path``."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each file
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    base = spark.createDataFrame(starts, "part int, base long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base_at, part_start, payload in zip(batch["base"].to_pylist(), batch["part_start"].to_pylist(), batch["payload"], strict=True):
                ids, doc_ids, lengths = unpack(payload.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths.astype(np.int64)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(begins + (base_at + part_start)), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = segments.join(F.broadcast(base), "part").select("base", "part_start", "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_segments(table(spark, sf_dir, "documents"), path, tokenizer or default_path("byte_bpe_50k.json"))
    return read_segments(spark, path)
