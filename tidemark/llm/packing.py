"""Packing by cutting-stock column generation.

1. Every text is encoded once.  Lengths beyond a sequence give whole sequences; what remains of each
   document is an item.  One document in 16 (by its place in its input split) is held back as filler.
2. The histogram of item lengths, at most 144 classes at any scale, is the demand of a cutting-stock
   problem.  Its linear program is solved by column generation: a revised simplex whose columns are
   priced by a knapsack dynamic program over the dual values.  Pattern counts are rounded down and the
   rest, a number of items that does not grow with the input, is packed greedily.
3. Items are ranked within their class (the offsets of each input split plus a local count, so no task
   sees a whole class), and arithmetic on the rank names the sequence.
4. What rounding lengths up to classes left open is filled by cutting the filler documents, in independent
   groups of about a thousand sequences; filler beyond that makes whole sequences, and the last ids of a
   group sequences at powers of two, which need no padding.

Defined results: a null text counts as empty; an empty text is its end id alone; rows that repeat an id or
a text are packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import store, table
from tidemark.llm.tokens import DROPPED, default_path, encoder, gathered, slices

CAPACITY = 4096
FILLER_EVERY = 16
SEQUENCES_IN_GROUP = 1024
FULL, ITEM, FILLER = 0, 1, 2
ENCODED = "kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, part int, local long, sequence_id long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FULL_BASE, _GROUP_BASE = 1 << 60, 1 << 40


def length_classes(capacity: int = CAPACITY) -> np.ndarray:
    """Upper bounds: every length up to 32, then 16 for each doubling, so rounding up adds under 1/16."""
    edges = list(range(1, min(32, capacity) + 1))
    while edges[-1] < capacity:
        step = max(1, edges[-1] // 16)
        edges += [min(edges[-1] + step * k, capacity) for k in range(1, 17)]
    return np.array(sorted(set(edges)))


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern and its value."""
    best = np.zeros(capacity + 1)
    for i in np.flatnonzero(values > 1e-12):
        size, value = int(sizes[i]), float(values[i])
        while size <= capacity:  # copies by doubling: any count up to the most that fits
            np.maximum(best[size:], best[:-size] + value, out=best[size:])
            size, value = 2 * size, 2 * value
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while True:
        fits = np.flatnonzero((sizes <= room) & (values > 1e-12))
        if not len(fits):
            return float(best[capacity]), pattern
        gain = values[fits] + best[room - sizes[fits]]
        k = int(np.argmax(gain))
        if gain[k] < best[room] - 1e-9 or best[room] <= 1e-12:
            return float(best[capacity]), pattern
        pattern[fits[k]] += 1
        room -= int(sizes[fits[k]])


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = 3e-3, most: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """``(patterns, amounts)`` of the linear program: columns cover the demand with the fewest sequences.

    Stops at optimality, or when the bound that the duals give is within ``gap`` of the value.
    """
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(np.int64)  # column j is row j
    inverse = np.diag(1.0 / (capacity // sizes))
    amount = inverse @ demand
    for _ in range(most):
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(duals, sizes, capacity)
        if value <= 1 + 1e-7 or amount.sum() * (1 - 1 / value) <= gap * amount.sum():
            break
        direction = inverse @ pattern
        ok = direction > 1e-9
        ratio = np.where(ok, amount / np.where(ok, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        theta = max(0.0, float(ratio[out]))
        amount = amount - theta * direction
        amount[out] = theta
        np.maximum(amount, 0, out=amount)
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        columns[out] = pattern
    return columns[:m], amount


def cutting_plan(histogram: dict[int, int], edges: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows ``(cls, lo, hi, first_sequence, per_sequence)`` over ranks of each class, and the number of sequences."""
    classes = np.array(sorted(c for c, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(classes):
        return [], 0
    sizes, demand = edges[classes], np.array([histogram[int(c)] for c in classes], dtype=np.int64)
    columns, amount = solve_patterns(sizes, demand.astype(float), capacity)
    left, at = demand.copy(), 0
    taken = np.zeros(len(classes), np.int64)
    rows: list[tuple[int, int, int, int, int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal at
        for i in np.flatnonzero(pattern):
            n = int(pattern[i]) * times
            rows.append((int(classes[i]), int(taken[i]), int(taken[i]) + n, at, int(pattern[i])))
            taken[i] += n
            left[i] -= n
        at += times

    for pattern, x in sorted(zip(columns, amount, strict=True), key=lambda p: -p[1]):
        held = pattern > 0
        if held.any() and (times := min(int(x + 1e-6), int((left[held] // pattern[held]).min()))) > 0:
            use(pattern, times)
    while left.any():  # what rounding down left: as many items as the rounded patterns hold, at most
        pattern, room = np.zeros(len(classes), np.int64), capacity
        for i in range(len(classes) - 1, -1, -1):
            pattern[i] = min(int(left[i]), room // int(sizes[i]))
            room -= int(pattern[i]) * int(sizes[i])
        held = pattern > 0
        use(pattern, int((left[held] // pattern[held]).min()))
    return rows, at


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, filler_every: int = FILLER_EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Step 1: whole sequences, items and filler documents."""
    edges = length_classes(capacity)
    class_of = np.searchsorted(edges, np.arange(capacity + 1)).tolist()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, DROPPED), TaskContext.get().partitionId()
        local, count, full = np.zeros(len(edges), np.int64), 0, 0
        fields = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("cls", pa.int32()), ("part", pa.int32()), ("local", pa.int64()), ("sequence_id", pa.int64()), ("ids", pa.binary())])
        for batch in gathered(batches, "body", 1 << 21):
            rows = []
            for some in slices(batch, "body", keep=True):
                flat, lengths = enc.encode(some["body"])
                flat = np.insert(flat, np.cumsum(lengths), enc.dtype.type(end_id)).astype("<u4")
                lengths += 1
                raw, at = memoryview(flat).cast("B"), 0
                for doc_id, n in zip(some["doc_id"].to_pylist(), lengths.tolist(), strict=True):
                    ids = raw[4 * at : 4 * (at + n)]
                    at += n
                    count += 1
                    if count % filler_every == filler_every // 2:
                        rows.append((FILLER, doc_id, 0, n, None, n, None, part, count, None, ids.tobytes()))
                        continue
                    whole = n // capacity * capacity
                    for start in range(0, whole, capacity):
                        rows.append((FULL, doc_id, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), n, None, part, None, _FULL_BASE + (part << 32) + full, None))
                        full += 1
                    if whole < n:
                        cls = class_of[n - whole]
                        rows.append((ITEM, doc_id, whole, n - whole, zlib.crc32(ids[4 * whole :]), n, cls, part, int(local[cls]), None, None))
                        local[cls] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body")).mapInArrow(encode, ENCODED)


def _fill(capacity: int):
    def fill(group: pa.Table) -> pa.Table:
        """One group: open sequences take ids from the filler documents, in order; the rest is packed full."""
        grp = group["grp"][0].as_py()
        rows = group.drop_columns(["ids"]).to_pylist()
        held = group["ids"]
        open_ = sorted((r["sequence_id"], r["used"]) for r in rows if r["sequence_id"] is not None)
        docs = sorted((r["part"], r["local"], k) for k, r in enumerate(rows) if r["sequence_id"] is None)
        left = sum(rows[k]["doc_tokens"] for _, _, k in docs)
        out: list[tuple] = []
        state = [0, 0]  # document, its ids used so far

        def take(sequence: int, offset: int, room: int) -> int:
            while room and state[0] < len(docs):
                k = docs[state[0]][2]
                n, at = rows[k]["doc_tokens"], state[1]
                size = min(room, n - at)
                crc = zlib.crc32(memoryview(held[k].as_buffer())[4 * at : 4 * (at + size)])
                out.append((rows[k]["doc_id"], at, size, crc, n, sequence, offset))
                offset, room = offset + size, room - size
                state[:] = [state[0] + 1, 0] if at + size == n else [state[0], at + size]
            return room

        for sequence, used in open_:
            left -= capacity - used - take(sequence, used, capacity - used)
        sequence = _GROUP_BASE * (grp + 1)
        while left:
            size = capacity if left >= capacity else 1 << (left.bit_length() - 1)
            left -= size - take(sequence, 0, size)
            sequence += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names=names)

    return fill


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, filler_every: int = FILLER_EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` that hold each id once."""
    spark = docs.sparkSession
    encoded = store(encode_pieces(docs, tokenizer, end_id, capacity, filler_every, id_col, text_col), "encoded")
    items = encoded.where(F.col("kind") == ITEM)
    histogram = {r["cls"]: r["n"] for r in items.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}  # 144 rows at most
    plan, sequences = cutting_plan(histogram, length_classes(capacity), capacity)

    counts = items.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranges = spark.createDataFrame(plan, "p_cls int, lo long, hi long, first_sequence long, per long")
    ranked = items.join(offsets, ["cls", "part"]).withColumn("rank", F.col("first") + F.col("local"))
    on = (F.col("cls") == F.col("p_cls")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(ranges), on).withColumn("sequence_id", F.expr("first_sequence + (rank - lo) div per"))  # a few thousand ranges at most
    within = Window.partitionBy("sequence_id").orderBy("cls", "rank").rowsBetween(Window.unboundedPreceding, -1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    placed = store(placed.select(*names, F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset")), "placed")

    filler = encoded.where(F.col("kind") == FILLER)
    filler_ids = filler.agg(F.sum("doc_tokens")).first()[0] or 0
    groups = 1 + max(sequences // SEQUENCES_IN_GROUP, filler_ids // (capacity * SEQUENCES_IN_GROUP))
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < capacity)
    nothing = F.lit(None)
    rows = used.select(
        F.pmod("sequence_id", F.lit(groups)).alias("grp"), "sequence_id", "used",
        nothing.cast("long").alias("doc_id"), nothing.cast("long").alias("doc_tokens"), nothing.cast("int").alias("part"), nothing.cast("long").alias("local"), nothing.cast("binary").alias("ids"),
    ).unionByName(filler.select(
        F.pmod(F.xxhash64("part", "local"), F.lit(groups)).alias("grp"), nothing.cast("long").alias("sequence_id"), nothing.cast("long").alias("used"), "doc_id", "doc_tokens", "part", "local", "ids",
    ))
    filled = rows.groupBy("grp").applyInArrow(_fill(capacity), PIECES)
    whole = encoded.where(F.col("kind") == FULL).select(*names, F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(placed).unionByName(filled)


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer or default_path("word_bpe_49k.json"))
