"""Line dedup by a deletion-neighbourhood join.

A line repeats another if both are equal, or if both have at least ``MIN_NEAR`` characters and one edit
(one character put in, left out or replaced) turns one into the other.  Of lines that repeat, the earliest
occurrence, by document id and then by place, is kept; an occurrence goes if an earlier one equals it or
is one edit away.  Lines are compared after trimming blanks; empty lines always stay.

Two lines within one edit share a variant with at most one character deleted.  Emitting every variant of
every line would multiply the text by its line length, so cheaper variants of the same kind come first:
a line with a *block* of a half, then of a sixteenth, deleted.  Lines one edit apart agree outside the
block that holds the edit, so a line whose block variants nobody shares has no partner and goes no
further.  Lines that are left emit all character variants, hashed:

* a replaced character: both lines, of one length, share ``(variant, position)``;
* a character put in: the shorter line equals a variant of the longer.

Each line takes the earliest owner of each variant by aggregation, never by listing pairs, so a variant
that very many lines share costs one row for each line; the edit distance to that owner is then verified.

Hashes are made where the texts are read, in Arrow batches; only hashes of lines are shuffled, and the text
of those few lines that share block variants.

Defined results: a null text counts as empty, has no lines and stays null; null ids come last; rows that
repeat an id share one place in the order, so a line that only they have stays in each; an empty table
gives an empty result; very long texts count whole; other columns are kept, but for those with the names of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import KeyFilter, bits_of, columns_of, store, table, whole_rows
from tidemark.llm.tokens import slices
from tidemark.session import ship_package

MIN_NEAR = 24
BLOCKS = 16
LAST = (1 << 63) - 1  # the place of a null id


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def block_variants(line: str, blocks: int) -> list[int]:
    """The line without each of its blocks, hashed: for its own length and, as the longer of a pair, for one less."""
    out, size = [], len(line)
    for m in (size, size - 1):
        for j in range(blocks):
            lo, hi = j * m // blocks, (j + 1) * m // blocks
            rest = f"{m} {j} {line[:lo]}\0{line[hi + size - m:]}"
            out.append(xxhash.xxh3_64_intdigest(rest.encode()) - (1 << 63))
    return out


def first_lines(text: str) -> dict[str, int]:
    """Each line that is not empty, trimmed, with its first place."""
    out: dict[str, int] = {}
    for n, raw in enumerate(text.split("\n")):
        if line := raw.strip(" "):
            out.setdefault(line, n)
    return out


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    return docs.select(place.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))


def _occurrences(min_near: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "body"):
                ids, keys, halves = [], [], []
                for doc, text in zip(some["id"].to_pylist(), some["body"].to_pylist(), strict=True):
                    for line in first_lines(text):
                        ids.append(doc)
                        keys.append(line_key(line))
                        halves.append(block_variants(line, 2) if len(line) >= min_near else [])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array([short_key(k) for k in keys], pa.int64()), pa.array(halves, pa.list_(pa.int64()))], names=["id", "key", "k", "halves"])

    return build


def _shared(variants: DataFrame) -> DataFrame:
    """Rows of ``variants (k, i, v)`` whose variant belongs to another line too."""
    shared = store(variants.groupBy("v").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select("v"), "variants")
    return KeyFilter(shared, "v").keep(variants, F.col("v")).join(shared, "v", "left_semi")


def _texts(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(k, key, first, line)`` of the lines in ``wanted (k)``."""
    bits = bits_of(wanted, "k")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "body"):
                rows = []
                for doc, text in zip(some["id"].to_pylist(), some["body"].to_pylist(), strict=True):
                    rows += [(short_key(key), key, doc, n, line) for line, n in first_lines(text).items() if bits.holds(short_key(key := line_key(line)))]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["k", "key", "id", "n", "line"])

    found = bodies.mapInArrow(build, "k long, key binary, id long, n int, line string").join(wanted, "k", "left_semi")
    # copies of a line combine in each task, so a very common line moves as few rows
    return found.groupBy("key").agg(F.min("k").alias("k"), F.min(F.struct("id", "n")).alias("first"), F.min("line").alias("line"))


def _build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "line", 1 << 20):
            rows = [block_variants(line, BLOCKS) for line in some["line"].to_pylist()]
            yield pa.RecordBatch.from_arrays([some["k"], pa.array(rows, pa.list_(pa.int64()))], names=["k", "vs"])


def char_variants(line: str, shared: list[int]) -> list[tuple[int, int]]:
    """Hashed variants with one character deleted, from the blocks that the line shares with another.

    Roles: 0 for a variant at its place (a replaced character), 1 for a variant as the shorter line of a
    pair, 2 for the line itself as that shorter line.
    """
    size, places = len(line), set()
    for i in shared:
        m, j = size - i // BLOCKS, i % BLOCKS
        lo, hi = j * m // BLOCKS, (j + 1) * m // BLOCKS + size - m
        places.update(range(lo, min(hi + 1, size)))

    def hashed(text: str) -> int:
        return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)

    out = {(2, hashed(f"={line}"))}
    for p in places:
        rest = line[:p] + line[p + 1 :]
        out |= {(0, hashed(f"{p}:{rest}")), (1, hashed(f"={rest}"))}
    return sorted(out)


def _build_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in (part for batch in batches for part in slices(batch, "line", 1 << 14)):
        ks, ids, ns, roles, hs = [], [], [], [], []
        for k, doc, n, line, shared in zip(some["k"].to_pylist(), some["id"].to_pylist(), some["n"].to_pylist(), some["line"].to_pylist(), some["shared"].to_pylist(), strict=True):
            found = char_variants(line, shared)
            ks += [k] * len(found)
            ids += [doc] * len(found)
            ns += [n] * len(found)
            roles += [role for role, _ in found]
            hs += [h for _, h in found]
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.array(roles, pa.int32()), pa.array(hs, pa.int64())], names=["k", "id", "n", "role", "h"])


def _late(lines: DataFrame) -> DataFrame:
    """Keys of lines with an earlier line one edit away; each takes the earliest owner of each variant."""
    rows = lines.select("k", "first.id", "first.n", "line", "shared").mapInArrow(_build_chars, "k long, id long, n int, role int, h long")
    rows = store(rows, "chars")
    owner = F.struct("id", "n", "k")
    best = rows.groupBy("h").agg(*[F.min(F.when(F.col("role") == r, owner)).alias(f"own{r}") for r in range(3)], F.min("k").alias("low"), F.max("k").alias("high"))
    best = store(best.where("low <> high").drop("low", "high"), "owners")
    met = KeyFilter(best, "h").keep(rows, F.col("h")).join(best.hint("merge"), "h")
    met = met.withColumn("own", F.when(F.col("role") == 0, F.col("own0")).when(F.col("role") == 1, F.col("own2")).otherwise(F.col("own1")))
    pairs = store(met.where(F.col("own") < F.struct("id", "n", "k")).where("own.k <> k").select("k", F.col("own.k").alias("o")).distinct(), "pairs")
    mine, other = lines.select("k", "key", "line"), lines.select(F.col("k").alias("o"), F.col("line").alias("own_line"))
    both = pairs.join(mine.hint("merge"), "k").join(other.hint("merge"), "o")
    return both.where(F.levenshtein("line", "own_line", 1) >= 0).select("key").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near: int = MIN_NEAR) -> DataFrame:
    """``(id, key, near)``: lines that go from a document because of earlier ones elsewhere."""
    bodies = _bodies(docs, id_col, text_col)
    found = store(bodies.mapInArrow(_occurrences(min_near), "id long, key binary, k long, halves array<long>"), "occurrences")
    again = store(found.groupBy("key").agg(F.min("id").alias("own"), F.max("id").alias("last")).where("own <> last").select("key", "own"), "again")
    exact = found.select("id", "key").join(again.hint("merge"), "key").where("id <> own").select("id", "key", F.lit(False).alias("near"))

    close = store(_shared(found.select("k", F.explode("halves").alias("v"))).select("k").distinct(), "close")
    lines = store(_texts(bodies, close), "lines")
    blocks = store(lines.select("k", "line").mapInArrow(_build_blocks, "k long, vs array<long>"), "blocks")
    closer = _shared(blocks.select("k", F.posexplode("vs").alias("i", "v"))).groupBy("k").agg(F.collect_set("i").alias("shared"))  # 32 at most
    lines = store(lines.join(closer, "k"), "lines")
    late = store(_late(lines), "late")
    near = found.select("id", "key").join(late.hint("merge"), "key").select("id", "key", F.lit(True).alias("near"))
    return exact.unionByName(near)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "body"):
            texts, exact, near = [], [], []
            for text, gone, gone_near in zip(pc.fill_null(some["body"], "").to_pylist(), some["gone"].to_pylist(), some["late"].to_pylist(), strict=True):
                gone, gone_near, seen, kept, n_exact, n_near = set(gone or ()), set(gone_near or ()), set(), [], 0, 0
                for raw in text.split("\n"):
                    line = raw.strip(" ")
                    if line and line in seen:
                        n_exact += 1
                        continue
                    if line:
                        seen.add(line)
                        if gone or gone_near:
                            key = line_key(line)
                            if key in gone:
                                n_exact += 1
                                continue
                            if key in gone_near:
                                n_near += 1
                                continue
                    kept.append(raw)
                texts.append("\n".join(kept) if n_exact + n_near else text)
                exact.append(n_exact)
                near.append(n_near)
            texts = pc.if_else(pc.is_null(some["body"]), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([some["row"], some["body"], texts, pa.array(exact, pa.int64()), pa.array(near, pa.int64())], names=["row", "body", "text", "exact", "near"])


def _deduped(docs: DataFrame, id_col: str, text_col: str, min_near: int) -> DataFrame:
    """``(row, body, text, exact, near)``: the input's rows with the text without repeated lines and the numbers of those."""
    ship_package(docs.sparkSession)
    gone = repeated_lines(docs, id_col, text_col, min_near)
    gone = gone.groupBy("id").agg(F.collect_set(F.when(~F.col("near"), F.col("key"))).alias("gone"), F.collect_set(F.when(F.col("near"), F.col("key"))).alias("late"))
    gone = store(gone, "gone")  # a row for each document with repeated lines, no longer than its lines
    none = F.lit(None).cast("array<binary>")
    rows, touched = whole_rows(docs, text_col).withColumn("id", F.coalesce(F.col("row")[id_col].cast("long"), F.lit(LAST))), KeyFilter(gone, "id")
    same = touched.drop(rows, F.col("id")).select("row", "body", none.alias("gone"), none.alias("late"))
    other = touched.keep(rows, F.col("id")).join(gone, "id", "left").select("row", "body", "gone", "late")
    fields = T.StructType([rows.schema["row"], rows.schema["body"], T.StructField("text", T.StringType()), T.StructField("exact", T.LongType()), T.StructField("near", T.LongType())])
    return same.unionByName(other).mapInArrow(_without, fields)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near: int = MIN_NEAR) -> DataFrame:
    """The input with ``ld_text``, the text without repeated lines, and ``ld_exact`` and ``ld_near``, their numbers."""
    results = {"ld_text": "text", "ld_exact": "exact", "ld_near": "near"}
    out = _deduped(docs, id_col, text_col, min_near)
    return out.select(*columns_of(docs, text_col, tuple(results)), *[F.col(c).alias(name) for name, c in results.items()])


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with repeated lines taken out; a document that loses all its lines goes.  All columns stay."""
    out = _deduped(docs, id_col, text_col, MIN_NEAR)
    emptied = (F.col("exact") + F.col("near") > 0) & (F.trim(F.regexp_replace("text", r"\s+", "")) == "")
    return out.where(~emptied).select(*columns_of(docs, text_col, text="text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.col("ld_exact").alias("n_exact"), F.col("ld_near").alias("n_near"), F.sha2(F.coalesce("ld_text", F.lit("")), 256).alias("text_sha256"),
    )


ORACLE = """
with d as (select doc_id, coalesce(text, '') as body from documents),
s as (select doc_id, string_split(body, chr(10)) as parts from d),
o as (select doc_id, unnest(parts) as raw, unnest(range(len(parts))) as n from s),
l as (select doc_id, n, raw, trim(raw, ' ') as line from o),
f as (select line, min(doc_id * 10000000 + n) as first, length(line) as size from l where line <> '' group by line),
e as (
    select distinct b.line from f a join f b
    on a.first < b.first and abs(a.size - b.size) <= 1 and a.size >= 24 and b.size >= 24
    and (a.line[1:b.size // 2] = b.line[1:b.size // 2] or a.line[-(b.size // 2 - 1):] = b.line[-(b.size // 2 - 1):])
    and levenshtein(a.line, b.line) <= 1
),
m as (
    select l.doc_id, l.n, l.raw, l.line <> '' and l.doc_id * 10000000 + l.n <> f.first as exact,
        coalesce(l.doc_id * 10000000 + l.n = f.first, false) and l.line in (select line from e) as near
    from l left join f on f.line = l.line
)
select doc_id, count(*) as n_lines, count(*) filter (exact) as n_exact, count(*) filter (near) as n_near,
    sha256(coalesce(string_agg(raw, chr(10) order by n) filter (not exact and not near), '')) as text_sha256
from m group by doc_id
"""
