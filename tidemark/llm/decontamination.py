"""Benchmark decontamination by template canonicalisation.

Words are reduced to templates: edge marks and case go, numbers, written in digits or words, become a number
slot, units a unit slot, and capitalised words a name slot, except for common words that open a sentence.  Numbers
or names in a row are one slot.  Every window of ``WINDOW`` template words of a benchmark item is hashed; windows
of every whole document are looked up in that table.  Hits are grouped by
item and alignment, compared word for word, and kept only if their slots are consistent: within an
alignment each slot value of the item stands for one value in the document and the other way round.  So a
question with other numbers and names is found, and text that fills the same template at random is not.
Slot values are compared without case.  Windows with fewer than ``LEAST_FIXED`` words outside slots say too
little as templates; they are looked up word for word, and count if their words are equal but for case.  A copy
of a whole item, word for word but for case, always counts: names are not to be told in a text without capitals.

A document is contaminated by an item if matched windows cover at least ``COVERAGE`` of the item's words.

The benchmark is read in blocks of about ``BLOCK_BYTES`` of text, each matched against all documents; the result
of a block is written before the next one is read, so one plan, and one worker, never holds two blocks.

Defined results: a null text counts as empty and is clean; items shorter than a window are matched whole, those
with fewer than ``LEAST_FIXED`` words outside slots word for word; items without words match nothing; a null
item id is skipped; rows that repeat an id are judged one by one; very long texts are read whole; ties between
items go to the smallest id; an empty table or benchmark gives no contamination; other columns are kept, but for
those with the names of results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import columns_of, drop_stored, store, table, whole_rows
from tidemark.llm.tokens import slices

WINDOW, LEAST_FIXED, COVERAGE = 8, 4, 0.5
BLOCK_BYTES = 1 << 25
SEEN_BITS = 20  # of a window's hash, for a first look that nearly all windows do not pass
NUMBER, UNIT, NAME, NOTHING = 1, 2, 3, 0
#: Fixed word list.
UNITS = frozenset("kg g mg lb lbs oz km m cm mm mi mile miles meter meters metre metres ft feet inch inches l ml liter liters litre litres gallon gallons h hr hrs hour hours min minute minutes s sec second seconds day days week weeks month months year years usd eur gbp dollar dollars euro euros pound pounds cent cents percent % mph kmh kph c f k hz w kw v a".split())
#: Fixed word list.
NUMBERS = frozenset("zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
#: Fixed word list: words that open a sentence and are no names.
OPENERS = frozenset("a about after all also an and any are as at because before both but by calculate can choose compute consider could determine did do does each every explain find for from given has have he her here his how however i if in into is it its let many more most my no not now of on one only or other our over prove she should show since so solve some state such suppose than that the their them then there these they this those through to under until up use was we were what when where which while who whose why will with would write you your".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?(?:st|nd|rd|th)?")
_EDGE = " \t\r\n.,;:!?\"'()[]{}<>|*#&@_=+/\\~`^$%-"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Templates:
    """Words to template codes, remembered within a worker."""

    def __init__(self, most: int = 100_000):
        self.known: dict[str, tuple[int, int, bool, int]] = {}
        self.most = most

    def code(self, word: str) -> tuple[int, int, bool, int]:
        """``(code, flags, ends a sentence, verbatim code)``; flags: 1 for a capitalised word, 2 for one that often opens a sentence."""
        found = self.known.get(word)
        if found is None:
            core = word.strip(_EDGE)
            exact = xxhash.xxh64_intdigest(core.lower()) | 4
            parts = core.lower().split("-")
            if _NUMBER.fullmatch(core) or all(p in NUMBERS or p == "one" and len(parts) > 1 for p in parts):
                code = NUMBER
            elif core.lower() in UNITS:
                code = UNIT
            else:
                code = exact if core else NOTHING
            capital = len(core) > 1 and core[0].isupper() and core[1:].islower()
            found = self.known[word] = code, int(capital) + 2 * int(capital and core.lower() in OPENERS), word.rstrip("\"')]}*#&$%@").endswith((".", "!", "?", ":")), exact
        return found

    def sequences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """``(codes, word numbers, starts, words, verbatim codes)`` of a batch; ``starts`` has one entry more than texts."""
        if len(self.known) > self.most:
            self.known.clear()
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        read = [self.code(w) for w in distinct]
        code = np.array([r[0] for r in read], np.uint64)
        capital, common = np.array([r[1] & 1 for r in read], bool), np.array([r[1] & 2 for r in read], bool)
        ends = np.array([r[2] for r in read], bool)
        codes = code[index]
        held = codes != NOTHING
        before = np.cumsum(held)
        starts = np.concatenate([[0], before])[offsets]
        codes, index = codes[held], index[held]
        opens = np.ones(len(codes), bool)
        opens[1:] = ends[index[:-1]]
        opens[starts[:-1][starts[:-1] < len(codes)]] = True
        codes = np.where(capital[index] & ~(opens & common[index]) & (codes > 3), np.uint64(NAME), codes)
        return codes, index, starts, distinct, np.array([r[3] for r in read], np.uint64)[index]


def joined(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(places, starts)`` of the sequences in which numbers in a row, or names, are one slot: the place of each one's first word."""
    follows = np.zeros(len(codes), bool)
    follows[1:] = (codes[1:] == codes[:-1]) & ((codes[1:] == NUMBER) | (codes[1:] == NAME))
    follows[starts[:-1][starts[:-1] < len(codes)]] = False
    before = np.concatenate([[0], np.cumsum(~follows)])
    return np.flatnonzero(~follows), before[starts]


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = codes ^ (codes >> np.uint64(29))
    out = mixed[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, size):
            out *= _MULTIPLIER
            out += mixed[j : j + n]
    return out


def _fixed(codes: np.ndarray, size: int) -> np.ndarray:
    """Words that are no slots in each run of ``size`` codes."""
    return np.convolve(codes > 3, np.ones(size, int), "valid")


class Item:
    """The words of an item: their verbatim codes, and its template with each place's first word and value."""

    def __init__(self, number: int, codes: np.ndarray, words: list[str], exact: np.ndarray):
        self.number, self.exact, self.size = number, exact, len(codes)
        at, _ = joined(codes, np.array([0, len(codes)]))
        self.codes, self.first = codes[at], np.append(at, len(codes)).tolist()
        self.values = [" ".join(words[lo:hi]) for lo, hi in zip(self.first, self.first[1:], strict=False)]


class Benchmark:
    """The window tables of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [Item(*read) for read in self._read(items) if len(read[1])]
        self.by_size = self._tables(lambda x: x.codes, lambda x, size: _fixed(x.codes, size) >= LEAST_FIXED)
        #: All windows word for word; those of few fixed words count by themselves.
        self.exact_by_size = self._tables(lambda x: x.exact, lambda x, size: np.ones(x.size - size + 1, bool))
        self.weak = [self._weak(x) for x in self.items]

    @staticmethod
    def _weak(item: Item) -> set[int]:
        """Places whose windows of the template have few fixed words: all words under them are compared verbatim."""
        size = min(WINDOW, len(item.codes))
        words = {w for at in np.flatnonzero(_fixed(item.codes, size) < LEAST_FIXED).tolist() for w in range(item.first[at], item.first[at + size])}
        span = min(WINDOW, item.size)
        return {at for at in range(item.size - span + 1) if all(at + j in words for j in range(span))}

    def _tables(self, sequence: Callable[[Item], np.ndarray], wanted: Callable[[Item, int], np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]]:
        tables: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, item in enumerate(self.items):
            size = min(WINDOW, len(sequence(item)))
            hashes = window_hashes(sequence(item), size)
            for at in np.flatnonzero(wanted(item, size)).tolist():
                tables[size][int(hashes[at])].append((k, at))
        out = {}
        for size, held in tables.items():
            known = np.array(sorted(held), np.uint64)
            seen = np.zeros(1 << SEEN_BITS, bool)
            seen[known >> np.uint64(64 - SEEN_BITS)] = True
            out[size] = known, seen, dict(held)
        return out

    @staticmethod
    def _read(items: list[tuple[int, str]]) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray]]:
        templates = Templates()
        codes, index, starts, words, exact = templates.sequences(pa.array([text for _, text in items], pa.string()))
        for k, (item, _) in enumerate(items):
            lo, hi = int(starts[k]), int(starts[k + 1])
            yield item, codes[lo:hi], [words[i].strip(_EDGE).lower() for i in index[lo:hi].tolist()], exact[lo:hi]

    @staticmethod
    def _hits(tables: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]], codes: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int, int], list[int]]:
        """Places in the item by ``(text, item, alignment)``."""
        hits: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for size, (known, seen, held) in tables.items():
            hashes = window_hashes(codes, size)
            if not len(hashes):
                continue
            at = np.flatnonzero(seen[hashes >> np.uint64(64 - SEEN_BITS)])
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            at = at[known[place] == hashes[at]]
            text = np.searchsorted(starts, at, side="right") - 1
            inside = at + size <= starts[text + 1]
            for t, p in zip(text[inside].tolist(), at[inside].tolist(), strict=True):
                for item, q in held[int(hashes[p])]:
                    hits[t, item, p - q].append(q)
        return hits

    def matches(self, templates: Templates, texts: pa.Array) -> dict[int, list[tuple[int, float, bool]]]:
        """For each text with matches: ``(item, coverage, re-parameterised)``."""
        codes, index, starts, words, exact = templates.sequences(texts)
        at, begins = joined(codes, starts)
        covered: dict[tuple[int, int], tuple[set[int], bool]] = {}

        def value(place: int) -> str:
            """What stands in a slot of the texts."""
            end = at[place + 1] if place + 1 < len(at) else len(codes)
            end = min(end, starts[np.searchsorted(starts, at[place], side="right")])
            return " ".join(words[i].strip(_EDGE).lower() for i in index[at[place] : end].tolist())

        for (t, k, shift), places in self._hits(self.by_size, codes[at], begins).items():
            item = self.items[k]
            size = min(WINDOW, len(item.codes))
            cells = sorted({q + j for q in places for j in range(size)})
            if not all(codes[at[c + shift]] == item.codes[c] for c in cells):  # two templates under one hash
                continue
            there = {c: value(c + shift) for c in cells if item.codes[c] <= 3}
            forth, back = {}, {}
            if not all(forth.setdefault((item.codes[c], item.values[c]), v) == v and back.setdefault((item.codes[c], v), item.values[c]) == item.values[c] for c, v in there.items()):
                continue
            changed = any(v != item.values[c] for c, v in there.items())
            seen, other = covered.get((t, k), (set(), False))
            covered[t, k] = seen | {w for c in cells for w in range(item.first[c], item.first[c + 1])}, other or changed
        for (t, k, shift), places in self._hits(self.exact_by_size, exact, starts).items():
            item = self.items[k]
            size = min(WINDOW, item.size)
            whole = len({q + j for q in places for j in range(size)}) == item.size
            cells = {q + j for q in places if whole or q in self.weak[k] for j in range(size)}
            if cells and all(exact[c + shift] == item.exact[c] for c in cells):
                seen, other = covered.get((t, k), (set(), False))
                covered[t, k] = seen | cells, other
        out: dict[int, list[tuple[int, float, bool]]] = defaultdict(list)
        for (t, k), (cells, changed) in covered.items():
            out[t].append((self.items[k].number, len(cells) / self.items[k].size, changed))
        return out


def _judged(rows: DataFrame, benchmark: DataFrame, item_col: str, coverage: float) -> DataFrame:
    """``rows (row, body)`` with ``items, item, coverage, changed``.  Each block of the benchmark but the last ends in a written table."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body")).where("item is not null")
    n_bytes = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = 1 + n_bytes // BLOCK_BYTES
    extra = [T.StructField("items", T.ArrayType(T.LongType())), T.StructField("item", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("changed", T.BooleanType())]
    none = [F.array().cast("array<bigint>"), F.lit(None).cast("bigint"), F.lit(0.0), F.lit(False)]
    out = rows.select("row", "body", *[c.alias(f.name) for c, f in zip(none, extra, strict=True)])
    fields = T.StructType([rows.schema["row"], rows.schema["body"], *extra])
    for block in range(blocks):
        held = sorted((r["item"], r["body"]) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect())  # one block, bounded
        before = out
        out = before.mapInArrow(_matcher(held, coverage), fields)
        if block < blocks - 1:  # so that a plan, and a worker, holds one block only
            out = store(out, "judged")
        if block > 0 and block < blocks - 1:
            drop_stored(before)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with ``dc_items array<bigint>``, ``dc_item bigint``, ``dc_coverage double`` and ``dc_changed boolean``.

    ``dc_items`` lists the items that contaminate the row; the others describe the best match, if any.  They
    replace columns of these names.
    """
    results = ("items", "item", "coverage", "changed")
    out = _judged(whole_rows(docs, text_col), benchmark, item_col, coverage)
    return out.select(*columns_of(docs, text_col, tuple(f"dc_{r}" for r in results)), *[F.col(r).alias(f"dc_{r}") for r in results])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """The input without the rows that a benchmark item contaminates; all columns stay."""
    return _judged(whole_rows(docs, text_col), benchmark, item_col, coverage).where(F.size("items") == 0).select(*columns_of(docs, text_col))


def _matcher(held: list[tuple[int, str]], coverage: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, templates = Benchmark(held), Templates()
        for batch in batches:
            for some in slices(batch, "body", 1 << 21):
                found = index.matches(templates, pc.fill_null(some["body"], ""))
                columns = [some[c].to_pylist() for c in ("items", "item", "coverage", "changed")]  # of earlier blocks
                for t, matches in found.items():
                    columns[0][t] = sorted({*columns[0][t], *(item for item, share, _ in matches if share >= coverage)})
                    item, share, changed = min(matches, key=lambda m: (-m[1], m[0]))
                    if (-share, item) < (-columns[2][t], columns[1][t] if columns[1][t] is not None else 1 << 63):
                        columns[1][t], columns[2][t], columns[3][t] = item, share, changed
                arrays = [pa.array(columns[0], pa.list_(pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.bool_())]
                yield pa.RecordBatch.from_arrays([some["row"], some["body"], *arrays], names=["row", "body", "items", "item", "coverage", "changed"])

    return match


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", (F.size("dc_items") > 0).alias("contaminated"), F.array_join(F.transform("dc_items", lambda i: i.cast("string")), ",").alias("item_ids"), F.col("dc_item").alias("best_item"), F.round("dc_coverage", 6).alias("coverage"), F.col("dc_changed").alias("slots_changed"))
