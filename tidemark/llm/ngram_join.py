"""N-gram Jaccard join by token-combination prefixes.

Documents link when their sets of five-word shingles have a Jaccard similarity of at least 75/100.  Equal
sets are one node, named by a 64-bit hash of the set.  The result names each document's component.

*Tokens and prefixes.*  A shingle is a 64-bit token.  A node indexes the smallest tokens of its set, its extended
prefix: the plain prefix ``n - ceil(0.75 n) + 1``, a sixteenth of the set and twelve tokens, ``SHORT`` at least.
Within their extended prefixes two linked sets share ``needed(n)`` tokens.  Tokens that one node holds are
dropped; so are nodes with fewer than ``needed`` tokens left, which leaves further tokens with one node only, and
so on while it pays.  What stays is ordered rarest first, so frequent tokens leave the prefixes: two linked nodes
share a token among the first ``size - needed + 1`` of both, and ``k`` tokens among the first ``size - needed + k``.

*Classes.*  The first common token of a pair decides under which key it meets:

1. a rare token, held by at most ``RARE`` nodes, is a key by itself;
2. a frequent token is a key together with a second one that follows it within the longer prefix (``k = 2``);
3. where more than ``COMBINE`` tokens follow it on average, as within a family of near copies, whose members
   share most combinations, it is a key by itself.

Each entry carries the ``BEFORE`` tokens in front of its key's tokens.  If two entries have one of those in
common, then the pair has an earlier common token and meets there, so a pair is listed about once and not once
for each common token or combination.  Entries of frequent tokens also carry ``64 * WORDS_OF_BITS`` parity bits of
the whole set: two sets differ in as many tokens as bits, at least, so the join itself leaves out most pairs of a
family that are not similar enough, and its output does not grow with the square of the family.

*Verification* goes in two steps: a bound from 16-bit values of all tokens of both sets, which is never below
the true intersection, and the whole 64-bit tokens for the pairs that the bound lets through.

*Stars first.*  Before that, each node is compared with one node for its shared tokens, in a few rounds,
and what links is merged.  A token that only one component holds can give no new link and is dropped, so a
group of thousands of near copies costs a few rows for each copy and its pairs are never listed.

Defined results: a null text counts as empty; a text without words has an empty set, links with nothing and
is its own component; a text with fewer than five words has its whole sequence as its one shingle; very long
texts count whole; rows that repeat an id or a text are linked like any others and a component is named by its
smallest id (nulls last), so ties need no order; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import KeyFilter, drop_stored, fresh, release, store, table
from tidemark.llm.components import components
from tidemark.llm.tokens import slices
from tidemark.session import ship_package

WORDS = 5
THRESHOLD, SCALE = 75, 100
RARE = 32
SHORT = 128
EXTRA = 16  # an extended prefix has a sixteenth of the set more, and twelve tokens
STAR_ROUNDS = 2
COMBINE = 8
WORDS_OF_BITS = 16
BEFORE = 4
ENTRIES = 1 << 17  # tokens of profiles that a worker expands at a time
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SETS = "doc_id long, tie long, node long, n int, ext array<long>"


def prefix_length(n: int) -> int:
    return n - -(-THRESHOLD * n // SCALE) + 1 if n else 0


def extended_length(n: int) -> int:
    return min(n, max(SHORT, prefix_length(n) + n // EXTRA + 12))


@functools.lru_cache(maxsize=1 << 16)
def needed(n: int) -> int:
    """Tokens that the extended prefixes of a set of ``n`` and of any set linked to it share, at least."""
    low, high = -(-THRESHOLD * n // SCALE), SCALE * n // THRESHOLD
    if not n:
        return 0

    def rest(m: int) -> int:
        return m - extended_length(m)

    # the set whose extended prefix ends at the smaller token bounds what may be shared beyond it
    least = min(-(-THRESHOLD * (n + m) // (SCALE + THRESHOLD)) - rest(m) for m in range(low, high + 1))
    own = -(-THRESHOLD * (n + low) // (SCALE + THRESHOLD)) - rest(n)
    return max(1, min(least, own))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct tokens of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.dictionary_encode()
    index, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    code = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)
    held = np.array([w != "" for w in distinct], bool)[index] if len(index) else np.zeros(0, bool)
    starts = np.concatenate([[0], np.cumsum(held)])[offsets]
    code = code[index[held]] if len(index) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(code) - WORDS + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WORDS):
            rolled = rolled * _MULTIPLIER + code[j : j + len(rolled)]
    rolled = _mix(rolled).view(np.int64)
    out = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if hi - lo >= WORDS:
            out.append(np.unique(rolled[lo : hi - WORDS + 1]))
        elif hi > lo:
            out.append(np.array([xxhash.xxh64_intdigest(code[lo:hi].tobytes(), seed=1)], np.uint64).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_name(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("tie"), body.alias("body"))


def _build_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "body", 1 << 20):
            sets = shingle_sets(some["body"])
            sizes = [len(s) for s in sets]
            ext = [s[: extended_length(len(s))] for s in sets]
            bounds = np.concatenate([[0], np.cumsum([len(e) for e in ext])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [some["doc_id"], some["tie"], pa.array([set_name(s) for s in sets], pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ext)))],
                names=["doc_id", "tie", "node", "n", "ext"],
            )


def _build_full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets: sorted 64-bit tokens."""
    for batch in batches:
        for some in slices(batch, "body", 1 << 20):
            sets = shingle_sets(some["body"])
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])


def parity_bits(tokens: np.ndarray) -> bytes:
    """For each value of some bits of a token, whether an odd number of tokens has it."""
    places = 64 * WORDS_OF_BITS
    return np.packbits(np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (places - 1), minlength=places) & 1).tobytes()


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low 16 bits of each token, sorted; equal ones stay.  And parity bits."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch["tokens"]]
        low = [np.sort(s.astype(np.uint16)).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(low, pa.binary()), pa.array([parity_bits(s) for s in sets], pa.binary())], names=["node", "tokens", "bits"])


def common_at_most(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted lists in which a value may repeat."""
    both = np.concatenate([x, y])
    side = np.concatenate([np.zeros(len(x), np.int8), np.ones(len(y), np.int8)])
    order = np.argsort(both, kind="stable")
    both, side = both[order], side[order]
    starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    if not len(starts):
        return 0
    ones = np.add.reduceat(side, starts, dtype=np.int64)
    return int(np.minimum(ones, np.diff(np.append(starts, len(both))) - ones).sum())


def _compare(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose lists, of numbers of this kind, are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                both = common_at_most(x, y)
                if SCALE * both >= THRESHOLD * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return compare


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tokens that several nodes hold, with what the node's size needs; reads sorted rows as a stream."""
    token: int | None = None  # of the row before
    pending: pa.RecordBatch | None = None  # the first row of a group, until a second one comes
    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch["token"].to_numpy()
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        new[0] = token is None or t[0] != token
        shared = ~new
        shared[:-1] |= ~new[1:]
        out = [batch.filter(pa.array(shared))]
        if pending is not None and not new[0]:
            out.insert(0, pending)
        # not known yet whether others follow the last row
        pending = batch.slice(len(t) - 1) if new[-1] else None
        token = int(t[-1])
        for part in out:
            sizes, which = np.unique(part["n"].to_numpy(), return_inverse=True)
            need = np.array([needed(n) for n in sizes.tolist()], np.int32)[which]
            yield pa.RecordBatch.from_arrays([part["token"], part["node"], part["n"], pa.array(need, pa.int32())], names=["token", "node", "n", "need"])


def _some_lists(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of profiles of at most ``ENTRIES`` tokens, or of one profile: their tokens, where each one's begin, and the lengths of their prefixes."""
    size = pc.list_value_length(batch["q"]).to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ENTRIES, "right")))
        some = batch.slice(lo, hi - lo)
        starts = np.cumsum(size[lo:hi]) - size[lo:hi]
        yield some, some["q"].flatten().to_numpy(), starts, size[lo:hi] - some["need"].to_numpy() + 1
        lo = hi


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each stretch, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _lists(values: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """For each end, the ``length`` values before it."""
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[_spread(ends - lengths, lengths)], pa.int64()))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of each node's prefix."""
    for batch in batches:
        for some, tokens, starts, into in _some_lists(batch):
            row = np.repeat(np.arange(len(into)), into)
            pos = _spread(np.zeros(len(into), np.int64), into)
            at = starts[row] + pos
            columns = [some[c].take(pa.array(row)) for c in ("node", "n", "comp", "liked")]
            columns += [pa.array(tokens[at], pa.int64()), pa.array(pos, pa.int32()), pa.array(into[row] - pos, pa.int32()), _lists(tokens, at, np.minimum(pos, BEFORE))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "comp", "liked", "token", "pos", "behind", "before"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a node's frequent tokens: one for a ``single`` token, for others one with each token that follows in the longer prefix."""
    words = [f"w{k}" for k in range(WORDS_OF_BITS)]
    for batch in batches:
        for some, tokens, starts, into in _some_lists(batch):
            row = np.repeat(np.arange(len(into)), pc.list_value_length(some["chosen"]).to_numpy().astype(np.int64))
            chosen = some["chosen"].flatten().to_numpy().astype(np.int64)
            pos, single = chosen >> 1, (chosen & 1).astype(bool)
            lengths = np.where(single, 1, into[row] - pos)
            bits = np.frombuffer(b"".join(some["bits"].to_pylist()), np.int64).reshape(-1, WORDS_OF_BITS)
            for lo in range(0, len(row), ENTRIES // 16):
                piece = slice(lo, lo + ENTRIES // 16)
                r, p, k = row[piece], pos[piece], lengths[piece]
                first = np.repeat(np.arange(len(r)), k)
                gap, alone = _spread(np.zeros(len(r), np.int64), k), single[piece][first]
                at = (starts[r] + p)[first]
                second = np.where(alone, at, at + 1 + gap)
                width = np.empty(2 * len(at), np.int64)
                width[0::2], width[1::2] = np.minimum(p[first], BEFORE), np.where(alone, 0, np.minimum(gap, BEFORE))
                place = np.empty(2 * len(at), np.int64)
                place[0::2], place[1::2] = at - width[0::2], second - width[1::2]
                bounds = np.concatenate([[0], np.cumsum(width[0::2] + width[1::2])]).astype(np.int32)
                before = pa.ListArray.from_arrays(pa.array(bounds), pa.array(tokens[_spread(place, width)], pa.int64()))
                columns = [some[c].take(pa.array(r[first])) for c in ("node", "n", "comp")]
                columns += [pa.array(tokens[at], pa.int64()), pa.array(np.where(alone, 0, tokens[second]), pa.int64()), before]
                held = bits[r[first]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(held[:, j]) for j in range(WORDS_OF_BITS)]], names=["node", "n", "comp", "token", "second", "before", *words])


def _size_ok(a: str, b: str) -> Column:
    return (SCALE * F.least(a, b)) >= (THRESHOLD * F.greatest(a, b))


class Join:
    """One run over a table of documents; intermediate tables are in scratch."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        ship_package(docs.sparkSession)
        self.bodies = _bodies(docs, id_col, text_col)
        sets = store(self.bodies.mapInArrow(_build_sets, SETS), "sets")
        self.rows = store(sets.select("doc_id", "tie", "node", "n"), "rows")
        self.nodes = store(self.rows.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "nodes")
        self.again = KeyFilter(self.nodes.where("copies > 1"), "node")
        held = sets.where("n > 1").select("node", "n", "ext")  # sets of one token are equal or have nothing in common
        copies = self.again.keep(held, F.col("node")).groupBy("node", "n").agg(F.first("ext").alias("ext"))
        index = self.again.drop(held, F.col("node")).unionByName(copies).select(F.explode("ext").alias("token"), "node", "n")
        index = index.repartition("token").sortWithinPartitions("token")
        shared = store(index.mapInArrow(_groups, "token long, node long, n int, need int"), "shared")
        drop_stored(sets)
        release(self.bodies.sparkSession)
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        alive = store(shared.groupBy("node").agg(F.count(F.lit(1)).alias("f"), F.first("need").alias("need")).where("f >= need").select("node"), "alive")
        self.profiles = self.narrowed(KeyFilter(alive, "node").keep(shared, F.col("node")))
        drop_stored(shared)
        self.sets = self.whole_sets()
        self.coarse = store(self.sets.mapInArrow(_coarse, "node long, tokens binary, bits binary"), "coarse")
        release(self.bodies.sparkSession)

    def narrowed(self, rows: DataFrame, size: int | None = None) -> DataFrame:
        """``(node, n, need, comp, liked, q)`` of nodes that may link to another component: ``q``, their tokens that two components hold, rarest first.

        ``size``: the number of rows.  Goes on while an eighth of them goes.
        """
        while True:
            rows = self.labelled(rows.select("token", "node", "n", "need"))
            kinds = rows.groupBy("token").agg(F.count(F.lit(1)).alias("times"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
            rows = rows.join(kinds.select("token", "times").hint("merge"), "token")
            lists = rows.groupBy("node", "n", "need", "comp").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("q"), F.sum("times").alias("held"))
            # the node whose tokens most others share is most like all of them: the original of many copies
            lists = lists.where("size(q) >= need").select("node", "n", "need", "comp", (F.col("held") / F.col("n")).alias("liked"), F.col("q.token").alias("q"))
            lists = store(lists, "profiles")
            left = lists.agg(F.sum(F.size("q"))).first()[0] or 0
            if size is None or left * 8 > size * 7 or not left:
                self.size = left
                return lists
            size = left
            rows = self.entries(lists)

    @staticmethod
    def entries(lists: DataFrame) -> DataFrame:
        return lists.select("node", "n", "need", F.explode("q").alias("token"))

    def whole_sets(self) -> DataFrame:
        """``(node, tokens)`` of the profiles' nodes; one document of each is read again."""
        ids = self.nodes.join(self.profiles.select("node"), "node", "left_semi").select("node", F.coalesce("first_id", F.lit(-1)).alias("id"))
        ids = store(ids, "wanted")
        some = KeyFilter(ids, "id").keep(self.bodies, F.coalesce("doc_id", F.lit(-1).cast("long"))).select("body")
        full = store(KeyFilter(ids, "node").keep(some.mapInArrow(_build_full, "node long, tokens binary"), F.col("node")), "full")
        twice = store(full.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("node"), "twice")
        if twice.isEmpty():
            return full
        repeated = KeyFilter(twice, "node")  # rows that repeat an id, or that the filters let through
        one = repeated.keep(full, F.col("node")).groupBy("node").agg(F.first("tokens").alias("tokens"))
        out = store(repeated.drop(full, F.col("node")).unionByName(one), "full")
        drop_stored(full)
        return out

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``(a, b)`` whose whole sets are similar enough."""
        for label, sets, kind in (("likely", self.coarse, np.uint16), ("links", self.sets, np.uint64)):
            left = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")).hint("merge"), "a")
            both = left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")
            pairs = store(both.mapInArrow(_compare(kind), "a long, b long"), label)
        release(self.bodies.sparkSession)
        return pairs

    def add(self, pairs: DataFrame) -> bool:
        """Verify pairs and merge what links; says whether anything did."""
        found = self.verify(pairs)
        if found.isEmpty():
            return False
        self.links = found if self.links is None else self.links.unionByName(found)
        self.labels = store(components(self.links), "labels")
        return True

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``comp``, a node's component so far."""
        if self.labels is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(self.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def prefixes(self) -> DataFrame:
        """A row for each token of the nodes' prefixes; ``before``: the tokens in front, ``behind``: how many follow in the longer prefix."""
        return self.profiles.mapInArrow(_prefixes, "node long, n int, comp long, liked double, token long, pos int, behind int, before array<long>")

    def stars(self) -> None:
        """Rounds in which each node is compared with the node with which most of its tokens lead it."""
        for _ in range(STAR_ROUNDS):
            rows = self.prefixes().select("token", "node", "n", "comp", "liked")
            chosen = rows.groupBy("token").agg(F.max(F.struct("liked", "node", "n", "comp")).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
            led = rows.drop("liked").join(chosen.select("token", "p").hint("merge"), "token").where((F.col("comp") != F.col("p.comp")) & _size_ok("n", "p.n"))
            led = led.groupBy("node", F.col("p.node").alias("pivot")).agg(F.count(F.lit(1)).alias("m"))
            best = led.groupBy("node").agg(F.max(F.struct("m", "pivot")).alias("x"))
            pairs = store(best.select(F.col("node").alias("a"), F.col("x.pivot").alias("b")), "pairs")
            if not self.add(pairs):
                break
            self.profiles = self.narrowed(self.entries(self.profiles), self.size)

    def candidates(self) -> DataFrame:
        """All pairs that could link two components."""
        rows = self.prefixes()
        kinds = rows.groupBy("token").agg(F.count(F.lit(1)).alias("holders"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.avg("behind").alias("behind")).where("low <> high")
        frequent, single = F.col("holders") > RARE, F.col("behind") > COMBINE
        kinds = kinds.select("token", frequent.alias("frequent"), single.alias("single"))
        rows = store(rows.drop("liked", "behind").join(kinds.hint("merge"), "token"), "keys")

        def met(keys: DataFrame, on: list[str], words: list[str]) -> DataFrame:
            x, y = (keys.select(*on, *[F.col(c).alias(f"{c}_{mark}") for c in ("node", "n", "comp", "before", *words)]) for mark in "ab")
            ok = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & _size_ok("n_a", "n_b")
            if words:
                differ = functools.reduce(Column.__add__, [F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words])
                total = F.col("n_a") + F.col("n_b")
                ok &= (SCALE + THRESHOLD) * (total - differ) >= 2 * THRESHOLD * total
            out = x.join(y.hint("merge"), on).where(ok & ~F.arrays_overlap("before_a", "before_b"))
            return out.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

        words = [f"w{k}" for k in range(WORDS_OF_BITS)]
        chosen = rows.where("frequent").groupBy("node").agg(F.collect_list(F.col("pos") * 2 + F.col("single").cast("int")).alias("chosen"))
        lists = self.profiles.join(chosen.hint("merge"), "node").join(self.coarse.select("node", "bits").hint("merge"), "node").select("node", "n", "need", "comp", "q", "chosen", "bits")
        fields = "node long, n int, comp long, token long, second long, before array<long>, " + ", ".join(f"{w} long" for w in words)
        entries = store(lists.mapInArrow(_frequent, fields), "entries")
        found = met(rows.where("not frequent"), ["token"], []).unionByName(met(entries, ["token", "second"], words))
        return store(found.distinct(), "candidates")

    def result(self) -> DataFrame:
        """``(doc_id, tie, n_shingles, component_id)``; ``tie`` is a hash of the text."""
        self.stars()
        self.add(self.candidates())
        nodes = self.nodes.select("node", "first_id")
        if self.labels is not None:
            merged = store(self.labels.join(nodes, "node").groupBy("comp").agg(F.min("first_id").alias("component_id")), "named")
            least = self.labels.join(merged, "comp").select("node", "component_id")
        else:
            least = nodes.select("node", F.col("first_id").alias("component_id")).limit(0)
        node_ids = nodes.join(least, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
        node_ids = store(node_ids, "node-ids")
        out = self.rows.join(node_ids.hint("merge"), "node", "left")
        return out.select("doc_id", "tie", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row."""
    return Join(docs, id_col, text_col).result().drop("tie")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without all but one document of each component: the smallest id stays, then the smallest hash.

    Only documents that go are gathered; others stay where they are.  A null id goes if its component has
    another; rows that repeat id and text are one document.
    """
    found = store(Join(docs, id_col, text_col).result(), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ties = found.where(stays & (F.col("n_shingles") > 0)).groupBy("doc_id").agg(F.min("tie").alias("low"), F.max("tie").alias("high")).where("low <> high")
    later = found.where(stays & (F.col("n_shingles") > 0)).join(ties, "doc_id").where("tie <> low")
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(0).cast("long")).alias("i"), F.col("doc_id").isNull().alias("z"), F.col("tie").alias("t"))
    name = fresh(docs.columns, "nj_key")
    gone = store(found.where(~stays).select(key.alias(name)).unionByName(later.select(key.alias(name))).distinct(), "gone")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("i"), F.col(id_col).isNull().alias("z"), F.xxhash64(body).alias("t"))
    rows, some = docs.withColumn(name, own), KeyFilter(gone, name)
    suspects = some.keep(rows, F.col(name)).join(gone, name, "left_anti")
    return some.drop(rows, F.col(name)).unionByName(suspects.select(*rows.columns)).drop(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE = """
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents
),
s as (
    select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as shingles from w
),
n as (select doc_id, len(shingles) as n_shingles from s),
x as (select doc_id, unnest(shingles) as shingle from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from x a join x b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 75 * (na.n_shingles + nb.n_shingles - common)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as comp from documents union select e.b, r.comp from r join e on e.a = r.doc_id)
select n.doc_id, n.n_shingles, min(comp) as component_id from r join n on n.doc_id = r.doc_id group by 1, 2
"""
