"""Toxicity by a weighted finite-state pattern grammar.

Words map to symbols: INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK (a clause ends, at a semicolon), STOP (a
sentence ends, at a full stop, exclamation mark, question mark or line feed) or OTHER.  Small transducers read
letters, a symbol with its marks so far, and write the same letters with further marks: negation marks the three
words after it and a target the four words after it, both within the clause; reported speech lasts to the end of
its sentence.  Composed, each one reading what the one before wrote, they are one transducer; a second one reads
its output from right to left and marks what stands before a target.  A match's marks decide its pattern: plain,
aimed, negated or reported, of an insult or of a threat.  Each pattern has a weight, which multiplies the
weights of its matches.

A text is scored by its matched clauses: the weights by pattern, and of what is said outright, neither negated
nor reported, the two heaviest clauses, the number, share and variety of matches.  A word adds nothing but
through the pattern of its clause, and a negated or reported match weighs half of a plain one at most.

Word weights (whole words, and beginnings of words for languages that inflect them) and pattern weights
are learned from labelled rows that are not held out: at most ``MAX_TOXIC`` and ``MAX_CLEAN`` documents,
those with the smallest hash of their id; this is the only bound.  Whole texts are scored.  Labels,
language, source and id are never inputs of a score.

Defined results: a null text counts as empty; a text without matches has the score of no match; very long texts
are read whole; rows that repeat an id are scored one by one; labels that repeat an id count once (the largest); without labels of
both kinds all weights but the prior are zero; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.quality import held_out
from tidemark.llm.tokens import slices
from tidemark.session import ship_package

MAX_TOXIC, MAX_CLEAN = 3000, 6000
PREFIXES = (4, 5, 6, 7, 8)
CUTOFF = 0.3
INSULT, THREAT, TARGET, NEGATION, REPORT, STOP, OTHER, BREAK = range(8)
#: Fixed word lists of the grammar; insults are learned.
THREAT_WORDS = "kill killed hurt destroy beat burn shoot stab murder attack die töten umbringen schlagen verletzen tuer frapper brûler matar golpear quemar".split()
TARGET_WORDS = "you your yours u ya they them he she him her du dich dir dein sie ihr tu te toi ton vous votre tú te ti tu usted ustedes vosotros".split()
NEGATION_WORDS = "not never no none don't isn't aren't wasn't nicht nie kein keine ne pas jamais nunca jamás".split()
REPORT_WORDS = "said says wrote writes quoted claimed reported allegedly sagte schrieb dit écrit dijo escribió".split()
_FIXED = {w: s for s, words in ((REPORT, REPORT_WORDS), (NEGATION, NEGATION_WORDS), (TARGET, TARGET_WORDS), (THREAT, THREAT_WORDS)) for w in words}
_EDGE = " \n\t\r.,;:!?\"'()[]{}<>|*#$%&@-_=+/\\~`^"
_ENDS = {".": STOP, "!": STOP, "?": STOP, ";": BREAK}

PLAIN, AIMED, NEGATED, REPORTED = range(4)
NEGATION_SCOPE, TARGET_SCOPE = 3, 4


#: What a match may be marked with, and the letters: a symbol and a set of marks.
MARKS = {AIMED: 1, NEGATED: 2, REPORTED: 4}
N_LETTERS = 8 * 8


class Transducer:
    """A deterministic transducer over letters, ``arcs[state][letter] = (next state, letter)``; a letter is ``8 * symbol + marks``."""

    def __init__(self, arcs: list[list[tuple[int, int]]]):
        self.arcs = arcs

    def compose(self, other: Transducer) -> Transducer:
        """The transducer that does what ``other`` does with this one's output."""
        n, arcs = len(other.arcs), []
        for own in self.arcs:
            for its in other.arcs:
                row = []
                for letter in range(N_LETTERS):
                    state, between = own[letter]
                    last, out = its[between]
                    row.append((state * n + last, out))
                arcs.append(row)
        return Transducer(arcs)

    def run(self, letters: list[int]) -> list[int]:
        state, out = 0, []
        for letter in letters:
            state, written = self.arcs[state][letter]
            out.append(written)
        return out


def scope(opener: int, length: int, pattern: int) -> Transducer:
    """Marks the ``length`` words after ``opener``, up to the end of the clause."""
    arcs = []
    for left in range(length + 1):
        mark = MARKS[pattern] if left else 0
        arcs.append([(length if x // 8 == opener else 0 if x // 8 in (STOP, BREAK) else max(0, left - 1), x | mark) for x in range(N_LETTERS)])
    return Transducer(arcs)


def sentence(opener: int, pattern: int) -> Transducer:
    """Marks what follows ``opener`` up to the end of the sentence."""
    return Transducer([[(int(x // 8 == opener or bool(inside) and x // 8 != STOP), x | (MARKS[pattern] if inside else 0)) for x in range(N_LETTERS)] for inside in (0, 1)])


FORWARD = scope(NEGATION, NEGATION_SCOPE, NEGATED).compose(scope(TARGET, TARGET_SCOPE, AIMED)).compose(sentence(REPORT, REPORTED))
BACKWARD = scope(TARGET, TARGET_SCOPE, AIMED)


def pattern_of(letter: int) -> int:
    """The pattern of a match, 0 to 7, or -1."""
    symbol, marks = divmod(letter, 8)
    if symbol not in (INSULT, THREAT):
        return -1
    own = next((p for p in (REPORTED, NEGATED, AIMED) if marks & MARKS[p]), PLAIN)
    return (0 if symbol == INSULT else 4) + own


PATTERN = [pattern_of(x) for x in range(N_LETTERS)]
N_FEATURES = 8 + 6


def patterns(symbols: list[int]) -> list[int]:
    """The pattern of each symbol's match, or -1: the text is read from left to right, what that writes from right to left."""
    marked = BACKWARD.run(FORWARD.run([8 * s for s in symbols])[::-1])[::-1]
    return [PATTERN[x] for x in marked]


def normal(word: str) -> str:
    return word.strip(_EDGE).lower()


class Lexicon:
    """Learned weights of words and beginnings of words."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings

    def symbol(self, word: str) -> tuple[int, float]:
        weight = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) >= n and (w := self.beginnings.get(word[:n], 0.0)) > weight:
                weight = w
        if weight:
            return INSULT, weight
        kind = _FIXED.get(word, OTHER)
        return kind, 1.0 if kind == THREAT else 0.0


def symbols_of(raw: str, lexicon: Lexicon) -> list[tuple[int, float]]:
    """Symbols and weights of a text without blanks."""
    out: list[tuple[int, float]] = []
    for k, part in enumerate(raw.split("\n")):
        if k:
            out.append((STOP, 0.0))
        if core := normal(part):
            out.append(lexicon.symbol(core))
            if part[-1] in _ENDS:
                out.append((_ENDS[part[-1]], 0.0))
    return out


def match_features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """What the grammar emits for each text: weights by pattern; of what is said outright, the two heaviest clauses, number, share and variety; length."""
    words = pc.split_pattern(texts, " ")
    offsets = words.offsets.to_numpy()
    coded = words.values.dictionary_encode()
    index = coded.indices.to_numpy()
    read = [symbols_of(raw, lexicon) for raw in coded.dictionary.to_pylist()]  # line feeds may join two words
    hot = np.array([any(s in (INSULT, THREAT) for s, _ in symbols) for symbols in read], bool)
    out = np.zeros((len(texts), N_FEATURES))
    n_words = np.diff(offsets)
    out[:, 13] = np.log1p(n_words) / 10
    hits = hot[index] if len(index) else np.zeros(0, bool)
    some = np.add.reduceat(hits, offsets[:-1]) if len(texts) else np.zeros(0)
    for t in np.flatnonzero(some):
        found = [(symbol, weight, i) for i in index[offsets[t] : offsets[t + 1]].tolist() for symbol, weight in read[i]]
        clause, clauses, number, distinct = 0.0, [0.0, 0.0], 0, set()
        for (symbol, weight, i), pattern in zip(found, patterns([s for s, _, _ in found]), strict=True):
            if pattern >= 0:
                out[t, pattern] += weight
            if pattern % 4 in (PLAIN, AIMED) and pattern >= 0:
                clause += weight
                number += 1
                distinct.add(i)
            elif symbol in (STOP, BREAK) and clause:
                clauses.append(clause)
                clause = 0.0
        first, second = sorted([*clauses, clause], reverse=True)[:2]
        outright = sum(out[t, p] for p in (PLAIN, AIMED, 4 + PLAIN, 4 + AIMED))
        out[t, 8:13] = math.log1p(first), math.log1p(second), math.log1p(number), 30 * outright / (30 + n_words[t]), math.log1p(len(distinct))
    out[:, :8] = np.log1p(out[:, :8])
    return out


def learn_lexicon(counts: list[tuple[str, bool, int, int]], toxic: int, clean: int) -> Lexicon:
    """Words and beginnings that a likelihood-ratio test, corrected for their number, ties to toxic texts."""
    counts = [c for c in counts if c[2] >= 3]
    least = 2 * math.log(len(counts) + 1) + 8
    words: dict[str, float] = {}
    beginnings: dict[str, float] = {}
    for text, whole, pos, neg in counts:
        p, q, r = pos / toxic, neg / max(clean, 1), (pos + neg) / (toxic + clean)
        if p <= q:
            continue

        def part(k: float, n: float, own: float, r: float = r) -> float:
            return (k * math.log(own / r) if k else 0) + ((n - k) * math.log((1 - own) / (1 - r)) if n > k and r < 1 else 0)

        weight = math.log((pos + 0.5) / (toxic + 1)) - math.log((neg + 0.5) / (clean + 1))
        if 2 * (part(pos, toxic, p) + part(neg, clean, q)) >= least and weight >= 1.5:
            (words if whole else beginnings)[text] = min(weight, 8.0)
    return Lexicon(words, beginnings)


def fit_logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Newton's method with a ridge; the last coefficient is the intercept."""
    x = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
    beta = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge * weights.sum()
    penalty[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (p - labels)) + penalty @ beta
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        move = np.linalg.solve(curve, slope)
        beta -= move * min(1, 5 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return beta


def grammar_weights(beta: np.ndarray) -> np.ndarray:
    """Pattern weights as the grammar allows them: negated and reported matches weigh half of plain ones at most."""
    beta = beta.copy()
    for kind in (0, 4):
        most = max(0.0, beta[kind + PLAIN]) / 2
        beta[kind + NEGATED], beta[kind + REPORTED] = min(beta[kind + NEGATED], most), min(beta[kind + REPORTED], most)
    return beta


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, part: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[Lexicon, np.ndarray]:
    ship_package(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("l_id"), F.col(label).cast("int").alias("label")).where(F.col("l_id").isNotNull() & F.col("label").isNotNull() & ~held_out("l_id", parts, part))
    usable = usable.groupBy("l_id").agg(F.max("label").alias("label"))
    of = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = usable.where("label = 1").orderBy(F.xxhash64("l_id"), "l_id").limit(MAX_TOXIC).unionByName(usable.where("label = 0").orderBy(F.xxhash64("l_id"), "l_id").limit(MAX_CLEAN))
    texts = docs.select(F.col(id_col).alias("l_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    sample = texts.join(F.broadcast(some), "l_id").select("body", "label")  # at most MAX_TOXIC + MAX_CLEAN rows
    sample = sample.repartition(16).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for body, y in zip(batch["body"].to_pylist(), batch["label"].to_pylist(), strict=True):
                words = {normal(w) for w in body.split()}
                seen[y].update(("w", w) for w in words if w)
                seen[y].update(("b", b) for b in {w[:k] for w in words for k in PREFIXES if len(w) > k})
                n[y] += 1
        seen[1]["n", ""], seen[0]["n", ""] = n[1], n[0]
        keys = [k for k in seen[1] if k[0] == "n" or seen[1][k]]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["kind", "text", "pos", "neg"])

    # what no toxic text of a task holds is left out there; its clean count is added where some task needs it
    toxic_first = sample.where("label = 1")
    counted = toxic_first.mapInArrow(count, "kind string, text string, pos long, neg long").groupBy("kind", "text").agg(F.sum("pos").alias("pos")).where("pos >= 3 or kind = 'n'").collect()
    toxic = next((r["pos"] for r in counted if r["kind"] == "n"), 0)
    candidates = {(r["kind"], r["text"]): r["pos"] for r in counted if r["kind"] != "n"}
    wanted = frozenset(candidates)

    def count_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for body in batch["body"].to_pylist():
                words = {normal(w) for w in body.split()}
                seen.update(k for k in {("w", w) for w in words} | {("b", w[:n]) for w in words for n in PREFIXES if len(w) > n} if k in wanted)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "text", "neg"])

    neg = {(r["kind"], r["text"]): r["neg"] for r in sample.where("label = 0").mapInArrow(count_clean, "kind string, text string, neg long").groupBy("kind", "text").agg(F.sum("neg").alias("neg")).collect()}
    clean = sample.where("label = 0").count()
    if not toxic or not clean:
        sample.unpersist()
        prior = (of.get(1, 0) + 0.5) / (sum(of.values()) + 1)
        return Lexicon({}, {}), np.array([0.0] * N_FEATURES + [math.log(prior / (1 - prior))])
    lexicon = learn_lexicon([(text, kind == "w", pos, neg.get((kind, text), 0)) for (kind, text), pos in sorted(candidates.items())], toxic, clean)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "body"):
                rows = match_features(piece["body"], lexicon)
                yield pa.RecordBatch.from_arrays([piece["label"], pa.array(list(rows))], names=["label", "row"])

    rows = sorted((r["label"], r["row"]) for r in sample.mapInArrow(featurize, "label int, row array<double>").collect())
    sample.unpersist()
    y = np.array([r[0] for r in rows], float)
    share = np.where(y == 1, of[1] / toxic, of[0] / clean)
    return lexicon, grammar_weights(fit_logistic(np.array([r[1] for r in rows]), y, share / share.mean()))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row."""
    lexicon, beta = train(docs, labels, id_col=id_col, text_col=text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "body"):
                x = match_features(some["body"], lexicon)
                chance = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(chance)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
