"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 50 words.  Each passage is encoded from character classes, repetition
and length of its words; a gated attention, learned from document labels alone, weighs the passages, and
the document's score is that of the weighted representation.

Training reads at most ``MAX_DOCS`` labelled documents (those with the smallest hash of their id), each with
all its passages, and leaves out those with which the passages would be more than ``MAX_PASSAGES`` together;
this bound on labelled rows is the only one.  Every document is scored on all its passages.  Labels are read only from rows that are not held out; labels, language, source and id
are never inputs of a score.

Defined results: a null text counts as empty and is scored as one passage without words; rows that repeat
an id are scored one by one; labels that repeat an id count once (the largest); without any usable label
every score is 0.5; very long texts are read whole; ties need no order; an empty table gives an empty result;
other columns are kept, but for one with the name of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import columns_of, table, whole_rows
from tidemark.llm.tokens import slices
from tidemark.session import ship_package

PASSAGE_WORDS = 50
MAX_DOCS = 4000
MAX_PASSAGES = 100_000
HIDDEN, GATES = 16, 8
CUTOFF = 0.3
SLICE = 1 << 21  # bytes of text whose features are made at a time
#: Byte classes, each a feature: upper, lower, digit, stop, shout, bar, symbol, beyond ASCII, line feed.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"|", b"#$%&*@^~<>{}[]\\/=+_`", bytes(range(128, 256)), b"\n\r")
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _bytes in enumerate(_CLASSES):
    _CLASS_OF[list(_bytes)] = _i
N_FEATURES = len(_CLASSES) + 9


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def word_features(words: pa.Array) -> np.ndarray:
    """Class counts and flags of each word."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(pc.cast(words, pa.binary()).to_pylist()), np.uint8)
    n = len(_CLASSES) + 1
    counts = np.bincount(np.repeat(np.arange(len(size)) * n, size) + _CLASS_OF[raw], minlength=len(size) * n).reshape(len(size), n)[:, :-1]
    flags = np.stack([size, counts[:, 6] > 0, (counts[:, 0] > 1) & (counts[:, 1] == 0), counts[:, 4] > 1, counts[:, 5] > 0], axis=1)
    return np.concatenate([counts, flags], axis=1).astype(np.float32)


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, text after text, and the number of passages of each text."""
    words = pc.split_pattern(texts, " ")
    first = words.offsets.to_numpy()[:-1].astype(np.int64)
    coded = words.values.dictionary_encode()
    index = coded.indices.to_numpy()
    n_words = np.diff(words.offsets.to_numpy()).astype(np.int64)
    n_passages = -(-n_words // PASSAGE_WORDS)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(index)) - first[text_of]
    passage = (np.cumsum(n_passages) - n_passages)[text_of] + place // PASSAGE_WORDS
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    held = np.diff(np.append(starts, len(index)))[:, None]
    same = np.zeros(len(index), np.float32)
    same[1:] = index[1:] == index[:-1]
    same[first] = 0
    order = np.unique(passage * np.int64(len(coded.dictionary)) + index)
    distinct = np.bincount(order // len(coded.dictionary), minlength=len(starts))[:, None]
    sums = np.add.reduceat(np.concatenate([word_features(coded.dictionary)[index], same[:, None]], axis=1), starts, axis=0)
    length = np.maximum(sums[:, len(_CLASSES) : len(_CLASSES) + 1], 1)
    by_byte, by_word = sums[:, : len(_CLASSES)] / length, sums[:, len(_CLASSES) :] / held
    whole = np.log1p(n_words[np.repeat(np.arange(len(texts)), n_passages)])[:, None]
    return np.concatenate([by_byte, by_word, distinct / held, held / PASSAGE_WORDS, whole], axis=1).astype(np.float32), n_passages


class AttentionModel:
    """Gated attention over encoded passages, trained by Adam on the log loss of documents."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.weights = {
            "encode": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "bias": np.zeros(HIDDEN), "attend": rng.normal(0, 0.3, (HIDDEN, GATES)),
            "gate": rng.normal(0, 0.3, (HIDDEN, GATES)), "mix": rng.normal(0, 0.3, GATES), "out": rng.normal(0, 0.3, HIDDEN), "base": np.zeros(1),
        }

    def forward(self, rows: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        starts, bag = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
        hidden = np.tanh(x @ w["encode"] + w["bias"])
        attend, gate = np.tanh(hidden @ w["attend"]), 1 / (1 + np.exp(-hidden @ w["gate"]))
        score = (attend * gate) @ w["mix"]
        weight = np.exp(score - np.maximum.reduceat(score, starts)[bag])
        weight /= np.add.reduceat(weight, starts)[bag]
        pooled = np.add.reduceat(weight[:, None] * hidden, starts, axis=0)
        chance = 1 / (1 + np.exp(-(pooled @ w["out"] + w["base"][0])))
        return {"x": x, "starts": starts, "bag": bag, "hidden": hidden, "attend": attend, "gate": gate, "weight": weight, "pooled": pooled, "chance": chance}

    def gradients(self, rows: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, s = self.weights, self.forward(rows, counts)
        d_logit = (s["chance"] - labels) / len(labels)
        d_pooled = (d_logit[:, None] * w["out"])[s["bag"]]
        d_weight = (s["hidden"] * d_pooled).sum(axis=1)
        d_score = s["weight"] * (d_weight - np.add.reduceat(s["weight"] * d_weight, s["starts"])[s["bag"]])
        d_mixed = d_score[:, None] * w["mix"]
        d_attend = d_mixed * s["gate"] * (1 - s["attend"] ** 2)
        d_gate = d_mixed * s["attend"] * s["gate"] * (1 - s["gate"])
        d_hidden = s["weight"][:, None] * d_pooled + d_attend @ w["attend"].T + d_gate @ w["gate"].T
        d_pre = d_hidden * (1 - s["hidden"] ** 2)
        return {
            "encode": s["x"].T @ d_pre, "bias": d_pre.sum(axis=0), "attend": s["hidden"].T @ d_attend, "gate": s["hidden"].T @ d_gate,
            "mix": (s["attend"] * s["gate"]).T @ d_score, "out": s["pooled"].T @ d_logit, "base": np.array([d_logit.sum()]),
        }

    def fit(self, rows: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 200, rate: float = 0.03) -> AttentionModel:
        moment = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            for k, g in self.gradients(rows, counts, labels).items():
                g = g + 1e-4 * self.weights[k]
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.weights[k] -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        return self


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """``(body, label)`` of at most ``most`` labelled documents that are not held out, one row for each label."""
    usable = labels.select(F.col(id_col).alias("l_id"), F.col(label).cast("int").alias("label")).where(F.col("l_id").isNotNull() & F.col("label").isNotNull() & ~held_out("l_id", parts, part))
    chosen = usable.groupBy("l_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    texts = docs.select(F.col(id_col).alias("l_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    return texts.join(F.broadcast(chosen), "l_id").select("l_id", "body", "label")  # at most ``most`` rows


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, part: int = 0, id_col: str = "doc_id", text_col: str = "text") -> AttentionModel | None:
    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "body", SLICE):
                rows, counts = passages(some["body"])
                ends = np.cumsum(counts).tolist()
                bags = [rows[lo:hi].tobytes() for lo, hi in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([some["l_id"].cast(pa.int64()), some["label"], pa.array(bags, pa.binary())], names=["l_id", "label", "bag"])

    ship_package(docs.sparkSession)
    sample = labelled(docs, labels, label, parts, part, MAX_DOCS, id_col, text_col)
    size = F.ceil(F.size(F.split("body", " ", -1)) / PASSAGE_WORDS)
    sizes = sample.groupBy("l_id").agg(F.sum(size).alias("n"), F.xxhash64(F.first("l_id")).alias("h")).collect()  # MAX_DOCS rows
    left, fitting = MAX_PASSAGES, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["l_id"])):
        if r["n"] <= left:
            left -= r["n"]
            fitting.append(r["l_id"])
    if len(fitting) < len(sizes):
        sample = sample.where(F.col("l_id").isin(fitting))
    sample = sample.select(F.col("l_id").cast("long").alias("l_id"), "label", "body").mapInArrow(featurize, "l_id long, label int, bag binary")
    found = sorted({(r["l_id"], r["label"], bytes(r["bag"])) for r in sample.collect()})  # MAX_PASSAGES rows of 72 bytes
    if not found:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for _, _, b in found]
    rows, counts = np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags])
    wanted = np.array([float(y) for _, y, _ in found])
    return AttentionModel(rows.mean(axis=0), rows.std(axis=0) + 1e-3).fit(rows, counts, wanted)


def _scored(rows: DataFrame, model: AttentionModel | None) -> DataFrame:
    """``rows (row, body)`` with ``score``."""
    fields = T.StructType([rows.schema["row"], rows.schema["body"], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "body", SLICE):
                if model is None:
                    chance = np.full(some.num_rows, 0.5)
                else:
                    features, counts = passages(pc.fill_null(some["body"], ""))
                    chance = model.forward(features.astype(np.float64), counts)["chance"]
                yield pa.RecordBatch.from_arrays([some["row"], some["body"], pa.array(chance)], names=["row", "body", "score"])

    return rows.mapInArrow(score, fields)


def quality_scores(docs: DataFrame, model: AttentionModel | None, text_col: str = "text") -> DataFrame:
    """The input with ``q_score double`` (which replaces a column of that name)."""
    scored = _scored(whole_rows(docs, text_col), model)
    return scored.select(*columns_of(docs, text_col, ("q_score",)), F.col("score").alias("q_score"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the documents that the classifier rejects; all columns stay."""
    scored = _scored(whole_rows(docs, text_col), train(docs, labels, id_col=id_col, text_col=text_col))
    return scored.where(F.col("score") >= CUTOFF).select(*columns_of(docs, text_col))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    scored = _scored(rows, model).select("row.*", "score")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
