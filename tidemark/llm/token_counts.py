"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

The vocabulary's pieces and scores are read from a given file and taken as a unigram model with byte
fallback.  The default file is a BPE vocabulary whose scores are merge ranks: its counts are those of a
synthetic unigram model, not of the file's own encoding (see the README).  An Aho-Corasick automaton enumerates all pieces that end at each place of a word; dynamic
programming keeps, for each place, the best score and the number of pieces on its path, and no back
pointers.  Ties follow the tokenizers library: places are relaxed from the left and only a strictly better
score replaces, so of equal paths to a place the one whose last piece starts first stays.  A character that
no piece matches alone costs the smallest score less ten and counts one piece for each of its bytes.

Words (cut at blanks, each with the mark that stands for its blank) are segmented on their own, as that
pre-tokenizer does, so each distinct word of a batch is segmented once and remembered by the worker.

Defined results: a null text counts as empty and has no tokens; rows that repeat an id are counted one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.tokens import default_path, gathered, held, slices

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces with scores, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts of one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pieces, self.unknown_piece = dict(vocabulary), vocabulary[0][0]
        pieces = self.pieces
        if any(f"<0x{b:02X}>" not in pieces for b in range(256)):
            raise ValueError("the vocabulary has no piece for some byte")
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, word: str) -> tuple[float, int]:
        """Best score and number of pieces of a word."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        done = 0  # places up to here are final

        def relax(end: int, alone: bool) -> None:
            if not alone:  # no piece is the character itself
                own = self.unknown + best[end - 1]
                if best[end] is None or own > best[end]:
                    best[end], count[end] = own, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))

        alone = False
        for last, (size, score) in self.automaton.iter(word):  # ends ascend; of one end, long pieces come first
            end = last + 1
            while done < end - 1:
                done += 1
                relax(done, alone)
                alone = False
            own = score + best[end - size]
            if best[end] is None or own > best[end]:
                best[end], count[end] = own, count[end - size] + 1
            alone = alone or size == 1
        while done < n:
            done += 1
            relax(done, alone)
            alone = False
        return best[n], count[n]

    def word_with_unknown_piece(self, word: str) -> int:
        """For words that spell the unknown piece out: the library joins it with unknown characters beside it."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, bool]] = [(0, False)] * (n + 1)
        longest = max(map(len, self.pieces))
        for start in range(n):
            alone = False
            for end in range(start + 1, min(n, start + longest) + 1):
                if (score := self.pieces.get(word[start:end])) is not None:
                    alone = alone or end == start + 1
                    if best[end] is None or score + best[start] > best[end]:
                        best[end], back[end] = score + best[start], (start, word[start:end] == self.unknown_piece)
            if not alone and (best[start + 1] is None or self.unknown + best[start] > best[start + 1]):
                best[start + 1], back[start + 1] = self.unknown + best[start], (start, True)
        total, end, run_end = 0, n, None
        while end or run_end is not None:
            start, unknown = back[end] if end else (0, False)
            if end and unknown:
                run_end = end if run_end is None else run_end
            else:
                if run_end is not None:
                    run = word[end:run_end]
                    total += 1 if run in self.pieces else len(run.encode("utf-8", "surrogatepass"))
                    run_end = None
                total += bool(end)
            if not end:
                break
            end = start
        return total

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Pieces of each text of a batch without nulls.  The vocabulary's first piece is the unknown one."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        texts = pc.replace_substring(texts, BLANK, " ")  # the mark in a text cannot be told from a blank's
        words = pc.split_pattern(texts, " ")
        offsets = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.known
        for w in distinct:
            if w not in known:
                known[w] = self.word_with_unknown_piece(BLANK + w) if self.unknown_piece in w else self.word(BLANK + w)[1]
        each = np.array([known[w] for w in distinct], np.int64)[coded.indices.to_numpy()]
        total = np.add.reduceat(each, offsets[:-1]) if len(texts) else np.zeros(0, np.int64)
        # a text that starts with a blank has its mark already; an empty one has none
        first = pc.starts_with(texts, " ").to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        return total - np.where(first, self.word(BLANK)[1], 0)


def counter(path: str) -> Counter:
    """One counter for each worker process."""
    return held(("counter", path), lambda: Counter(read_vocabulary(path)))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)``, one row per input row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in gathered(batches, "body", 1 << 22):
            for some in slices(batch, "body", keep=True):
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(own.counts(some["body"]))], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary or default_path("piece_bpe_32k.model"))
