"""Exact, cached tokenization: a text is cut where the tokenizer always cuts, and repeated chunks are encoded once.

Both public vocabularies split a text before its first white space after other characters, and nothing to
the left of such a cut changes the ids to the right of it; likewise between a letter and ASCII marks before
white space.  Arrow cuts a batch of texts there and numbers its chunks, so Python handles each distinct
chunk of a batch once and the tokenizers library sees it once per cache generation.  Ids are gathered by
number.  Texts with other white space before a blank, or with characters that libraries class
differently, are handed to the tokenizer whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks for vocabularies that keep white space in their pieces, and for those that drop it (and case).
KEPT, DROPPED = "kept", "dropped"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"  # ASCII marks but the apostrophe, which may begin a contraction
CUT = "\x01"
_CONTROL = "\x01\x1c\x1d\x1e\x1f"
_BLANK = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks in one generation of the cache; two generations are held.
CACHE_CHUNKS = 550_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Batches of texts to ids.  ``dtype`` is the narrowest unsigned type that holds an id."""

    def __init__(self, path: str, white_space: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: For chunks that are one piece to the pre-tokenizer and unchanged by the normalizer.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.drop = white_space == DROPPED
        self.odd = f"[{_CONTROL}]" if self.drop else f"[\n ] |[{_CONTROL}{_BLANK}]"
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, tokenizer, texts: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Texts with CUT at places where the tokenizer cuts, whatever stands on either side."""
        if self.drop:
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, f"([{_LETTER}])([{_MARK}]+[ \n])", rf"\1{CUT}\2")
        if self.drop:
            return pc.replace_substring(pc.replace_substring(texts, "\n", CUT), " ", CUT)
        texts = pc.replace_substring_regex(texts, f"([^ \n])\n([{_LETTER}])", f"\\1{CUT}\n{CUT}\\2")
        return pc.replace_substring(texts, " ", f"{CUT} ")

    def _fetch(self, missing: list[str]) -> None:
        """Adds chunks to the cache: from the older generation or from the tokenizer."""
        cache, old = self.cache, self.old
        simple, other = [], []
        for chunk in missing:
            if (known := old.get(chunk)) is not None:
                cache[chunk] = known
                continue
            core = chunk[1:] if chunk[:1] == " " else chunk
            (simple if core.isalpha() and (core.isascii() or _latin(core) and not (self.drop and core != core.lower())) else other).append(chunk)
        cache.update(zip(simple, self._encode(self.plain, simple), strict=True))
        cache.update(zip(other, self._encode(self.tokenizer, other), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts (no nulls), one text after another, and the number of ids of each."""
        if len(self.cache) > (CACHE_CHUNKS // 5 if self.drop else CACHE_CHUNKS):  # case and blanks make chunks many
            self.old, self.cache = self.cache, {}
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(self._cut(texts.filter(pa.array(~odd))), CUT)
        first = words.offsets.to_numpy()[:-1]
        coded = words.values.dictionary_encode()
        index = coded.indices.to_numpy()
        chunks = coded.dictionary.to_pylist()
        cache = self.cache
        held = list(map(cache.get, chunks))
        if missing := [c for c, h in zip(chunks, held, strict=True) if h is None]:
            self._fetch(missing)
            held = list(map(cache.__getitem__, chunks))
        size = np.fromiter(map(len, held), np.int32, len(held)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(held), self.dtype)
        count = size[index]
        ends = np.cumsum(count, dtype=np.int32)  # a batch has far fewer than 2**31 ids
        ids = pool[np.repeat((np.cumsum(size, dtype=np.int32) - size)[index] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        lengths = np.zeros(len(texts), np.int64)
        if len(first):
            lengths[~odd] = np.add.reduceat(count, first)
        if odd.any():
            whole = self._encode(self.tokenizer, texts.filter(pa.array(odd)).to_pylist())
            return self._merge(ids, lengths, odd, [np.frombuffer(w, self.dtype) for w in whole])
        return ids, lengths

    def _merge(self, ids: np.ndarray, lengths: np.ndarray, odd: np.ndarray, whole: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, rest, out = 0, iter(whole), []
        for k in range(len(odd)):
            if odd[k]:
                out.append(next(rest))
                lengths[k] = len(out[-1])
            else:
                out.append(ids[at : at + lengths[k]])
                at += lengths[k]
        return np.concatenate(out), lengths


def _latin(text: str) -> bool:
    return text.isascii() or max(text) <= "\xff"


#: What a worker process keeps from one task to the next: one operator's large object at a time.
_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Small batches joined up to about ``most`` bytes of text, in which chunks repeat more often."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch[column].nbytes
        if size >= most:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text; a longer text is a piece of its own.

    Unless it is to be kept, what an earlier operator left in this worker is dropped.
    """
    if not keep:
        _held.clear()
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    _trim()


def _trim() -> None:
    """Give freed memory back, so that a worker that is used again does not hold on to an earlier task's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str, white_space: str) -> ChunkEncoder:
    """One encoder for each worker process."""
    return held(("encoder", path, white_space), lambda: ChunkEncoder(path, white_space))
