import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import frame
from tidemark.llm import packing, token_files
from tidemark.llm.common import scratch_path
from tidemark.llm.tokens import DROPPED, KEPT, ChunkEncoder, default_path

BYTE, WORD = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")


def ids_of(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array(e.ids, np.uint32) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path, kind", [(BYTE, KEPT), (WORD, DROPPED)])
def test_chunks_encode_as_whole_texts(path, kind):
    rng = random.Random(3)
    bits = ["a", "B", " ", "\n", "  ", "'s", "é", "é", "̈", "1", "23", "!", "?\n", "\t", "ñ", "word", "\xa0", "'", "ll", "Σ", "İ", "\U0001f600", "　", "ß", "\x1c", "\x85", "\x01", "...", "ª", "_", "-", "<|endoftext|>"]
    texts = [""] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    encoder = ChunkEncoder(path, kind)
    flat, lengths = encoder.encode(pa.array(texts))
    got = np.split(flat, np.cumsum(lengths)[:-1])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, ids_of(path, texts), strict=True))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_segments_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 50257, n).astype(np.uint16)
    if n > 600:
        ids[:600] = ids[:600] % 37 + 5  # narrow blocks with one outlier
        ids[100] = 50_000
    found, doc_ids, lengths = token_files.unpack(token_files.pack(ids, [None, -3], [n, 0]))
    assert (found == ids).all() and doc_ids == [None, -3] and list(lengths) == [n, 0]


def test_token_files(spark, odd, odd_rows, nothing):
    path = scratch_path(spark, "test")
    token_files.write_segments(odd, path, BYTE)
    got = [tuple(r) for r in token_files.read_segments(spark, path).orderBy("start").collect()]
    ids = {t: np.append(i, 2).astype("<u4") for (_, t), i in zip(odd_rows, ids_of(BYTE, [t or "" for _, t in odd_rows]), strict=True)}
    want = sorted((-1 if i is None else i, len(ids[t]), zlib.crc32(ids[t].tobytes())) for i, t in odd_rows)
    assert sorted((-1 if i is None else i, n, crc) for i, _, n, crc in got) == want
    at = 0
    for i, start, n, _ in got:
        assert start == at
        at += n
    order = [-1 if r[0] is None else r[0] for r in got]
    assert order == sorted(order)
    path = scratch_path(spark, "test")
    token_files.write_segments(nothing, path, BYTE)
    assert token_files.read_segments(spark, path).count() == 0


def check_pieces(rows, pieces):
    ids = defaultdict(list)
    for (i, _), x in zip(rows, ids_of(WORD, [t or "" for _, t in rows]), strict=True):
        ids[i].append(np.append(x, 2).astype("<u4"))
    by_doc, sequences, padding = defaultdict(list), defaultdict(list), 0
    for doc_id, start, length, crc, n, sequence, offset in pieces:
        assert any(len(x) == n and zlib.crc32(x[start : start + length].tobytes()) == crc for x in ids[doc_id])
        by_doc[doc_id].append((n, start, length))
        sequences[sequence].append((offset, length))
    for doc_id, texts in ids.items():
        assert sum(length for _, _, length in by_doc[doc_id]) == sum(map(len, texts))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding, len(sequences)


def test_packing(spark, odd, odd_rows, nothing):
    pieces = [tuple(r) for r in packing.pack_documents(odd, WORD).collect()]
    check_pieces(odd_rows, pieces)
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_packing_pads_little(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 5000)))) for i in range(300)]
    pieces = [tuple(r) for r in packing.pack_documents(frame(spark, rows), WORD).collect()]
    padding, n = check_pieces(rows, pieces)
    assert padding < 0.01 * 4096 * n


def test_linear_program_is_near_its_bound():
    sizes, demand = np.array([1500, 1100, 900, 400, 10]), np.array([40.0, 90.0, 120.0, 70.0, 500.0])
    columns, amount = packing.solve_patterns(sizes, demand, 4096, gap=1e-6)
    assert np.allclose(columns.T @ amount, demand) and ((columns @ sizes) <= 4096).all()
    assert demand @ sizes / 4096 - 1e-6 <= amount.sum() <= 1.2 * (demand @ sizes) / 4096
    value, pattern = packing.best_pattern(np.array([0.5, 0.3, 0.26]), np.array([2000, 1300, 1100]), 4096)
    assert value == pytest.approx(max(0.5 * a + 0.3 * b + 0.26 * c for a in range(3) for b in range(4) for c in range(4) if 2000 * a + 1300 * b + 1100 * c <= 4096))
    assert pattern @ [2000, 1300, 1100] <= 4096


def test_cutting_plan_places_every_rank_once():
    edges = packing.length_classes()
    histogram = {c: 1 + c * 7 % 90 for c in range(len(edges))}
    plan, sequences = packing.cutting_plan(histogram, edges)
    ranks, used = defaultdict(list), defaultdict(int)
    for cls, lo, hi, first, per in plan:
        ranks[cls].append((lo, hi))
        for r in range(hi - lo):
            used[first + r // per] += int(edges[cls])
    for cls, n in histogram.items():
        spans = sorted(ranks[cls])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(used) == sequences and max(used.values()) <= 4096
