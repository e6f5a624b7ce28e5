import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import token_counts
from tidemark.llm.tokens import default_path

PATH = default_path("piece_bpe_32k.model")


def library(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.BLANK, prepend_scheme="always", split=True)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def own():
    return token_counts.Counter(token_counts.read_vocabulary(PATH))


def test_counts_are_the_tokenizers(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = dict(zip([d.doc_id for d in docs], library(token_counts.read_vocabulary(PATH))([d.text or "" for d in docs]), strict=True))
    assert {r.doc_id: r.n_tokens for r in token_counts.op7_token_counts(spark, "/root/testdata/sf0.001").collect()} == want


def test_random_texts(own):
    rng = random.Random(4)
    bits = ["a", "the", " ", "  ", "\n", "é", "\U0001f600", "日本", "xqz", "1", "<0x0A>", "<s>", "<unk>", token_counts.BLANK, "ing", ".", "\t", "\x00", "Ω", "ˮ"]
    texts = ["", " ", "a", " a", "a "] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert own.counts(pa.array(texts)).tolist() == library(token_counts.read_vocabulary(PATH))(texts)


def test_ties_follow_the_library():
    rng = random.Random(6)
    base = [(f"<0x{b:02X}>", -50.0) for b in range(256)]
    for _ in range(30):  # whole scores make many equal paths
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(10)}
        vocabulary = [("<unk>", 0.0), *base, *((p, -float(rng.randint(1, 4))) for p in sorted(pieces))]
        texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))) for _ in range(80)]
        assert token_counts.Counter(vocabulary).counts(pa.array(texts)).tolist() == library(vocabulary)(texts)


def test_odd_rows(spark, odd, odd_rows, nothing):
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd, PATH).collect())
    want = library(token_counts.read_vocabulary(PATH))([t or "" for _, t in odd_rows])
    assert got == Counter((i, n) for (i, _), n in zip(odd_rows, want, strict=True))
    assert token_counts.count_tokens(nothing, PATH).count() == 0


def test_counts_are_not_the_bpe_of_the_file(own):
    """The figures that the README gives for the distance between this unigram model and the file's own encoding."""
    import pyarrow.parquet as pq
    import sentencepiece

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    bpe = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)]
    unigram = own.counts(pa.array(texts)).tolist()
    readme = (Path(__file__).resolve().parents[2] / "README.md").read_text()
    assert f"{sum(a != b for a, b in zip(unigram, bpe, strict=True))} of {len(texts)} documents" in readme
    assert f"{sum(unigram):,} pieces against {sum(bpe):,}" in readme
