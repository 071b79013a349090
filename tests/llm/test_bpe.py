import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.llm import bpe

SCHEMA = "doc_id long, text string, tokens string, n_tokens string, round_trip int"
TEXTS = [
    "Hello world, it's 2024!", "", " ", "\n\n\n  x", "naïve café 日本語 😀😀", "a" * 3000, "ab " * 2000, "0123456789" * 300, "don't   stop\t\tnow " * 50,
    "<|endoftext|>", "   spaces", "'s't're've", "!?" * 900, " " * 2500, "x́y" * 20,
]


@pytest.fixture(scope="module")
def whole():
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    return tiktoken.Encoding("whole", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (64, 16), (100, 40), (1 << 16, 512)])
def test_chunks_give_the_same_pretokens(chunk, overlap):
    coder = bpe.Codec()
    rng = random.Random(1)
    more = ["".join(rng.choices(["a", "bc ", "  ", "1", "!", "\n", "é", "'ll", " the"], k=400)) for _ in range(40)]
    for text in TEXTS + more:
        assert coder.pretokens(text, chunk, overlap) == coder._split(text)
    assert bpe.Codec(threads=1).pretokens(more[0], chunk, overlap) == coder._split(more[0])


def test_tokens_equal_those_of_the_whole_text_and_decode(spark, whole):
    rng = random.Random(2)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 900), rng.randint(0x4E00, 0x4EFF)])) for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "t", "n", 0) for i, t in enumerate(texts)], SCHEMA)
    encoded = bpe.encode(docs)
    for r in encoded.collect():
        assert r.tokens == whole.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.tokens) and r.round_trip
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == dict(enumerate(texts))


def test_odd_rows(spark, whole):
    long = "one two, three! " * 40_000 + "z" * 100_000
    rows = [(None, "a"), (1, None), (2, ""), (3, long), (3, long)]
    got = bpe.encode(spark.createDataFrame([(*r, "t", "n", 0) for r in rows], SCHEMA)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].tokens is None and by[1].n_tokens is None and by[1].round_trip is None
    assert by[2].tokens == [] and by[2].n_tokens == 0 and by[3].round_trip
    assert by[3].tokens == whole.encode_ordinary(long)
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0
    bad = spark.createDataFrame([(1, [1, 99_999_999], "x"), (2, None, "x"), (3, [], "x")], "doc_id long, tokens array<int>, text string")
    assert {r.doc_id: r.text for r in bpe.decode(bad).collect()} == {1: None, 2: None, 3: ""}


def test_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    coder = bpe.Codec()
    first = [coder.encode(f"word{i}").tolist() for i in range(50)]
    assert len(coder.pieces) <= 10 and first == [coder.encode(f"word{i}").tolist() for i in range(50)]
    assert isinstance(coder.encode("a"), np.ndarray)


CODER = bpe.Codec()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t.!'sé日😀\u00a0"), max_size=120), st.integers(4, 30), st.integers(1, 12))
def test_any_text_any_cut(text, chunk, overlap):
    assert CODER.pretokens(text, chunk, overlap) == CODER._split(text)
    assert CODER.decode_bytes(CODER.encode(text)) == text.encode()
