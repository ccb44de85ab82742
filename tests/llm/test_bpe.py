import random

import pytest
import tiktoken

from foliant.llm import bpe as B
from tests.helpers import frame


@pytest.fixture(scope="module")
def both():
    import base64

    data = B.read_ranks(B.DEFAULT_TOKENIZER)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return B.Encoder(data), tiktoken.Encoding("own", pat_str=B.PRETOKEN, mergeable_ranks=ranks, special_tokens={})


def test_against_the_public_library(both):
    mine, theirs = both
    rng = random.Random(2)
    alphabet = list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0​aabzéñ'sT01½²🚀👩_.,;!?<|>") + ["　", " ", " ", "'ll", "<|endoftext|>", "the ", "  ", "ﬁ", "नमस्ते", "\r\n"]
    for _ in range(5000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert mine.encode(text) == theirs.encode_ordinary(text), repr(text)


def test_long_runs(both):
    mine, theirs = both
    for text in ("a" * 20_000, "ab" * 9_000, "\n" * 5_000 + "x", "é" * 4_000, "the quick " * 20_000):
        assert mine.encode(text) == theirs.encode_ordinary(text)


def test_segment_tree_finds_the_leftmost_minimum():
    rng = random.Random(4)
    values = [rng.randint(0, 9) for _ in range(37)]
    tree = B.SegmentTree(values)
    for _ in range(300):
        low = min(values)
        assert tree.leftmost() == (low, values.index(low))
        i = rng.randrange(37)
        values[i] = rng.randint(0, 9)
        tree.set(i, values[i])


def test_table(spark, both):
    given = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (4, "<|endoftext|>", "x")]
    found = B.encode_corpus(frame(spark, "doc_id long, text string, ids string", given)).collect()
    expected = [(k, both[1].encode_ordinary(t or "")) for k, t, _ in given]
    assert sorted((str(r.doc_id), list(r.ids)) for r in found) == sorted((str(k), v) for k, v in expected)
    assert B.encode_corpus(frame(spark, "doc_id long, text string", [])).collect() == []
    counts = B.token_counts(frame(spark, "doc_id long, text string, n_tokens int", [(a, b, 0) for a, b, _ in given]), ["doc_id"]).collect()
    assert sorted(r.n_tokens for r in counts) == sorted(len(v) for _, v in expected)
