"""Token counts against the tokenizers library."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gaugeline.llm import token_counts as T

PATH = P.path("word_bpe_49k.json")
PARTS = [
    "a", "th", "E", " ", "  ", "\n", "é", "Ö", "😀", "👍🏽", "!!", "'s", "'S", "The", "ing", "1", "23", "中文", "ß", "\t", "é", "́", "x" * 50, "aaaa", "=-=",
    "İ", "Σ", "ς", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "\x85", "​", "﻿", " ", "\u0000", "ǅ", "ﬁ", "Ⅷ", "½", "_",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts(library, monkeypatch):
    monkeypatch.setattr(T, "MAX_SYMBOLS", 500)
    own, rng = T.WordCounter(PATH), random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 30))) for _ in range(5000)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(3000)), "a" * 10_001, "ab" * 5000, "", "the cat's 42 HATS"]
    assert own.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark, library):
    rows = [(1, "Some text", 1), (1, "Some text", 2), (None, None, None), (2, "", 2), (3, "word " * 3000, 3), (4, "é" * 100, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = []
    for doc_id, text, _ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 2048))
    assert sorted(map(tuple, T.count_tokens(df, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert T.count_tokens(df.limit(0), PATH).collect() == []
