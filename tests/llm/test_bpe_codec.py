"""Encoding against the tiktoken library; decoding as a stream."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from gaugeline.llm import bpe_codec as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "th", "e", " ", "  ", "\n", "é", "ö", "😀", "👍🏽", "!!", "'s", "The", "ing", "1", "23", "中文", "ß", "\t", "̀", "x" * 50, "aaaa", "=-=", "łą"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module", params=[100_000, 50, 2])
def codec(request):
    own = B.Codec(B.read_ranks(PATH), P.PATTERN)
    own.transducer.max_states = request.param
    return own


def test_random_texts(library, codec):
    rng = random.Random(1)
    for k in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 30)))
        if k % 3 == 0:
            text = "".join(chr(rng.choice([rng.randrange(97, 123), rng.randrange(0x20, 0x3000)])) for _ in range(60))
        ids = codec.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert "".join(codec.decode_text(ids)) == text


def test_long_pieces_keep_states_short(library):
    own = B.Codec(B.read_ranks(PATH), P.PATTERN)
    rng = random.Random(2)
    for text in ["".join(rng.choice("abcdefghijkl") for _ in range(50_000)), "ab" * 30_000 + "a" * 30_001, " " * 20_000, "é" * 10_000]:
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    longest = max(map(len, own.transducer.names))
    assert max(map(own.transducer.open_bytes, range(len(own.transducer.states)))) <= 2 * longest


def test_stream_of_bytes():
    rng = random.Random(3)
    for k in range(2000):
        data = "".join(rng.choice(PARTS) for _ in range(8)).encode() if k % 2 else bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0xFF]) for _ in range(8))
        stream, text, at = B.Utf8Stream(), "", 0
        while at < len(data):
            step = rng.randrange(1, 4)
            text += stream.feed(data[at : at + step])
            at += step
        assert text + stream.close() == data.decode("utf-8", "replace")


def test_rows(spark, library):
    rows = [(1, "some text", 1), (1, "some text", 1), (None, None, None), (2, "", 2), (3, "word " * 100_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = B.round_trip_digests(df, PATH, P.PATTERN, keep_ids=True).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    texts = B.decode_documents(B.encode_documents(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.text for r in texts)) == sorted(t or "" for _, t, _ in rows)
    assert B.round_trip_digests(df.limit(0), PATH, P.PATTERN).collect() == []
