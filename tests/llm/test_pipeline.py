"""The pipeline: every stage on what the one before kept, against plain versions."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from gaugeline.llm import mixing, quality
from gaugeline.llm.bpe_codec import read_ranks
from test_simhash_pivots import plain_components, plain_print
from test_suffix_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    return " ".join("".join(rng.choice("aeionrstlmdé") for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randrange(30, 150)) for _ in range(120)]
    texts += texts[:10] + [t + " x" for t in texts[10:30]] + [prose(rng, 40) + passage + prose(rng, 40) for _ in range(8)]
    texts += ["too short", "", None, "again and again and again " * 40]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b", None]), len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[4], "en", "b", 1), (None, prose(rng, 50), "en", "b", 2), (None, prose(rng, 50), None, None, None)]


@pytest.fixture(scope="module")
def stages(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [docs.collect()]
    for number, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, "")
        if number < len(P.STAGES) - 1:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept.append(out.collect())
        docs = spark.createDataFrame(kept[-1], out.schema)
    return kept


def test_names_and_order():
    assert [f.__name__ for _, f in P.STAGES] == ["quality_rules", "near_dedup", "repeated_passages", "mix_sources", "encode"]


def test_quality(stages):
    before, after = stages[0], stages[1]
    good = [r for r in before if quality.base_counts(r.text or "")[0] >= 10 and 100 * quality.base_counts(r.text or "")[4] <= 20 * quality.base_counts(r.text or "")[0]]
    assert set(after) <= set(good) and len(after) >= 0.97 * len(good)


def test_near_dedup(stages):
    before, after = stages[1], stages[2]
    # Rows without an id come last; a key of their own stands for them in the plain version.
    order = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    group = plain_components(list(range(len(order))), [plain_print(r.text) for r in order])
    want = {}
    for k, r in enumerate(order):
        want.setdefault(group[k], r)
    assert sorted(map(tuple, after), key=repr) == sorted(map(tuple, want.values()), key=repr)


def test_repeated_passages(stages):
    before, after = stages[2], stages[3]
    # Rows without an id are ordered by a hash of their text; they share no passage here.
    assert len(after) == len(before)
    numbered = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
    plain = {d: (n, gone) for d, n, gone, _, _ in brute(numbered, 100)}
    for r in after:
        if r.doc_id is not None:
            n, gone = plain[r.doc_id]
            assert 0 <= n - gone - len(r.text.encode()) <= 6 and r.n_chars == len(r.text)
            assert gone or any(b.doc_id == r.doc_id and b.text == r.text and (b.lang, b.source) == (r.lang, r.source) for b in before)


def test_mixing(spark, stages):
    before, after = stages[3], stages[4]
    assert 0 < len(after) < len(before) and set(after) <= set(before)
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    sampled = {(r.doc_id, r.n_tokens) for r in mixing.mix(docs).collect() if r.sampled}
    assert {(r.doc_id, len((r.text or "").split())) for r in after} == sampled


def test_encoding(stages):
    before, after = stages[4], stages[5]
    ranks = read_ranks(public_tokenizers.path(P.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id or -1, own.encode_ordinary(r.text or ""), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before)
    assert sorted((r.doc_id or -1, r.ids, r.decoded_sha256) for r in after) == want
    assert all(r.n_tokens == len(r.ids) for r in after)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.count() == 0
    assert P.STAGES[4][1](spark, docs, "").collect() == []
