"""Repeated byte strings against a brute-force search."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import suffix_dedup as S


def brute(rows, match):
    """rows: (doc_id, text) in order of rank."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - match + 1):
            s = data[k : k + match]
            if s in seen:
                gone[k : k + match] = b"\1" * match
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, match, schema="doc_id long, text string", **options):
    df = spark.createDataFrame(rows, schema)
    kept = S.remove_repeats(df, match, **options)
    got = kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted(map(tuple, got), key=repr)


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n))


@pytest.mark.parametrize("period", sorted(S.COVERS))
def test_covers_hold_every_distance(period):
    cover = S.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("match,passes", [(24, 1), (60, 2), (100, 4)])
def test_random_texts(spark, match, passes, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 900)
    rng = random.Random(match)
    shared = [words(rng, 60) + "ä" * k for k in range(4)]
    rows = []
    for k in range(80):
        text = words(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 2)
            text += s[a : a + rng.randrange(10, 200)] + rng.choice(["", "x", words(rng, 5)])
        rows.append((1000 - 3 * k, text))
    rows.append((2000, rows[5][1]))
    rows.append((2001, rows[5][1] + rows[6][1]))
    assert run(spark, rows, match, passes=passes) == sorted(brute(rows, match), key=repr)


def test_edges(spark):
    long = words(random.Random(1), 400)
    rows = [(None, long), (3, None), (4, ""), (5, long[:99]), (6, long[50:150]), (7, "a" * 500), (8, "a" * 99), (9, "é" * 120), (10, long), (2, "x")]
    assert run(spark, rows, 100) == sorted(brute(rows, 100), key=repr)
    assert run(spark, [], 100) == []


def test_repeated_rows_and_clashing_columns(spark):
    text = words(random.Random(2), 200)
    rows = [(1, text, "p", 1), (1, text, "q", 2), (1, text, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, places int")
    got = S.remove_repeats(df, carry=["block", "places"]).collect()
    assert sorted(r.n_removed for r in got) == [0, len(text), len(text)]
    assert sorted(r.carried for r in got) == ['{"block":"p","places":1}', '{"block":"q","places":2}', "{}"]
