"""Vector codes against the rounds written out in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from gaugeline.llm import vector_codes as V


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = len(kept[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    book = [[list(cut(v)[p]) for _, _, v in first] for p in range(parts)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                part = cut(v)[p]
                groups.setdefault(nearest(part, p)[1], []).append(part)
            better = [list(e) for e in book[p]]
            for k, members in groups.items():
                better[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
            book[p] = better
    out = []
    for i, label, v in kept:
        found = [nearest(part, p) for p, part in enumerate(cut(v))]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, [c for p in book for e in p for c in e]


def check(spark, rows):
    # A clashing column and one named like an internal one never enter.
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, v int")
    compressed = V.compress(df)
    got = [tuple(r) for r in V.with_label_errors(compressed).collect()]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want, book = plain(rows)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(map(str, book)).encode()).hexdigest()
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted([(i, code, error, sums[label], digest) for i, label, code, error in want], key=order)
    return got


def vectors(n, dims=16, seed=1, step=1.0):
    rng = random.Random(seed)
    return [(k, [round(rng.gauss(0, 0.05) / step) * step for _ in range(dims)], rng.choice([None, 1, 2])) for k in range(n)]


def test_against_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 37)
    check(spark, vectors(400, step=1e-3))


def test_ties_and_repeated_rows(spark):
    rows = vectors(60, dims=8, step=0.05)
    check(spark, rows + rows[:30] + [(None, [0.05] * 8, 1), (3, [0.0] * 8, None)])


def test_unusable_rows(spark):
    nan, inf = math.nan, math.inf
    bad = [(100, None, 1), (101, [], 1), (102, [nan] + [0.0] * 15, 1), (-1, [inf] + [0.0] * 15, 1), (104, [None] + [0.0] * 15, 1), (105, [0.0] * 24, 1), (-2, [0.0] * 15, 1)]
    got = check_ids(spark, vectors(40) + bad)
    assert got == list(range(40))


def check_ids(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return sorted(r.vec_id for r in V.compress(df).codes.collect())


def test_fewer_rows_than_entries_and_none(spark):
    got = check(spark, vectors(5))
    assert all(r[2] == 0 for r in got)  # every row is its own entry
    assert check(spark, []) == []
    assert check(spark, [(1, None, 1)]) == []


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="or more after scaling"):
        V.compress(df)


def test_tables_give_exact_distances():
    rng = np.random.default_rng(2)
    rows = rng.integers(-3000, 3000, size=(500, 24))
    book = rng.integers(-3000, 3000, size=(4, 16, 6))
    block = V.Block.unpack(*V.Block.of(rows).pack())
    far = ((rows.reshape(500, 4, 1, 6) - book[None]) ** 2).sum(axis=3)
    nearest, distance = block.assign(book)
    assert (nearest == far.argmin(axis=2)).all() and (distance == far.min(axis=2)).all()
    counts, sums = block.totals(nearest, 16)
    assert counts.sum() == 2000 and (sums.sum(axis=1).ravel() == rows.sum(axis=0)).all()
