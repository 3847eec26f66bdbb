"""Nearest neighbours against all distances in double precision."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gaugeline.llm import nearest as N


def plain(rows, k=10, every=5):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def check(spark, rows, k=10, **options):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double")
    got = sorted(map(tuple, N.nearest(df, F.col("vec_id") % 5 == 0, k, **options).collect()))
    want = plain(rows, k)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


def test_random_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 64)
    monkeypatch.setattr(N, "QUERY_TILE", 16)
    rng = random.Random(1)
    centres = [[rng.gauss(0, 3) for _ in range(12)] for _ in range(6)]
    rows = [(k, [c + rng.gauss(0, rng.choice([0.01, 1])) for c in rng.choice(centres)]) for k in range(700)]
    check(spark, rows, block_queries=40)


def test_ties_repeats_scales_and_bad_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(k, [float(k % 3), 1.0]) for k in range(40)] + [(5, [9.0, 9.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    rows += [(100, None), (105, []), (110, [0.0, 0.0]), (115, [nan, 1.0]), (120, [inf, 1.0]), (125, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(200, [1e-200, 2e-200, 0.0]), (201, [3e-200, 0.0, 0.0]), (205, [1e150, 1.0, 0.0]), (300, [5.0])]
    check(spark, rows)


def test_few_rows_and_empty(spark):
    check(spark, [(0, [1.0]), (1, [2.0])])
    check(spark, [(0, [1.0])])
    check(spark, [])


def test_bounds_hold(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 50)) * rng.lognormal(size=(30, 1)), rng.normal(size=(40, 50)) * rng.lognormal(size=(40, 1))
    lower, upper = N.tile_bounds(N.Quantised(a), N.Quantised(b))
    exact = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (lower <= exact).all() and (exact <= upper).all()
