"""Ordinal regression: held-out accuracy, order of thresholds, gradients, odd inputs."""

import math
import random

import numpy as np
import pytest

from gaugeline.llm import toxicity as T

BAD = ["vile", "rotten", "filthy", "wretched"]
GOOD = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        grade = rng.choice([0, 0, 0, 1, 2, 3])
        words = [rng.choice(GOOD) for _ in range(rng.randrange(20, 80))] + rng.sample(BAD, grade)
        rng.shuffle(words)
        rows.append((k, " ".join(words) + ".", grade))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(2400)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t, _ in rows], "doc_id long, text string, words string, label int")
    labels = spark.createDataFrame([(k, int(g > 0), 1) for k, _, g in rows[:2000]], "doc_id long, toxic int, quality int")
    model = T.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    held = rows[2000:]
    assert sum(got[k].toxic == (g > 0) for k, _, g in held) >= 0.95 * len(held)
    mean = [np.mean([got[k].expected_severity for k, _, g in held if g == j]) for j in range(4)]
    assert mean == sorted(mean)
    for r in got.values():
        assert 0 <= r.expected_severity <= T.GRADES and r.p_toxic <= r.expected_severity + 1e-9


def test_given_grades(spark):
    rows = corpus(600, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, g) for k, _, g in rows[:400]], "doc_id long, grade int")
    got = {r.doc_id: r.grade for r in T.score(docs, T.train(docs, labels)).collect()}
    assert np.mean([abs(got[k] - g) for k, _, g in rows[400:]]) < 0.2


def test_fit_lowers_the_loss():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(400)]
    truth = rng.normal(size=30) * 2
    score = np.array([truth[r].sum() for r in rows])
    grades = (score[:, None] > np.array([-1.0, 1.0, 3.0])).sum(axis=1)
    weights, theta = T.fit(rows, grades, 30, 3)
    guess = (np.array([weights[r].sum() for r in rows])[:, None] > theta).sum(axis=1)
    assert (guess == grades).mean() > 0.95


def plain_loss(rows, grades, weights, theta, ridge):
    """The cumulative-link loss, one row after another."""
    total = 0.0
    for row, grade in zip(rows, grades, strict=True):
        score = sum(weights[k] for k in row)
        above = [1.0, *(1 / (1 + math.exp(t - score)) for t in theta), 0.0]
        total -= math.log(above[grade] - above[grade + 1])
    return total / len(rows) + ridge / 2 * sum(w * w for w in weights)


def test_fit_reaches_the_least_loss_of_the_plain_likelihood():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, 4)) for _ in range(200)]
    truth = rng.normal(size=12)
    noise = rng.logistic(size=200)
    grades = (np.array([truth[r].sum() for r in rows])[:, None] + noise[:, None] > np.array([-1.0, 0.5, 2.0])).sum(axis=1)
    ridge = 1e-2
    weights, theta = T.fit(rows, grades, 12, 3, ridge=ridge, steps=2000)
    assert (np.diff(theta) > 0).all()
    point = np.concatenate([weights, theta])
    loss = lambda p: plain_loss(rows, grades, p[:12], p[12:], ridge)
    # Finite differences: no slope is left in any weight or threshold.
    step = 1e-5
    slopes = [(loss(point + step * e) - loss(point - step * e)) / (2 * step) for e in np.eye(15)]
    assert np.abs(slopes).max() < 2e-3
    # And no nearby or random point is better.
    least = loss(point)
    for size in (1e-2, 0.1, 1.0):
        for _ in range(40):
            other = point + rng.normal(size=15) * size
            other[12:] = np.sort(other[12:])
            assert loss(other) >= least - 1e-6


def test_scores_against_plain_sums(spark):
    model = T.Ordinal({"bad": 2.0, "^rotten": 0.5, "rottenly": 1.5, "good": -1.0}, np.array([1.0, 2.0, 4.0]))
    texts = ["bad bad", "Rottenly good", "rotten", "", None, "BAD rottenly, good!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sums = [2.0, 1.0, 0.0, 0.0, 0.0, 3.0]
    for r in T.score(docs, model).collect():
        above = [1 / (1 + math.exp(t - sums[r.doc_id])) for t in (1.0, 2.0, 4.0)]
        chances = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert r.expected_severity == pytest.approx(sum(above)) and r.p_toxic == pytest.approx(above[0])
        assert r.grade == chances.index(max(chances)) and r.toxic == (above[0] >= 0.5)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "word"), (3, "word " * 200_000), (3, "word")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.expected_severity for r in T.score(docs, T.train(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 0)], "doc_id long, toxic int")
    got = T.score(docs, T.train(docs, one, min_docs=1)).collect()
    assert len(got) == 5 and all(math.isfinite(r.expected_severity) for r in got)
    assert T.score(docs.limit(0), T.train(docs.limit(0), one)).collect() == []
