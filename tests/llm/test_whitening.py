"""Whitening against a plain fit in exact integers and the library's eigenvectors."""

import math
import random

import numpy as np
import pytest

from gaugeline.llm import whitening as W


def plain(rows, scale=64, offset=1_000_000):
    kept = [(i, tuple(math.floor(scale * x) + offset for x in v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted({x for _, x in kept})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    away = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], dtype=object).astype(float) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1], away.T @ away / n


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, n int, x double")
    return [r.asDict() for r in W.whiten(df, **options).collect()]


def check(spark, rows, components=16):
    got = run(spark, rows)
    kept, n, sums, values, vectors, covariance = plain(rows)
    values = values[values > 1e-12 * values[0]][:components]
    assert len(got) == len(kept) * len(values)
    by_id = {}
    for r in got:
        by_id.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-8
        assert math.isclose(r["explained"], values[r["component"] - 1] / np.trace(covariance), rel_tol=1e-9)
    signs = None
    for i, x in kept:
        away = [n * a - s for a, s in zip(x, sums, strict=True)]
        mine = by_id[i, sum(a * a for a in away)]
        want = (np.array(away, dtype=float) / n) @ vectors[:, : len(values)] / np.sqrt(values)
        have = np.array([mine[k]["whitened"] for k in range(1, len(values) + 1)])
        if signs is None:
            signs = np.zeros(len(values))
        # The sign of a component is free but the same for all rows.
        fresh = (signs == 0) & (np.abs(want) > 1e-6)
        signs[fresh] = np.sign(have[fresh] * want[fresh])
        assert np.allclose(have, want * np.where(signs == 0, 1, signs), atol=1e-6)


def vectors(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims)) * np.linspace(1, 3, dims)
    return [(k, [float(x) for x in rng.normal(size=dims) @ mix]) for k in range(n)]


def test_against_library(spark):
    check(spark, vectors(500, 24))


def test_repeats_count_once_and_bad_rows_go(spark):
    nan = math.nan
    rows = vectors(120, 6)
    bad = [(500, None), (501, []), (502, [nan] * 6), (503, [math.inf] + [0.0] * 5), (504, [None] + [0.0] * 5)]
    check(spark, rows + rows[:50] + [(900 + k, rows[0][1]) for k in range(100)] + bad)
    assert {r["vec_id"] for r in run(spark, rows + [(600, [1.0] * 5)])} == set(range(120))


def test_few_ranks_equal_rows_and_none(spark):
    check(spark, vectors(4, 20))
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []


def test_independent_of_partitioning(spark):
    rows = vectors(300, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, W.whiten(df.repartition(k)).collect())) for k in (1, 13))
    # The fit is exact; only the identity error is summed in floating point.
    assert [r[:6] for r in one] == [r[:6] for r in many]


@pytest.mark.parametrize("dims", [8, 24, 64])
def test_rows_do_not_depend_on_their_block(dims):
    rng = np.random.default_rng(dims)
    rows = rng.integers(999_000, 1_001_000, (300, dims))
    centred = rows - rows.mean(axis=0)
    values, components = W.leading_components(centred.T @ centred / len(rows), 16)
    model = W.Whitening(len(rows), rows.sum(axis=0).tolist(), None, values, components)
    whole = model.whiten(rows)
    for size in (1, 2, 3, 7, 23, 64):
        assert (np.concatenate([model.whiten(rows[k : k + size]) for k in range(0, len(rows), size)]) == whole).all()


@pytest.mark.parametrize("name", ["random", "identity", "repeated", "graded", "ones", "blocks", "tiny", "huge", "near identity"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_components(name, n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    a = a @ a.T
    matrix = {
        "random": a, "identity": np.eye(n), "repeated": np.diag(np.repeat([3.0, 1.0], n)[:n]), "graded": np.diag(10.0 ** -np.arange(min(n, 10)).repeat(n)[:n]),
        "ones": np.ones((n, n)) + np.eye(n) / 2, "blocks": np.kron(np.eye(2), a), "tiny": a * 1e-200, "huge": a * 1e200, "near identity": np.eye(n) + 1e-13 * a,
    }[name]
    values, vectors = W.leading_components(matrix, 16)
    size = np.abs(matrix).max()
    want = np.linalg.eigvalsh(matrix / size)[::-1][:16]
    assert np.abs(values / size - want).max() < 1e-12
    assert np.abs(matrix / size @ vectors - vectors * (values / size)).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12


def test_sturm_counts():
    rng = random.Random(4)
    diagonal, off = np.array([rng.gauss(0, 1) for _ in range(12)]), np.array([rng.choice([0.0, rng.gauss(0, 1)]) for _ in range(11)])
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-4, 4, 101)
    assert (W.sturm_counts(diagonal, off, at) == (values[None, :] < at[:, None]).sum(axis=1)).all()


def test_large_integers_stay_exact():
    rows = np.array([[1 << 39, 3], [-(1 << 39), 5], [7, 1 << 38]])
    assert (W.exact_moments(rows) == rows.astype(object).T @ rows.astype(object)).all()
    rows = np.array([[1 << 20, 3], [5, -(1 << 20)]] * 5000)
    assert (W.exact_moments(rows) == rows.astype(object).T @ rows.astype(object)).all()
    model = W.Whitening(4, [0, 0], np.eye(2), np.ones(2), np.eye(2))
    assert model.deviations(np.array([[1 << 39, 0], [3, 1]])) == [None, 160]
