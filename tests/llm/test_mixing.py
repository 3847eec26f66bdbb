"""Raking against a plain implementation, marginals of the sample, odd inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import mixing as M


def plain_rake(cells, targets, sweeps=500):
    """cells: {(a, b, c): tokens}; targets: one dictionary per dimension."""
    factor = dict.fromkeys(cells, 1.0)
    for _ in range(sweeps):
        for d, target in enumerate(targets):
            sums = {}
            for key, n in cells.items():
                sums[key[d]] = sums.get(key[d], 0.0) + factor[key] * n
            for key in cells:
                factor[key] *= target[key[d]] / sums[key[d]]
    return factor


def test_factors(spark):
    rng = random.Random(1)
    cells = {k: rng.randrange(1, 5000) for k in itertools.product("abcd", ["en", "de", "fr"], ["0", "1"]) if rng.random() < 0.9}
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 1, "b": 2, "c": 3, "d": 4, "gone": 7}, "lang": {"en": 0.5, "de": 0.25, "fr": 0.25}, "topic": {"0": 0.6, "1": 0.4}}
    got = {(r.source, r.lang, r.topic): r.factor for r in M.rake(df, targets=targets, tolerance=1e-12, sweeps=60).collect()}
    want = plain_rake(cells, [{k: v / 10 for k, v in targets["source"].items()}, targets["lang"], targets["topic"]])
    assert got == pytest.approx(want, rel=1e-6)


def sparse_cells(spark, n=40):
    """A chain of cells, each sharing a source or a language with the next: raking converges slowly."""
    rng = random.Random(2)
    rows = [(f"s{k}", f"l{k}", "0", rng.randrange(1, 5000)) for k in range(n)] + [(f"s{k}", f"l{k + 1}", "1", rng.randrange(1, 5000)) for k in range(n - 1)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def test_the_miss_is_that_of_the_marginals_and_is_reported(spark):
    cells = sparse_cells(spark)
    with pytest.warns(RuntimeWarning, match="off its target"):
        got = M.rake(cells, sweeps=3, tolerance=1e-6)
    rows, misses = got.collect(), []
    for d in M.DIMENSIONS:
        for category in {r[d] for r in rows}:
            own = [r for r in rows if r[d] == category]
            misses.append(abs(sum(r.factor * r.tokens for r in own) - own[0][f"{d}_target"]))
    assert M.worst_miss(got, M.DIMENSIONS) == pytest.approx(max(misses), rel=1e-9) and max(misses) > 1e-6


def corpus(spark, n=4000):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        source = rng.choice(["hot"] * 6 + ["b", "c", None])
        lang = rng.choice(["en"] * 3 + ["de", None])
        rows.append((k, " ".join(rng.choice(["aa bb", "cc dd", "ee"]) for _ in range(rng.randrange(1, 40))), source, lang, rng.randrange(3)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")


def test_sample_has_the_target_marginals(spark):
    docs = corpus(spark)
    got = M.mix(docs, topics=docs).toPandas()
    assert len(got) == 4000 and got.probability.max() == 1.0
    for d in ("source", "lang", "topic"):
        tokens = got.groupby(got[d].astype("string").fillna("none")).n_tokens.sum().astype(float) ** M.TEMPERATURE
        expected = (got.n_tokens * got.probability).groupby(got[d].astype("string").fillna("none")).sum()
        sampled = (got.n_tokens * got.sampled).groupby(got[d].astype("string").fillna("none")).sum()
        want = tokens / tokens.sum()
        assert np.allclose(expected / expected.sum(), want, atol=1e-4)
        assert np.allclose(sampled / sampled.sum(), want, atol=0.03)


def test_topics_are_fitted_on_all_documents(spark):
    """The second kind of text is in none of the 2,000 documents of smallest hash, and has a cluster of its own."""
    kinds = [(k, f"{rng.choice(['alpha beta', 'gamma delta'])} common words") for rng in [random.Random(4)] for k in range(3000)]
    docs = spark.createDataFrame(kinds, "doc_id long, text string")
    by = docs.withColumn("by", F.xxhash64(F.lit(M.SEED), "doc_id", F.lit("omega psi chi"))).orderBy(F.desc("by")).limit(40).select("doc_id")
    rare = by.withColumn("rare", F.lit(True))
    made = docs.join(rare, "doc_id", "left").select("doc_id", F.when(F.col("rare"), "omega psi chi").otherwise(F.col("text")).alias("text"), F.coalesce("rare", F.lit(False)).alias("rare"))
    rows = M.with_topics(made, topics=3).collect()
    assert len({r.topic for r in rows if r.rare}) == 1 and not {r.topic for r in rows if r.rare} & {r.topic for r in rows if not r.rare}


def test_topics_cover_all_rows_and_repeat(spark):
    docs = corpus(spark, 300).drop("topic")
    a, b = (sorted(map(tuple, M.mix(docs).collect()), key=repr) for _ in range(2))
    assert a == b and len(a) == 300


def test_edges(spark):
    rows = [(1, None, None, None), (1, "", "a", "en"), (None, "one two", "a", None), (None, "one two", "a", None), (2, "x " * 300_000, None, "de")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, lang string, tokens int, factor int")
    got = M.mix(docs).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got)
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 2, 300_000]
    assert M.mix(docs.limit(0)).collect() == []
    assert M.mix(docs.where(F.col("doc_id") == 1)).count() == 2


def test_joins_and_arrays_give_the_same_factors(spark, monkeypatch):
    rng = random.Random(7)
    cells = spark.createDataFrame([(s, x, t, rng.randrange(1, 900)) for s in "abcd" for x in ("en", "de") for t in "01"], "source string, lang string, topic string, tokens long")
    for size in (None, 2000.0):
        start = M.with_targets(cells, M.DIMENSIONS, None, 0.7, M.Scratch(spark, "test"))
        found = []
        for most in (1 << 18, 0):
            monkeypatch.setattr(M, "LOCAL_CELLS", most)
            rows, miss = M.fit_factors(start, M.DIMENSIONS, 30, 1e-9, M.Scratch(spark, "test"), size)
            assert miss <= 1e-9
            found.append({(r.source, r.lang, r.topic): r.factor for r in rows.collect()})
        assert found[0] == pytest.approx(found[1], rel=1e-9)


def test_a_rare_cell_does_not_set_the_size(spark):
    """One cell of a single document with four tokens: the sample stays as large as the categories allow."""
    rng = random.Random(8)
    rows = [(k, "w " * rng.randrange(10, 40), rng.choice(["a", "a", "b"]), rng.choice(["en", "en", "de"]), rng.randrange(2)) for k in range(2000)]
    rows += [(5000, "one two three four", "a", "de", 2)] + [(6000 + k, "w " * 30, "b", "en", 2) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")
    got = M.mix(docs, topics=docs).toPandas()
    share = (got.n_tokens * got.probability).sum() / got.n_tokens.sum()
    assert share > 0.4 and got.probability.max() == 1.0
    for d in ("source", "lang", "topic"):
        tokens = got.groupby(d).n_tokens.sum().astype(float) ** M.TEMPERATURE
        expected = (got.n_tokens * got.probability).groupby(got[d]).sum()
        assert np.allclose(expected / expected.sum(), tokens / tokens.sum(), atol=1e-5)
    half = M.mix(docs, topics=docs, share=0.2).toPandas()
    assert (half.n_tokens * half.probability).sum() / half.n_tokens.sum() == pytest.approx(0.2, rel=1e-4)


def test_targets_in_conflict_keep_a_sample_and_are_reported(spark):
    """Topic 1 stands in English only, but for one word: the targets of languages and topics hold together in a handful of tokens."""
    rows = [(k, "w " * 20, "a", "en", 0) for k in range(100)] + [(1000 + k, "w " * 20, "a", "en", 1) for k in range(900)]
    rows += [(3000 + k, "w " * 20, "a", "de", 0) for k in range(100)] + [(4000, "w", "a", "de", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")
    with pytest.warns(RuntimeWarning, match="off its target"):
        got = M.mix(docs, topics=docs, targets={"lang": {"en": 0.5, "de": 0.5}, "topic": {"0": 0.2, "1": 0.8}}).toPandas()
    assert (got.n_tokens * got.probability).sum() / got.n_tokens.sum() > 0.05
