"""Base rules and the language model against plain computations."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from gaugeline.llm import quality as Q


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = set()
    for k in range(len(words) - 4):
        if windows[tuple(words[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def plain_model(rows, order):
    """Modified Kneser-Ney over characters by dictionaries; returns p(lang, gram)."""
    levels = {order: Counter()}
    for text, lang in rows:
        padded = "\0" * (order - 1) + (text or "")
        for k in range(len(padded) - order + 1):
            if padded[k + order - 1] != "\0":
                levels[order][lang, padded[k : k + order]] += 1
    for k in range(order - 1, 0, -1):
        levels[k] = Counter((lang, gram[1:]) for lang, gram in levels[k + 1])
    cut = {}
    for k, level in levels.items():
        n = [0, *(sum(c == m for c in level.values()) for m in range(1, 5))]
        y = n[1] / (n[1] + 2 * n[2]) if all(n[1:]) else None
        cut[k] = [0.5, 1.0, 1.5] if y is None else [min(max(m - (m + 1) * y * n[m + 1] / n[m], 0.05), m) for m in (1, 2, 3)]
    contexts = {k: defaultdict(list) for k in levels}
    for k, level in levels.items():
        for (lang, gram), c in level.items():
            contexts[k][lang, gram[:-1]].append(c)

    def p(lang, gram):
        k = len(gram)
        counts = contexts[k][lang, gram[:-1]]
        lower = 1 / (len(counts) + 1) if k == 1 else p(lang, gram[1:])
        c = levels[k][lang, gram]
        weight = sum(cut[k][min(m, 3) - 1] for m in counts) / sum(counts)
        return (c - cut[k][min(c, 3) - 1]) / sum(counts) + weight * lower

    return p


def sample(rng, n, letters="aaabbcde fgh\n"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_base_counts():
    rng = random.Random(1)
    texts = ["", " \n\n ", "a a a a a a a", "x#*$%&|<>\n x#*$%&|<>\nx#*$%&|<>", "a\x1cb c d\n\t\na\x1cb c d", "é ü\x85z"]
    texts += [sample(rng, rng.randrange(0, 400), "ab  c\n#") for _ in range(200)]
    for text in texts:
        assert Q.base_counts(text) == plain_base(text), text


@pytest.mark.parametrize("order", [2, 4])
def test_perplexity(spark, order):
    rng = random.Random(order)
    rows = [(k, sample(rng, rng.randrange(0, 300)), rng.choice(["en", "de", None, ""])) for k in range(60)]
    rows += [(90, None, "en"), (91, "", "fr"), (92, "z", "fr")]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=order).collect()}
    p = plain_model([(t, x) for _, t, x in rows], order)
    for doc_id, text, lang in rows:
        padded = "\0" * (order - 1) + (text or "")
        logs = [math.log(p(lang, padded[k : k + order])) for k in range(len(text or ""))]
        assert got[doc_id].perplexity == pytest.approx(math.exp(-sum(logs) / max(1, len(logs))), rel=1e-2)
        words, chars, symbols, dup, repeated = plain_base(text or "")
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, dup, repeated)
        assert r.base_failed == (words < 10 or 100 * repeated > 20 * words)
        assert not (r.base_failed and r.kept)


def test_counts_are_exact_and_parts_add_up(spark):
    rng = random.Random(6)
    rows = [(k, sample(rng, 200, "abcdefgh\u4e00\u4e01\U0001f600 "), rng.choice(["en", "de", None, ""])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = Counter()
    for _, text, lang in rows:
        padded = "\0" * 3 + text
        want.update(("" if lang is None else "=" + lang, padded[k : k + 4]) for k in range(len(text)))
    for bits in (4, 22):
        assert {(r.lang, r.gram): r.c for r in Q.count_grams(docs, 4, bits).collect()} == want
    whole, parts = ({r.doc_id: r.perplexity for r in Q.judge(docs, entries=n).collect()} for n in (1 << 21, 3000))
    assert parts == pytest.approx(whole, rel=1e-9)


def test_unseen_characters_back_off(spark):
    import numpy as np

    rows = [(sample(random.Random(5), 4000), "en")]
    model = Q.train(spark.createDataFrame(rows, "text string, lang string"), order=3)
    batch = Q.Batch(["abcab", "aßß", "zz"], ["en", "en", "xx"], 3, Q.SLOT_BITS)
    logs = model.log_probabilities(batch)
    assert np.isfinite(logs).all() and (logs < 0).all()
    assert logs[5:8].mean() < logs[:5].mean()


def test_bands_reject_what_stands_out_and_keep_the_rest(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(sample(rng, 6, "aeiou" + "nrst" * 2) for _ in range(150)), "en") for k in range(200)]
    rows += [(1000 + k, " ".join(sample(rng, 6, "QXZ$%&#@!WVJK") for _ in range(150)), "en") for k in range(3)]
    rows += [(2000, " ".join(sample(rng, 6, "QXZJ") for _ in range(150)), "tiny")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, nll string, slot int")
    got = {r.doc_id: r.kept for r in Q.judge(df).collect()}
    assert sum(got[k] for k in range(200)) >= 198
    assert not any(got[1000 + k] for k in range(3))
    assert got[2000]


def test_copies_of_one_text_do_not_make_the_band(spark):
    rng = random.Random(9)
    texts = {lang: [" ".join(sample(rng, 6, letters) for _ in range(300)) for _ in range(40)] for lang, letters in (("en", "aeiounrst"), ("de", "bcdfgaeiou"))}
    rows = [(k, t, lang) for lang, own in texts.items() for k, t in enumerate(own, 100 if lang == "de" else 0)]
    rows += [(1000 + k, texts["de"][0], "de") for k in range(400)]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert sum(got[100 + k].kept for k in range(40)) >= 38
    alone = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows[:80], "doc_id long, text string, lang string")).collect()}
    for k in alone:
        assert got[k].perplexity == pytest.approx(alone[k].perplexity, rel=1e-9)
        assert (got[k].lower, got[k].upper) == pytest.approx((alone[k].lower, alone[k].upper), rel=1e-9)


def test_deviation_of_a_language_is_shrunk_to_the_common_one(spark):
    rows = [("a", k, (k % 101) / 100) for k in range(2020)] + [("b", k, 5.0) for k in range(400)] + [("c", 1, 9.0), (None, 2, 3.0)]
    rows += [("b", 7, 5.0)] * 50
    got = {r.lang: r for r in Q.bands(spark.createDataFrame([(*r, False) for r in rows], "lang string, same long, nll double, base_failed boolean")).collect()}
    common = got["c"].spread * 21 / 20
    assert got["a"].spread > 0 and got["b"].spread == pytest.approx(common * Q.FLOOR) and got[None].spread == pytest.approx(got["c"].spread)
    assert got["b"].middle == 5.0 and got["c"].middle == 9.0


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
