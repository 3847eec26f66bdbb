"""Spans against the base patterns read by plain regular expressions, and the trees against plain sums."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import pii as P
from gaugeline.llm.common import Scratch


def luhn(digits):
    total = 0
    for k, x in enumerate(reversed(digits)):
        v = int(x) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


def written(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, kind string, base int")


def check_base(spark, rows):
    got = [r.asDict() for r in P.find(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        spans = base_spans(t)
        count = Counter(s[0] for s in spans)
        want[i, *(count[k] for k in range(4)), hashlib.sha256(written(spans).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    return got


def card(rng, length=16):
    digits = "".join(rng.choice("0123456789") for _ in range(length - 1))
    return next(digits + x for x in "0123456789" if luhn(digits + x))


def person(rng):
    return rng.choice([
        f"anna.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
        card(rng), " ".join(re.findall("....", card(rng))), f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}",
    ])


def corpus(n, seed, numbers=()):
    rng = random.Random(seed)
    words = ["ré", "thé", "ñand", "of", "4.0", "🙂", "a1b2", "3.", "x\ny", "999.1.2.3", "+12 34", *numbers]
    rows = []
    for k in range(n):
        parts = [rng.choice(words) if rng.random() < 0.9 else person(rng) + rng.choice(["", ".", "!!", ","]) for _ in range(rng.randrange(60))]
        rows.append((k, " ".join(parts)))
    return rows


def test_base_spans_of_noise(spark):
    rng = random.Random(5)
    alphabet = ["a", "b.", ".", "@", "@c.d", "-", "+", "1", "23", "255", "256", "00", " ", "(", ")", "\n", "é", "🙂", "4111111111111111", "%", "_", "1.2.3.4", "+1 23"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for k in range(3000)]
    check_base(spark, rows)


def test_whole_corpus_and_added_spans(spark):
    rng = random.Random(7)
    rows = corpus(600, 6)
    number, phone = card(rng), "+1 (212) 555-0199"
    joined = f"und {number} {card(rng)} {phone} 10.20.30.40 x"
    rows += [(1000, joined), (1001, "write anna [at] mail [dot] com now"), (1002, "no 12345678901234567890123 2020-01-02 4.0"), (1003, "a 4242424242424241 b")]
    got = {r["doc_id"]: r for r in check_base(spark, rows)}
    at = joined.index
    assert f"card:{at(number)}:{at(number) + 16}" in got[1000]["spans"] and f"phone:{at(phone)}:{at(phone) + len(phone)}" in got[1000]["spans"]
    assert got[1000]["spans"].count("card:") == 2 and got[1000]["n_added"] == 3
    assert got[1001]["spans"] == f"email:6:{6 + len('anna [at] mail [dot] com')}"
    assert got[1002]["spans"] == "" and got[1003]["spans"] == ""
    for i, t in rows:
        spans = {tuple(s.split(":")) for s in got[i]["spans"].split(",") if s}
        assert spans >= {(P.KINDS[k], str(a), str(b)) for k, a, b in base_spans(t)}
        assert len(spans) == len(base_spans(t)) + got[i]["n_added"]


def test_numbers_that_are_mostly_random_add_nothing(spark):
    rng = random.Random(11)
    number = card(rng)
    rows = corpus(400, 12, numbers=["1234567890123456", "4242424242424241", "9999999999999999"])
    got = {r["doc_id"]: r for r in check_base(spark, [*rows, (1000, f"und {number} 12 x")])}
    assert "card" not in got[1000]["spans"]


def test_null_empty_repeated_and_no_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd"), (4, "\n"), (5, "1.2.3.4")]
    check_base(spark, rows)
    assert P.find(frame(spark, [])).collect() == []
    assert P.find(frame(spark, [(1, "none")])).first().spans == ""


def test_very_long_texts(spark):
    rng = random.Random(8)
    many = " x ".join(person(rng) for _ in range(3000))
    check_base(spark, [(1, many), (2, "a" * 20_000 + "@" * 10), (3, "1" * 20_000), (4, "1 " * 20_000), (5, "+1(" * 20_000), (6, "a.b@" * 20_000), (7, "1." * 20_000)])


def test_time_is_linear_in_the_length(spark):
    texts = ["a" * 1_000_000 + "@", "1" * 1_000_000, "1 " * 500_000, "+1(" * 300_000, "a.b@" * 200_000, "1." * 500_000, "1.2.3.4 " * 100_000, "x@y.zz " * 100_000]
    start = time.monotonic()
    got = {r.doc_id: r for r in P.find(frame(spark, list(enumerate(texts)))).collect()}
    assert got[6].n_ip == 100_000 and got[7].n_email == 100_000
    assert time.monotonic() - start < 90


def test_redacted_texts(spark):
    text = "Aé a.b@c.de, 4111111111111111 🙂 4111111111111111 ends 1.2.3.4"
    got = {r.doc_id: r.text for r in P.redact(frame(spark, [(1, text), (2, None), (3, "plain")])).collect()}
    want = ""
    at = 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in base_spans(text)):
        want += text[at:start] + f"[{P.KINDS[kind].upper()}]"
        at = stop
    assert got == {1: want + text[at:], 2: "", 3: "plain"}


def test_sums_before(spark):
    for n in (1, 2, 255, 256, 257, 1000):
        got = spark.range(1).select(P.sums_before(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("int"))).alias("s")).first().s
        assert got == [k * (k + 1) // 2 for k in range(n)]


def plain_split(rows, model_value):
    """The best split of (f, n, good) rows by trying all."""
    import math

    best = (1e-6, None)
    grads = []
    for f, n, good in rows:
        p = 1 / (1 + math.exp(-model_value(f)))
        grads.append((f, good - n * p, n * p * (1 - p)))
    score = lambda part: sum(g for _, g, _ in part) ** 2 / (sum(h for *_, h in part) + P.RIDGE)
    for feature in range(len(P.FEATURES)):
        for value in sorted({f[feature] for f, *_ in grads})[:-1]:
            left, right = [x for x in grads if x[0][feature] <= value], [x for x in grads if x[0][feature] > value]
            gain = round(score(left) + score(right) - score(grads), 6)
            if gain > best[0]:
                best = (gain, (feature, value))
    return best[1]


def test_trees_take_the_best_splits(spark):
    found = P.candidates(frame(spark, corpus(300, 9)))
    scratch = Scratch(spark, "test-pii")
    model = P.train(scratch.settle(found, "found"), scratch, trees=3)
    rows = [(tuple(r.f), r.n, r.good) for r in scratch.read("features", "held boolean, f array<int>, n long, good long").where("not held").collect()]

    def value(node, f):
        while isinstance(node, P.Split):
            node = node.left if f[node.feature] <= node.bin else node.right
        return node

    assert len(model.trees) == 3
    for k, tree in enumerate(model.trees):
        before = lambda f, k=k: round(model.prior + sum(value(t, f) for t in model.trees[:k]), 6)
        assert plain_split(rows, before) == (tree.feature, tree.bin)
        for side, child in ((True, tree.left), (False, tree.right)):
            part = [r for r in rows if (r[0][tree.feature] <= tree.bin) == side]
            assert plain_split(part, before) == ((child.feature, child.bin) if isinstance(child, P.Split) else None)


def test_thresholds_hold_the_precision(spark):
    scratch = Scratch(spark, "test-pii")
    found = scratch.settle(P.candidates(frame(spark, corpus(400, 10))), "found")
    model = P.train(found, scratch)
    held = found.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).select(F.inline("found"))
    rows = held.select("kind", model.step(F.col("f")).alias("step"), "valid").collect()
    for k, least in enumerate(model.thresholds):
        mine = [(r.step, r.valid) for r in rows if r.kind == k]
        share = {t: sum(v for s, v in mine if s >= t) / sum(1 for s, _ in mine if s >= t) for t in {s for s, _ in mine}}
        good = [t for t, x in share.items() if x >= P.PRECISION]
        assert least == (min(good) if good else P.STEPS + 1)


@pytest.mark.parametrize("kind", P.KINDS)
def test_plans_hold_no_python(spark, kind):
    plan = P.candidates(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")
