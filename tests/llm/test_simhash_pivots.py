"""Fingerprints and components against a plain computation over all pairs."""

import random
import re
import tracemalloc

import numpy as np
import xxhash

from gaugeline.llm import simhash_pivots as S


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    values = np.array(prints, dtype=np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius) + k + 1:
            a, b = find(k), find(int(j))
            root[max(a, b)] = min(a, b)
    best = {}
    for k, i in enumerate(ids):
        if i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return [best.get(find(k)) for k in range(len(ids))]


def check(spark, rows, schema="doc_id long, text string"):
    got = S.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    prints = [plain_print(r[1]) for r in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, plain_components([r[0] for r in rows], prints))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_texts(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["Ab", "b", "ÄC", "dd", "E1", "f\t", "g\n"]) for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    rows = []
    for k in range(400):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        rows.append((k * 7 % 401, " ".join(words)))
    check(spark, rows)


def test_edges(spark):
    check(spark, [(5, None), (4, ""), (9, " \n\t"), (3, "one"), (2, "One"), (None, "two words"), (None, "two words"), (8, "a b c"), (8, "a b c"), (7, "z " * 70_000)])
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string, print int, cell string")).collect() == []


def test_long_texts_are_taken_in_runs():
    rng = random.Random(7)
    text = "".join(rng.choice(["Ab", "b", "\u00c4C", "dd", "E1"]) + rng.choice([" ", "\t", " \n "]) for _ in range(400_000))
    tracemalloc.start()
    got = S.fingerprint(text.encode())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == plain_print(text)
    # The words and their places, held whole, were some 45 MB.
    assert most < 16e6


def test_words_across_the_ends_of_runs(monkeypatch):
    rng = random.Random(9)
    texts = ["", " ", "a", " a ", "a b", "A b c", "a" * 50, "a" * 50 + " b", *("".join(rng.choice("ab \tC\u00e9") for _ in range(rng.randrange(1, 90))) for _ in range(300))]
    for size in (1, 2, 3, 7, 16):
        monkeypatch.setattr(S, "BYTES_AT_ONCE", size)
        assert [S.fingerprint(t.encode()) for t in texts] == [plain_print(t) for t in texts]


def test_texts_come_in_small_batches(spark, monkeypatch):
    from gaugeline.llm.common import Scratch

    asked, settle = {}, Scratch.settle
    monkeypatch.setattr(Scratch, "settle", lambda self, df, name, rows=None, **o: asked.update({name: rows}) or settle(self, df, name, rows, **o))
    S.grouped(spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string"), 3, 3)
    assert asked["prints"] == S.BATCH_TEXTS <= 1000


def near_prints(rng, n):
    """Chains of fingerprints, a few flipped bits apart, so that cells are large."""
    found = [rng.getrandbits(64)]
    while len(found) < n:
        p = rng.choice(found[-40:]) if rng.random() < 0.97 else rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            p ^= 1 << rng.randrange(64)
        found.append(p)
    return list(dict.fromkeys(found))


def test_links_join_what_all_pairs_join(spark, monkeypatch):
    from gaugeline.llm.common import Scratch
    from gaugeline.llm.components import components

    monkeypatch.setattr(S, "CELL_PART", 64)
    rng = random.Random(11)
    prints = near_prints(rng, 1500)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    roots = {r.node: r.root for r in components(S.near_links(df, 3, scratch), scratch).collect()}
    order = sorted(range(len(prints)), key=lambda k: signed[k])
    want = plain_components([signed[k] for k in order], [prints[k] for k in order])
    assert [roots.get(signed[k], signed[k]) for k in order] == want


def test_pivot_distances_give_field_weights():
    rng = random.Random(5)
    prints = np.array([rng.getrandbits(64) for _ in range(50)], dtype=np.uint64)
    base, masks, _ = S.pivots()
    weights = np.bitwise_count((prints[:, None] ^ base) & masks[None, :])
    to_base = np.bitwise_count(prints ^ base).astype(int)
    assert ((to_base[:, None] - S.distances(prints, base ^ masks).astype(int) + S.FIELD_BITS) // 2 == weights).all()
