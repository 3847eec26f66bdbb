"""Quality rules: base rules and n-gram perplexity with bands per language (operator 5).

The language model is a modified Kneser-Ney model of characters, one per language, counted by
Spark over all documents. A map task adds up its n-grams under their language and characters,
in a table whose slots hold one n-gram each; those that find their slot taken go out batch by
batch. Spark sums the exact keys, and discounts, back-off weights and interpolated probabilities
are joins and aggregates on them. The model is a set of sorted hash arrays: 64-bit hashes in
order beside log-probabilities; a slot table found by the first bits of a hash holds the whole
hash as a check. The arrays grow with the number of n-grams. A task holds at most
``PART_ENTRIES`` of them at a time: beyond that the n-grams are split into parts by their hash,
and a document's sum is added up over the parts.

The model is trained on the distinct sentences of a language (a sentence ends behind a full stop or an
exclamation or question mark, and the next begins without context): copies, near copies and passages that
texts share weigh one, so that they do not become too predictable. Bands come from distinct texts that
pass the base rules: however many copies a text has, it weighs one.

A document passes if its mean negative log-probability per character lies in the band of
its language: the median of the language, plus or minus ``width`` robust deviations. Short
texts scatter more, so the band has a second part that shrinks with the root of the length.
A language's deviation is shrunk to the common one, that of all texts from their own
language's median, as if ``least`` texts more had the common one, and is never less than
``FLOOR`` of it. Medians are not shrunk: a model of little text has another level.

Null texts have no words and fail the base rules. A null language is one language of its own;
so is any text in the column. Repeated rows give a row each. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, tidy

ORDER = 4
#: Slots of a map task's table of counts; n-grams without a slot are counted too.
SLOT_BITS = 22
#: N-grams of the model that a task holds at a time.
PART_ENTRIES = 1 << 21
#: Width of a band in robust deviations, and its part for short texts in nats times root characters.
WIDTH, SHORT = 3.0, 2.0
#: Weight of the common deviation in texts, and the least part of it that a language's own may have.
LEAST, FLOOR = 20, 0.5
#: Characters whose n-grams are counted together.
CHARS_AT_ONCE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
#: A sentence ends behind one of these; the next one has no context.
_ENDS = ".!?"

COUNT_SCHEMA = "lang string, gram string, n long"
SCORE_SCHEMA = (
    "row long, doc_id long, lang string, same long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_scored long, nll double"
)


def lang_seed(lang: str | None) -> int:
    return xxhash.xxh64_intdigest("" if lang is None else "=" + lang, 1)


def hashes_of(seeds: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each n-gram's language and characters."""
    h = seeds.copy()
    for column in grams:
        h ^= column
        h *= _ODD
        h ^= h >> np.uint64(32)
    h *= _ODD
    return h


def slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of each hash."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class Batch:
    """Texts laid end to end as code points, ``order - 1`` zeros before each sentence; zeros are never predicted."""

    def __init__(self, texts: list[str], langs: list[str | None], order: int, bits: int) -> None:
        pad = "\0" * (order - 1)
        for end in _ENDS:
            texts = [t.replace(end, end + pad) for t in texts]
        data = (pad + pad.join(texts)).encode("utf-32-le", "surrogatepass")
        self.points = np.frombuffer(data, dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64) + order - 1
        self.langs = langs
        points = self.points.astype(np.uint64)
        n = len(points) - order + 1
        self.owner = np.repeat(np.arange(len(texts)), lengths)[order - 1 :]
        seeds = np.array([lang_seed(x) for x in langs], dtype=np.uint64)[self.owner]
        self.order, self.bits, self.seeds, self.n = order, bits, seeds, max(0, n)
        self.columns = [points[k : k + self.n] for k in range(order)]
        self.valid = self.columns[-1] != 0
        self.hashes = hashes_of(seeds, self.columns)


def batches_of(batches, text: int, lang: int, limit: int = CHARS_AT_ONCE):
    """Slices of record batches with at most ``limit`` characters, unless one text is longer."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            texts, size = [], 0
            while start + len(texts) < batch.num_rows and size < limit:
                texts.append(batch.column(text)[start + len(texts)].as_py() or "")
                size += len(texts[-1])
            part = batch.slice(start, len(texts))
            yield part, texts, part.column(lang).to_pylist()
            start += len(texts)


def text_key() -> Column:
    """Hash of a text and its language."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")), F.coalesce(F.col("text"), F.lit("")))


def distinct_sentences(docs: DataFrame) -> DataFrame:
    """text and lang: each sentence of a language once, however many texts hold it."""
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), f"(?<=[{_ENDS}])", -1)
    return docs.select("lang", F.explode(parts).alias("text")).where("text != ''").distinct().select("text", "lang")


def count_grams(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """lang, gram and count of the n-grams of the highest order; a null language is "", others follow a "="."""

    def count(batches):
        total = np.zeros(1 << bits, dtype=np.int64)
        sample = np.zeros((order, 1 << bits), dtype=np.uint32)
        named = np.full(1 << bits, -1, dtype=np.int32)
        first = np.zeros(1 << bits, dtype=np.int32)
        names: dict[str | None, int] = {}

        def rows(grams, langs, n):
            of = ["" if x is None else "=" + x for x in names]
            for a in range(0, len(n), 50_000):
                b = min(len(n), a + 50_000)
                text = np.ascontiguousarray(grams[:, a:b].T).tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([of[k] for k in langs[a:b]], pa.string()),
                        pa.array([text[k : k + order] for k in range(0, len(text), order)], pa.string()), pa.array(n[a:b], pa.int64()),
                    ],
                    ["lang", "gram", "n"],
                )

        for _, texts, langs in batches_of(batches, 0, 1):
            batch = Batch(texts, langs, order, bits)
            at = np.flatnonzero(batch.valid)
            hashes = batch.hashes[at]
            slots = slots_of(hashes, bits)
            owner = np.array([names.setdefault(x, len(names)) for x in langs], dtype=np.int32)[batch.owner[at]]
            # Of the n-grams that meet in a free slot one takes it.
            free = np.flatnonzero(named[slots] < 0)
            first[slots[free]] = free
            takes = free[first[slots[free]] == free]
            named[slots[takes]] = owner[takes]
            for k in range(order):
                sample[k, slots[takes]] = batch.points[at[takes] + k]
            own = named[slots] == owner
            for k in range(order):
                own &= sample[k, slots] == batch.points[at + k]
            total += np.bincount(slots[own], minlength=1 << bits)
            rest = np.flatnonzero(~own)
            if len(rest):
                rest = rest[np.argsort(hashes[rest], kind="stable")]
                grams = np.stack([batch.points[at[rest] + k] for k in range(order)])
                differs = (owner[rest][1:] != owner[rest][:-1]) | (grams[:, 1:] != grams[:, :-1]).any(axis=0)
                starts = np.flatnonzero(np.concatenate([[True], differs]))
                yield from rows(grams[:, starts], owner[rest][starts], np.diff(np.append(starts, len(rest))))
        used = np.flatnonzero(total)
        for a in range(0, len(used), 50_000):
            part = used[a : a + 50_000]
            yield from rows(sample[:, part], named[part], total[part])

    rows = docs.select("text", "lang").mapInArrow(tidy(count), COUNT_SCHEMA)
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of an order from its numbers of n-grams seen once to four times."""
    n = counts.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
    n = [0, *(int(x) for x in n)]
    if not all(n[1:]):
        return [0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) for k in (1, 2, 3)]


def model_tables(grams: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(part, lang, gram, value): the log-probability of each n-gram and, in part -k, the log back-off weight of each context of order k."""
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        # An n-gram of a lower order counts the different characters it follows.
        levels[k] = scratch.settle(levels[k + 1].groupBy("lang", F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count("*").alias("c")), f"level{k}")
    below, parts = None, []
    for k in range(1, order + 1):
        level, cut = levels[k], discounts(levels[k])
        taken = F.when(F.col("c") == 1, cut[0]).when(F.col("c") == 2, cut[1]).otherwise(cut[2])
        keyed = level.withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        contexts = keyed.groupBy("lang", "context").agg(
            F.sum("c").alias("total"), (F.sum(taken) / F.sum("c")).alias("weight"), F.count("*").alias("kinds")
        )
        joined = keyed.join(contexts, ["lang", "context"])
        if below is None:
            p = (F.col("c") - taken) / F.col("total") + F.col("weight") / (F.col("kinds") + 1)
        else:
            joined = joined.withColumn("rest", F.expr(f"substring(gram, 2, {k - 1})")).join(
                below.select("lang", F.col("gram").alias("rest"), F.col("p").alias("q")), ["lang", "rest"]
            )
            p = (F.col("c") - taken) / F.col("total") + F.col("weight") * F.col("q")
        below = scratch.settle(joined.select("lang", "gram", p.alias("p")), f"p{k}")
        parts.append(below.select(F.lit(k).alias("part"), "lang", "gram", F.log("p").alias("value")))
        parts.append(contexts.select(F.lit(-k).alias("part"), "lang", F.col("context").alias("gram"), F.log("weight").alias("value")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


class Index:
    """Values by 64-bit hash: a table of slots for most, sorted arrays for those whose slot is taken."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(1, (2 * len(hashes)).bit_length())
        self.held = np.zeros(1 << self.bits, dtype=np.uint64)
        self.value = np.full(1 << self.bits, np.nan, dtype=np.float32)
        slots, at = np.unique(slots_of(hashes, self.bits), return_index=True)
        self.held[slots], self.value[slots] = hashes[at], values[at]
        rest = np.ones(len(hashes), dtype=bool)
        rest[at] = False
        self.hashes, self.values = hashes[rest], values[rest]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, not a number where there is none."""
        slots = slots_of(hashes, self.bits)
        found = self.value[slots].astype(np.float64)
        other = np.flatnonzero((self.held[slots] != hashes) & ~np.isnan(found))
        found[other] = np.nan
        if len(other) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes[other]), len(self.hashes) - 1)
            found[other] = np.where(self.hashes[at] == hashes[other], self.values[at], np.nan)
        return found


class Model:
    """By order (contexts: minus order) the hashes of n-grams in order and the value of each.

    A model of several parts holds the n-grams of the highest order whose hash, modulo ``parts``, is ``part``, and
    gives 0 for others. Its texts must be among those it was trained on: it has no lower orders.
    """

    def __init__(self, order: int, bits: int, arrays: dict[int, tuple[np.ndarray, np.ndarray]], part: int = 0, parts: int = 1) -> None:
        self.order, self.bits, self.arrays, self.part, self.parts = order, bits, arrays, part, parts
        self.indexes: dict[int, Index] = {}

    def __getstate__(self):
        return self.__dict__ | {"indexes": {}}

    def find(self, part: int, hashes: np.ndarray, missing: float) -> np.ndarray:
        if part not in self.indexes:
            self.indexes[part] = Index(*self.arrays.get(part, (np.zeros(0, np.uint64), np.zeros(0, np.float32))))
        found = self.indexes[part].find(hashes)
        return found if math.isnan(missing) else np.where(np.isnan(found), missing, found)

    def log_probabilities(self, batch: Batch) -> np.ndarray:
        """Of each character that is predicted."""
        at = np.flatnonzero(batch.valid)
        hashes = batch.hashes[at]
        if self.parts > 1:
            own = np.flatnonzero(hashes % np.uint64(self.parts) == self.part)
            found = np.zeros(len(at))
            found[own] = self.find(self.order, hashes[own], 0.0)
            return found
        found = self.find(self.order, hashes, np.nan)
        todo = np.flatnonzero(np.isnan(found))
        if len(todo):
            found[todo] = self.back_off(batch, at[todo])
        return found

    def back_off(self, batch: Batch, at: np.ndarray) -> np.ndarray:
        seeds = batch.seeds[at]
        columns = [c[at] for c in batch.columns]
        total, answer = np.zeros(len(at)), np.full(len(at), np.nan)
        for k in range(self.order, 0, -1):
            own = columns[self.order - k :]
            value = self.find(k, hashes_of(seeds, own), np.nan) if k < self.order else np.full(len(at), np.nan)
            answer = np.where(np.isnan(answer), total + value, answer)
            total = total + self.find(-k, hashes_of(seeds, own[:-1]), 0.0)
        # A character never seen in the language: what is left to it, or a fixed low value in an unknown language.
        kinds = max(1, len(self.arrays.get(1, ((), ()))[0]))
        return np.where(np.isnan(answer), total - math.log(kinds + 1), answer)


def train_parts(docs: DataFrame, order: int = ORDER, bits: int = SLOT_BITS, scratch: Scratch | None = None) -> tuple[DataFrame, int]:
    """(part, hash, value) of a model of the distinct sentences of ``docs`` (text, lang), and its number of rows."""
    scratch = scratch or Scratch(docs.sparkSession, "language-model")
    grams = scratch.settle(count_grams(distinct_sentences(docs), order, bits), "grams")

    def hashed(batches):
        for batch in batches:
            part, lang, gram = (batch.column(k).to_pylist() for k in range(3))
            seed = {x: lang_seed(x[1:] if x else None) for x in set(lang)}
            hashes = np.zeros(len(gram), dtype=np.uint64)
            for k in set(map(len, gram)):
                rows = [i for i, g in enumerate(gram) if len(g) == k]
                points = np.frombuffer("".join(gram[i] for i in rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64).reshape(len(rows), k)
                hashes[rows] = hashes_of(np.array([seed[lang[i]] for i in rows], dtype=np.uint64), [points[:, c] for c in range(k)])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(hashes.view(np.int64), pa.int64()), batch.column(3)], ["part", "hash", "value"])

    # Should two n-grams have all 64 bits in common, the larger value stays: one entry a hash.
    table = model_tables(grams, order, scratch).mapInArrow(hashed, "part int, hash long, value double")
    rows = scratch.settle(table.groupBy("part", "hash").agg(F.max("value").cast("float").alias("value")), "arrays")
    return rows, rows.count()


def array_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    columns = rows.select("hash", "value").toArrow()
    hashes, values = columns.column("hash").to_numpy().view(np.uint64), columns.column("value").to_numpy()
    by = np.argsort(hashes, kind="stable")
    return hashes[by], values[by]


def whole_model(rows: DataFrame, order: int, bits: int) -> Model:
    return Model(order, bits, {k: array_of(rows.where(F.col("part") == k)) for k in [*range(1, order + 1), *range(-order, 0)]})


def train(docs: DataFrame, order: int = ORDER, bits: int = SLOT_BITS, scratch: Scratch | None = None) -> Model:
    """A model of the distinct sentences of ``docs`` (text, lang) for any text, with all orders in one piece."""
    return whole_model(train_parts(docs, order, bits, scratch)[0], order, bits)


def models(docs: DataFrame, order: int, bits: int, scratch: Scratch, entries: int) -> Iterator[Model]:
    """The model of ``docs`` for scoring these same texts, in parts of about ``entries`` n-grams."""
    rows, n = train_parts(docs, order, bits, scratch)
    if n <= entries:
        yield whole_model(rows, order, bits)
        return
    top = rows.where(F.col("part") == order)
    parts = max(2, -(-top.count() // entries))
    for k in range(parts):
        # The hash as an unsigned number: its upper and lower half, each modulo the number of parts.
        upper, lower = F.shiftrightunsigned("hash", 32), F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF))
        share = (upper % parts * F.lit((1 << 32) % parts) + lower) % parts
        yield Model(order, bits, {order: array_of(top.where(share == k))}, k, parts)


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words in windows of ``window`` words that the text holds twice or more."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    n = len(ids) - window + 1
    code, kinds = ids[:n], len(number)
    for k in range(1, window):
        if kinds * len(number) >= 1 << 62:
            names, code = np.unique(code, return_inverse=True)
            kinds = len(names)
        code = code * len(number) + ids[k : k + n]
        kinds *= len(number)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    at = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACES)] if "\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Base counts and mean negative log-probability of every row of ``docs`` (row, doc_id, text, lang, same)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for part, texts, langs in batches_of(batches, 2, 3):
            batch = Batch(texts, langs, own.order, own.bits)
            owner = batch.owner[batch.valid]
            scored = np.bincount(owner, minlength=len(texts))
            total = np.bincount(owner, weights=-own.log_probabilities(batch), minlength=len(texts))
            base = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(len(texts), 5)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), part.column(3), part.column(4), *[pa.array(base[:, k], pa.int64()) for k in range(5)],
                    pa.array(scored, pa.int64()), pa.array(total / np.maximum(scored, 1), pa.float64()),
                ],
                ["row", "doc_id", "lang", "same", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_scored", "nll"],
            )

    return docs.mapInArrow(tidy(run), SCORE_SCHEMA)


def score_parts(docs: DataFrame, parts: Iterable[Model], scratch: Scratch) -> DataFrame:
    """``score`` with a model in parts: the sums of each row over the parts."""
    scored = None
    for k, model in enumerate(parts):
        if scored is None:
            scored = scratch.settle(score(docs, model), "scores")
            continue
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            own = shared.value
            for part, texts, langs in batches_of(batches, 1, 2):
                batch = Batch(texts, langs, own.order, own.bits)
                owner = batch.owner[batch.valid]
                total = np.bincount(owner, weights=-own.log_probabilities(batch), minlength=len(texts))
                mean = total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mean, pa.float64())], ["row", "more"])

        # Repeated rows have the same sum.
        more = docs.select("row", "text", "lang").mapInArrow(tidy(run), "row long, more double").groupBy("row").agg(F.max("more").alias("more"))
        scored = scratch.settle(scored.join(more, "row").withColumn("nll", F.col("nll") + F.col("more")).select(scored.columns), f"scores{k}")
        shared.destroy()
        if k > 1:
            scratch.drop(f"scores{k - 1}")
    return scored


def bands(scored: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, median and robust deviation of the distinct texts that pass the base rules."""
    texts = scored.where("not base_failed").groupBy("lang", "same").agg(F.min("nll").alias("nll"))

    def quartiles(value: str) -> Column:
        return F.percentile_approx(value, [0.25, 0.5, 0.75], 10_000)

    own = texts.groupBy("lang").agg(quartiles("nll").alias("q"), F.count("*").alias("n")).select(
        "lang", "n", F.col("q")[1].alias("middle"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("own")
    )
    off = texts.join(own.select(F.col("lang").alias("band_lang"), "middle"), F.col("lang").eqNullSafe(F.col("band_lang"))).select((F.col("nll") - F.col("middle")).alias("off"))
    q = off.agg(quartiles("off").alias("q")).first()["q"]
    common = F.lit((q[2] - q[0]) / 1.349 if q else 0.0)
    shrunk = (F.col("n") * F.col("own") + F.lit(float(least)) * common) / (F.col("n") + F.lit(float(least)))
    return own.select("lang", "middle", F.greatest(shrunk, F.lit(FLOOR) * common).alias("spread"))


def judge(docs: DataFrame, order: int = ORDER, bits: int = SLOT_BITS, width: float = WIDTH, short: float = SHORT, least: int = LEAST, entries: int = PART_ENTRIES) -> DataFrame:
    """The counts, base_failed, perplexity, its band and ``kept`` for every row of ``docs``.

    ``row`` is a hash of doc_id and text by which a caller finds the row again.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    texts = F.col("text").cast("string")
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), texts).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), texts.alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("same", text_key())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = score_parts(rows, models(rows, order, bits, scratch, entries), scratch).withColumn("base_failed", failed)
    banded = scored.join(bands(scored, least).withColumnRenamed("lang", "band_lang"), F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    room = F.lit(width) * F.col("spread") + F.lit(short) / F.sqrt(F.greatest("n_scored", F.lit(1)))
    inside = F.coalesce(F.abs(F.col("nll") - F.col("middle")) <= room, F.lit(True))
    return banded.select(
        "row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), F.exp("nll").alias("perplexity"),
        F.exp(F.col("middle") - room).alias("lower"), F.exp(F.col("middle") + room).alias("upper"),
    )
