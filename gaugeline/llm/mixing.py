"""Mixing sources to target weights by iterative proportional fitting (operator 6).

Documents are added up to cells of source, language and topic. The cells' token weights are raked:
sweep after sweep, each dimension's cells are scaled so that its marginal weights meet
their targets, until all marginals hold at once. Factors are scaled to the wanted size of the sample and cut at
one, the other cells raked on, and are then the probabilities with which documents are sampled: the
expected tokens of the sample have the target marginals. A document's draw is a hash of its id and text: the same on every run and in
every retry.

Topics are the clusters of hashed word counts of all documents. The counts are written once; each
sweep of the fit adds up the centroids over all of them, in whole numbers, so that no order of
addition shows in the result. A table with a topic column of its own may be given instead.

Only cells are swept, and a dimension's sums are partial aggregates joined back, so a source
that holds a third of all rows is one more row. Null sources and languages are a category of their
own; documents without tokens weigh nothing and share their cell's probability. Categories
without tokens get no target; the targets of the others are scaled to one. Repeated rows share
their draw. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, tidy

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
TOPIC_FEATURES = 256
#: Sweeps of the fit at most, and the squared move of a centroid that ends it.
TOPIC_SWEEPS, TOPIC_MOVE = 10, 1e-8
#: Unit vectors are added up as multiples of 2^-30.
_UNIT = float(1 << 30)
#: Share of a category in the mixture grows with this power of its share of the tokens.
TEMPERATURE = 0.7
SWEEPS = 1000
TOLERANCE = 1e-6
#: Cells that are swept as arrays in the driver: a bound on what it holds (some 20 MB).
LOCAL_CELLS = 1 << 18
#: Factors of cells that are cut at one may grow with every sweep, to this at most.
LARGEST = 1e100
#: Part of the largest possible sample that is taken unless told otherwise.
FULL = 0.99
#: Half the sample must lower the worst miss to this part of itself to be taken.
GAIN = 0.9
SEED = 42
_NONE = "\u0000none"
_WORD = "[^ \\t-\\r]+"


def token_count(text: Column) -> Column:
    """Words: runs of characters other than the six ASCII spaces."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def draw(row_key: Column, seed: int) -> Column:
    """A number in [0, 1) from 53 bits of a hash of the row's key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), row_key), 11).cast("double") / F.lit(float(1 << 53))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__counts``, an array of hashed word counts, in place of the text."""
    words = RegexTokenizer(inputCol="__filled", outputCol="__words", pattern=_WORD, gaps=False)
    counts = HashingTF(inputCol="__words", outputCol="__vector", numFeatures=TOPIC_FEATURES)
    filled = docs.withColumn("__filled", F.coalesce(F.col("text").cast("string"), F.lit("")))
    made = counts.transform(words.transform(filled)).withColumn("__counts", vector_to_array("__vector", "float32"))
    return made.drop("text", "__filled", "__words", "__vector")


def units_of(column: pa.Array) -> np.ndarray:
    """Rows of counts as unit vectors: lengths are evened out, and empty texts stay at zero."""
    counts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), TOPIC_FEATURES)
    return counts / np.maximum(np.sqrt((counts * counts).sum(axis=1)), 1e-300)[:, None]


def distances(units: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centers."""
    return np.maximum((units * units).sum(axis=1)[:, None] - 2.0 * units @ centers.T + (centers * centers).sum(axis=1)[None, :], 0.0)


def next_center(rows: DataFrame, centers: np.ndarray, seed: int) -> np.ndarray | None:
    """A document drawn with the square of its distance to the nearest center as its weight; none if all are at a center.

    The draw is a race by a hash of the counts, so copies run as one and every run picks the same.
    """

    def race(batches):
        best: tuple[float, list[float]] | None = None
        for batch in batches:
            units = units_of(batch.column(0))
            weight = distances(units, centers).min(axis=1) if len(centers) else np.ones(len(units))
            luck = (batch.column(1).to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            with np.errstate(divide="ignore"):
                time = np.where(weight > 1e-9, -np.log1p(-luck) / weight, np.inf)
            if len(time) and np.isfinite(time).any():
                k = int(time.argmin())
                if best is None or time[k] < best[0]:
                    best = float(time[k]), units[k].tolist()
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.float64()), pa.array([best[1]], pa.list_(pa.float64()))], ["time", "unit"])

    keyed = rows.select("__counts", F.xxhash64(F.lit(seed + len(centers)), "__counts").alias("luck"))
    first = keyed.mapInArrow(tidy(race), "time double, unit array<double>").orderBy("time", "unit").first()
    return None if first is None else np.array(first["unit"])


def fit_topics(rows: DataFrame, topics: int, seed: int) -> np.ndarray:
    """Centers of k-means over the counts of all ``rows``; fewer than ``topics`` if there are fewer different ones."""
    centers = np.zeros((0, TOPIC_FEATURES))
    while len(centers) < topics and (more := next_center(rows, centers, seed)) is not None:
        centers = np.vstack([centers, more])
    if len(centers) < 2:
        return centers
    for _ in range(TOPIC_SWEEPS):

        def add(batches, centers=centers):
            sums = np.zeros((len(centers), TOPIC_FEATURES + 1), dtype=np.int64)
            for batch in batches:
                units = units_of(batch.column(0))
                if len(units):
                    nearest = distances(units, centers).argmin(axis=1)
                    whole = np.rint(units * _UNIT).astype(np.int64)
                    for k in np.unique(nearest):
                        sums[k, :-1] += whole[nearest == k].sum(axis=0)
                        sums[k, -1] += (nearest == k).sum()
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums.ravel()[at], pa.int64())], ["at", "sum"])

        added = rows.select("__counts").mapInArrow(tidy(add), "at long, sum long").groupBy("at").agg(F.sum("sum").alias("sum")).toArrow()
        sums = np.zeros(len(centers) * (TOPIC_FEATURES + 1))
        sums[added.column("at").to_numpy()] = added.column("sum").to_numpy()
        sums = sums.reshape(len(centers), TOPIC_FEATURES + 1)
        n = sums[:, -1:]
        moved = np.where(n > 0, sums[:, :-1] / _UNIT / np.maximum(n, 1), centers)
        move, centers = ((moved - centers) ** 2).sum(axis=1).max(), moved
        if move <= TOPIC_MOVE:
            break
    return centers


def with_topics(docs: DataFrame, topics: int = TOPICS, seed: int = SEED) -> DataFrame:
    """``docs`` without the text, with the column ``topic``, the number of the nearest cluster of hashed word counts."""
    rows = Scratch(docs.sparkSession, "topics").settle(with_counts(docs), "counts")
    centers = fit_topics(rows, topics, seed)
    if len(centers) < 2:
        return rows.withColumn("topic", F.lit(0)).drop("__counts")
    at = rows.columns.index("__counts")
    others = [k for k in range(len(rows.columns)) if k != at]

    def assign(batches):
        for batch in batches:
            nearest = distances(units_of(batch.column(at)), centers).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in others], pa.array(nearest, pa.int32())], [*[batch.schema.names[k] for k in others], "topic"])

    schema = rows.drop("__counts").withColumn("topic", F.lit(0)).schema
    return rows.mapInArrow(tidy(assign), schema)


def target_weights(cells: DataFrame, dimension: str, targets: Mapping[str, float] | None, temperature: float) -> DataFrame:
    """(dimension, target): given weights, or shares to the power of ``temperature``, scaled to one over categories with tokens."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("n")).where("n > 0")
    if targets is not None:
        given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets.items()], f"{dimension} string, weight double")
        weighted = sums.join(given, dimension, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    else:
        weighted = sums.withColumn("weight", F.pow(F.col("n").cast("double"), temperature))
    total = weighted.agg(F.sum("weight").alias("total")).first()["total"]
    if targets is not None and not total:
        raise ValueError(f"no category of {dimension} with tokens has a target")
    return weighted.select(dimension, (F.col("weight") / F.lit(total or 1.0)).alias(f"{dimension}_target"))


def rake(
    cells: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, targets: Mapping[str, Mapping[str, float]] | None = None, temperature: float = TEMPERATURE,
    sweeps: int = SWEEPS, tolerance: float = TOLERANCE, scratch: Scratch | None = None,
) -> DataFrame:
    """``cells`` (dimensions, tokens) with their targets and the factor that rakes them.

    Ends when no marginal misses its target by more than ``tolerance`` of the whole, or after ``sweeps``;
    targets that no weights can meet together (a wanted category all of whose cells another
    dimension excludes) end after ``sweeps`` with the last dimension's marginals met. Ending
    with a larger miss is reported by a warning.
    """
    scratch = scratch or Scratch(cells.sparkSession, "raking")
    now, miss = fit_factors(with_targets(cells, dimensions, targets, temperature, scratch), dimensions, sweeps, tolerance, scratch)
    if miss > tolerance:
        warnings.warn(f"raking ended after {sweeps} sweeps with a marginal {miss:.3g} off its target (tolerance {tolerance:.3g})", RuntimeWarning, stacklevel=2)
    return now


def with_targets(cells: DataFrame, dimensions: tuple[str, ...], targets: Mapping[str, Mapping[str, float]] | None, temperature: float, scratch: Scratch) -> DataFrame:
    """``cells`` with the target of each of their categories and a factor of one."""
    now = cells
    for d in dimensions:
        now = now.join(target_weights(cells, d, (targets or {}).get(d), temperature), d, "left")
    return scratch.settle(now.fillna(0.0, [f"{d}_target" for d in dimensions]).withColumn("factor", F.lit(1.0)), "cells")


def fit_factors(cells: DataFrame, dimensions: tuple[str, ...], sweeps: int, tolerance: float, scratch: Scratch, size: float | None = None) -> tuple[DataFrame, float]:
    """``cells`` with raked factors, and the worst miss of a marginal.

    With ``size`` (tokens) factors are probabilities: a cell weighs its tokens times its factor, cut at one, and the
    marginals are those of ``size`` tokens. Up to LOCAL_CELLS cells, counted first, are swept as arrays in
    the driver; more cells are swept by joins and aggregates. Both do the same sums.
    """
    columns = cells.columns
    if cells.count() <= LOCAL_CELLS:
        table = cells.toArrow()
        codes = [table.column(d).combine_chunks().dictionary_encode() for d in dimensions]
        codes = [(c.indices.to_numpy(), len(c.dictionary)) for c in codes]
        goals = [table.column(f"{d}_target").to_numpy() for d in dimensions]
        factor, miss = sweep_arrays(table.column("tokens").to_numpy().astype(np.float64), codes, goals, sweeps, tolerance, size)
        table = table.set_column(columns.index("factor"), "factor", pa.array(factor))
        local = cells.sparkSession.createDataFrame(table, cells.schema)
        return scratch.settle(local, f"factors-{uuid.uuid4().hex}"), miss
    now, miss, name = cells, 0.0, f"sweep-{uuid.uuid4().hex}-"
    held = F.col("factor") if size is None else F.least(F.col("factor"), F.lit(1.0))
    for sweep in range(sweeps):
        for d in dimensions:
            sums = now.groupBy(d).agg((F.sum(held * F.col("tokens")) / F.lit(size or 1.0)).alias("__sum"))
            scaled = F.col("factor") * F.coalesce(F.col(f"{d}_target") / F.when(F.col("__sum") > 0, F.col("__sum")), F.lit(0.0))
            now = now.join(sums, d).withColumn("factor", F.least(scaled, F.lit(LARGEST))).drop("__sum")
        now = scratch.settle(now.select(columns), f"{name}{sweep}")
        if sweep:
            scratch.drop(f"{name}{sweep - 1}")
        miss = worst_miss(now.withColumn("factor", held / F.lit(size or 1.0)), dimensions)
        if miss <= tolerance:
            break
    return now, miss


def sweep_arrays(tokens: np.ndarray, codes: list[tuple[np.ndarray, int]], goals: list[np.ndarray], sweeps: int, tolerance: float, size: float | None) -> tuple[np.ndarray, float]:
    """Factors of cells given as arrays, and the worst miss; ``codes`` number each cell's category of a dimension."""
    factor, miss = np.ones(len(tokens)), 0.0

    def sums(code: np.ndarray, kinds: int) -> np.ndarray:
        held = factor if size is None else np.minimum(factor, 1.0)
        return np.bincount(code, weights=held * tokens, minlength=kinds)[code] / (size or 1.0)

    for _ in range(sweeps if len(tokens) else 0):
        for (code, kinds), goal in zip(codes, goals, strict=True):
            own = sums(code, kinds)
            factor = np.minimum(factor * np.divide(goal, own, out=np.zeros_like(goal), where=own > 0), LARGEST)
        miss = max(float(np.abs(sums(code, kinds) - goal).max()) for (code, kinds), goal in zip(codes, goals, strict=True))
        if miss <= tolerance:
            break
    return factor, miss


def worst_miss(cells: DataFrame, dimensions: tuple[str, ...]) -> float:
    """The largest distance of a marginal weight from its target, over all dimensions in one aggregate."""
    marginals = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(d).cast("string").alias("category"), F.col(f"{d}_target").alias("target")) for k, d in enumerate(dimensions)]))
    sums = cells.select(marginals.alias("m"), (F.col("factor") * F.col("tokens")).alias("weight")).groupBy("m.k", "m.category")
    return sums.agg(F.abs(F.sum("weight") - F.max("m.target")).alias("miss")).agg(F.max("miss")).first()[0] or 0.0


def sampling_plan(
    docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, targets: Mapping[str, Mapping[str, float]] | None = None, temperature: float = TEMPERATURE,
    sweeps: int = SWEEPS, tolerance: float = TOLERANCE, share: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Every document's category columns, tokens and draw; and the cells with their probability.

    ``share`` is the wanted part of all tokens. Probabilities are cut at one and the other cells raked again, so the
    marginals hold. The largest part possible is set by the category that is scarcest for its target; by default the
    sample is ``FULL`` of that. Categories may also stand in each other's way (a topic that only one language has): without
    drawing a document twice their targets then hold together in no sample, or only in a handful of documents.
    The part is halved as long as that lowers the worst miss to ``GAIN`` of what it was, and what is
    left of the miss is reported by a warning. At last the factors are scaled to a largest one of one.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    keyed = scratch.settle(docs, "documents")
    cells = scratch.settle(keyed.groupBy(*dimensions).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "sums")
    start = with_targets(cells, dimensions, targets, temperature, scratch)
    raked, miss = fit_factors(start, dimensions, sweeps, tolerance, scratch)
    if miss > tolerance:
        warnings.warn(f"raking ended after {sweeps} sweeps with a marginal {miss:.3g} off its target (tolerance {tolerance:.3g})", RuntimeWarning, stacklevel=2)
    top, total = raked.agg(F.max("factor"), F.sum("tokens")).first()
    if not top or not total:
        return keyed, raked.withColumn("probability", F.lit(1.0))
    scarcest = 1.0
    for d in dimensions:
        least = cells.groupBy(d).agg(F.sum("tokens").alias("n")).join(start.select(d, f"{d}_target").distinct(), d).where(F.col(f"{d}_target") > 0)
        scarcest = min(scarcest, least.agg(F.min(F.col("n") / F.lit(float(total)) / F.col(f"{d}_target"))).first()[0] or 1.0)
    part = FULL * scarcest if share is None else min(share, FULL * scarcest)
    best, least = fit_factors(start, dimensions, sweeps, tolerance, scratch, part * total)
    # Half the sample as long as that brings the marginals nearer to their targets.
    while least > tolerance and part * total > 1.0 / top:
        smaller, off = fit_factors(start, dimensions, sweeps, tolerance, scratch, part / 2 * total)
        if off > GAIN * least:
            break
        best, least, part = smaller, off, part / 2
    if least > tolerance:
        warnings.warn(f"a sample of {part:.3g} of the tokens has a marginal {least:.3g} off its target (tolerance {tolerance:.3g})", RuntimeWarning, stacklevel=2)
    held = best.withColumn("factor", F.least("factor", F.lit(1.0)))
    most = 1.0 if share is not None else held.agg(F.max("factor")).first()[0]
    return keyed, held.withColumn("probability", F.col("factor") / F.lit(most or 1.0))


def mix(docs: DataFrame, topics: DataFrame | None = None, seed: int = SEED, row: Column | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, categories, tokens, the cell's probability, and whether the document is sampled.

    ``row`` is a hash of doc_id and text by which a caller finds the row again.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")) if row is None else row
    own = topics if topics is not None else docs
    named = [F.coalesce(F.col(d).cast("string"), F.lit(_NONE)).alias(d) for d in DIMENSIONS if d != "topic" or topics is not None]
    text = [] if topics is not None else ["text"]
    rows = own.select(key.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *named, token_count(F.col("text").cast("string")).alias("n_tokens"), draw(key, seed).alias("draw"), *text)
    if topics is None:
        rows = with_topics(rows).withColumn("topic", F.col("topic").cast("string"))
    keyed, cells = sampling_plan(rows, **options)
    joined = keyed.join(cells.select(*DIMENSIONS, "probability"), list(DIMENSIONS))
    named = [F.when(F.col(d) != _NONE, F.col(d)).alias(d) for d in ("source", "lang")]
    return joined.select("row", "doc_id", *named, F.col("topic").cast("int").alias("topic"), "n_tokens", "probability", (F.col("draw") < F.col("probability")).alias("sampled"))
