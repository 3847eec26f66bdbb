"""Toxicity severity by cumulative-link ordinal regression on sparse word features (operator 2).

The probability that a document's grade is above j is logistic(w . x - theta_j): one weight per word for
all thresholds, and thresholds in increasing order. The expected severity is the sum of these
probabilities. Features are the distinct words of a text (letters only, lower-cased) and the
beginnings of longer words. Of those that ``min_docs`` training documents hold, the ones whose log
odds between toxic and other documents differ from zero by ``MARK`` standard errors take part.

The labels say only whether a document is toxic. Grades are made from them: 0 for documents that
are not toxic; the toxic ones are graded 1 to ``GRADES`` in equal parts by the share of their
features that mark toxic documents (log odds above one on the training sample). Whoever has grades gives them.

The model is fitted on a bounded sample of labelled documents (those with the smallest hash of
the id), every document is scored. Null texts have no words and get the lowest severity the
thresholds allow; null labels are no labels; if labels of one id disagree, the larger one holds.
Without toxic or without other labels every document has severity zero. Repeated rows give a
row each; an empty table no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import only

#: Labelled documents the model is fitted on.
TRAIN_DOCS = 10_000
MIN_DOCS = 5
MARK = 2.0
#: Letters of the beginnings.
STEM = 6
GRADES = 3
RIDGE = 1e-4
STEPS = 300
_WORD = re.compile(r"[^\W\d_]+")

SCORE_SCHEMA = "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean"


def words_of(text: str | None) -> set[str]:
    """Words, and the beginnings of longer ones behind a sign that no word has."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {"^" + w[:STEM] for w in words if len(w) > STEM}


@dataclass
class Ordinal:
    """Weights by word and increasing thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def above(self, text: str | None) -> np.ndarray:
        """Probability that the grade is above 0, 1, ..."""
        get = self.weights.get
        score = sum(get(w, 0.0) for w in words_of(text))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds - score))


def fit(rows: list[np.ndarray], grades: np.ndarray, width: int, top: int, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the cumulative-link loss, by accelerated adaptive gradient steps.

    Thresholds are the first one plus sums of exponentials, so they stay in order.
    """
    sizes = np.array([len(r) for r in rows])
    columns = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    share = np.array([np.clip((grades > j).mean(), 1e-4, 1 - 1e-4) for j in range(top)])
    start = np.log(1 / share - 1)
    params = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = max(1, len(rows))
    for step in range(1, steps + 1):
        weights, theta = params[:width], params[width] + np.r_[0.0, np.cumsum(np.exp(params[width + 1 :]))]
        score = np.bincount(owner, weights=weights[columns], minlength=len(rows))
        edges = np.concatenate([np.full((len(rows), 1), 1.0), 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -500, 500))), np.zeros((len(rows), 1))], axis=1)
        slope = edges * (1 - edges)
        at = np.arange(len(rows))
        chance = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
        by_score = -(slope[at, grades] - slope[at, grades + 1]) / chance / n
        by_theta = np.zeros(top)
        for j in range(top):
            # Threshold j bounds grade j from above and grade j + 1 from below.
            by_theta[j] = (-(slope[:, j + 1] * (grades == j)) / chance + (slope[:, j + 1] * (grades == j + 1)) / chance).sum() / n
        gradient = np.empty_like(params)
        gradient[:width] = np.bincount(columns, weights=by_score[owner], minlength=width) + ridge * weights
        gradient[width] = by_theta.sum()
        gradient[width + 1 :] = np.cumsum(by_theta[::-1])[::-1][1:] * np.exp(params[width + 1 :])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:width], params[width] + np.r_[0.0, np.cumsum(np.exp(params[width + 1 :]))]


def log_odds(rows: list[np.ndarray], toxic: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each feature between toxic and other rows, and their standard errors."""
    columns = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = [np.bincount(columns[toxic[owner] == kind], minlength=width) + 0.5 for kind in (True, False)]
    rest = [(toxic == kind).sum() + 1 - n for kind, n in zip((True, False), seen, strict=True)]
    return np.log(seen[0] / rest[0]) - np.log(seen[1] / rest[1]), np.sqrt(1 / seen[0] + 1 / rest[0] + 1 / seen[1] + 1 / rest[1])


def grade_by_marks(rows: list[np.ndarray], toxic: np.ndarray, odds: np.ndarray, grades: int) -> np.ndarray:
    """Grades of toxic rows in equal parts by their share of marking features; 0 for the others."""
    columns = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    marks = np.bincount(owner, weights=odds[columns] > 1, minlength=len(rows)) / np.maximum(1, np.bincount(owner, minlength=len(rows)))
    result = np.zeros(len(rows), dtype=np.int64)
    order = np.flatnonzero(toxic)[np.argsort(marks[toxic], kind="stable")]
    result[order] = 1 + np.arange(len(order)) * grades // max(1, len(order))
    return result


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, min_docs: int = MIN_DOCS, grades: int = GRADES) -> Ordinal:
    """The model of a bounded sample of labelled documents; labels have ``toxic`` 0/1, or ``grade`` 0 to ``grades``."""
    graded = "grade" in labels.columns
    value = F.col("grade" if graded else "toxic").cast("int")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), value.alias("label")).where("doc_id is not null and label is not null")
    sample = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def cut(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([sorted(words_of(t.as_py())) for t in batch.column(2)], pa.list_(pa.string()))], ["doc_id", "label", "words"]
            )

    texts = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    # The sample is bounded by max_docs rows of two numbers; one row of an id stands for its repeats.
    held = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    rows = held.mapInArrow(cut, "doc_id long, label int, words array<string>").persist()
    try:
        vocabulary = [r[0] for r in rows.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") >= min_docs).select("w").orderBy("w").collect()]
        number = {w: k for k, w in enumerate(vocabulary)}
        shared = docs.sparkSession.sparkContext.broadcast(number)

        def code(batches):
            own = shared.value
            for batch in batches:
                ids = [[own[w] for w in words if w in own] for words in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "label", "ids"])

        coded = rows.mapInArrow(code, "doc_id long, label int, ids array<int>").toArrow().sort_by("doc_id")
    finally:
        rows.unpersist()
    features = [np.array(x or [], dtype=np.int64) for x in coded.column("ids").to_pylist()]
    label = np.array(coded.column("label").to_pylist(), dtype=np.int64)
    if not (label > 0).any() or not (label == 0).any():
        return Ordinal({}, np.full(grades, np.inf))
    odds, error = log_odds(features, label > 0, len(vocabulary))
    levels = np.clip(label, 0, grades) if graded else grade_by_marks(features, label > 0, odds, grades)
    taken = np.flatnonzero(np.abs(odds) >= MARK * error)
    place = np.full(len(vocabulary), -1)
    place[taken] = np.arange(len(taken))
    features = [place[r][place[r] >= 0] for r in features]
    weights, thresholds = fit(features, levels, len(taken), grades)
    return Ordinal({vocabulary[k]: float(x) for k, x in zip(taken, weights, strict=True) if x}, thresholds)


def score(docs: DataFrame, model: Ordinal, cutoff: float = 0.5) -> DataFrame:
    """Expected severity, probability of any toxicity, likeliest grade and verdict of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            above = np.array([own.above(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(own.thresholds))
            chances = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(chances.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= cutoff),
                ],
                ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"],
            )

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCORE_SCHEMA)
