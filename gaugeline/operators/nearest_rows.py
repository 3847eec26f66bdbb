"""T4: the k nearest rows of a batch stream to each vector of a pack, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows and questions of a tile; a tile's distances take 2 MB, whatever the batch and the pack hold.
TILE_ROWS, TILE_QUESTIONS = 1024, 256


def by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(vectors.offsets.to_numpy())
    starts = np.cumsum(lengths) - lengths
    groups = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        groups[int(n)] = at, values[(starts[at][:, None] + np.arange(n)).ravel()].reshape(-1, n)
    return groups


def comparable(ids: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as Spark sorts them."""
    return np.array(ids.to_pylist(), dtype=str) if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type) else ids.to_numpy(zero_copy_only=False)


def distances(rows: np.ndarray, pack: np.ndarray, metric: str) -> np.ndarray:
    """Rows x questions: squared Euclidean distances, or negative cosines (0 where a vector has no length)."""
    if metric == "l2":
        # Summed as differences: a product would lose the digits that rank close vectors.
        total = np.zeros((len(rows), len(pack)))
        for d in range(rows.shape[1]):
            total += (rows[:, d][:, None] - pack[:, d][None, :]) ** 2
        return np.round(total, 9)
    lengths = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(pack, axis=1)[None, :]
    return np.round(-np.divide(rows @ pack.T, lengths, out=np.zeros_like(lengths), where=lengths > 0), 9)


class Nearest:
    """The k smallest (distance, id) of each question so far, in order."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.distance = np.full((0, questions), np.inf)
        self.ids: np.ndarray | None = None

    def add(self, distance: np.ndarray, ids: np.ndarray, first: int) -> None:
        """Rows of a tile, ordered by id, for the questions from ``first`` on."""
        n = distance.shape[1]
        # Stable, so that of equal distances the smaller ids stay.
        at = np.argsort(distance, axis=0, kind="stable")[: self.k]
        near, own = np.take_along_axis(distance, at, axis=0), ids[at]
        part = slice(first, first + n)
        if self.ids is None or len(self.distance) < self.k:
            self._grow(ids)
        if self.ids.dtype != own.dtype:
            self.ids = self.ids.astype(np.promote_types(self.ids.dtype, own.dtype))
        both = np.concatenate([self.distance[:, part], near])
        names = np.concatenate([self.ids[:, part], own])
        order = np.lexsort((names, both), axis=0)[: self.k]
        self.distance[:, part] = np.take_along_axis(both, order, axis=0)
        self.ids[:, part] = np.take_along_axis(names, order, axis=0)

    def _grow(self, ids: np.ndarray) -> None:
        questions = self.distance.shape[1]
        self.distance = np.full((self.k, questions), np.inf)
        # Places that nothing has filled hold some id; their distance says that they are empty.
        self.ids = np.full((self.k, questions), ids[:1], dtype=ids.dtype)


def nearest_of(shared, k: int, metric: str):
    """A function over batches (d, v) that gives at most k rows (q, d, distance) per question and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question_ids, packs = shared.value
        best = {n: Nearest(len(at), k) for n, (at, _) in packs.items()}
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            ids = comparable(batch.column(0))
            for n, (places, rows) in by_length(batch.column(1)).items():
                if n not in packs:
                    continue
                order = np.argsort(ids[places], kind="stable")
                places, rows = places[order], rows[order]
                for a in range(0, len(rows), TILE_ROWS):
                    tile, own = rows[a : a + TILE_ROWS], ids[places[a : a + TILE_ROWS]]
                    for b in range(0, len(packs[n][1]), TILE_QUESTIONS):
                        best[n].add(distances(tile, packs[n][1][b : b + TILE_QUESTIONS], metric), own, b)
        for n, (at, _) in packs.items():
            if best[n].ids is None:
                continue
            place, question = np.nonzero(np.isfinite(best[n].distance))
            found = pa.array(best[n].ids[place, question].tolist(), id_type)
            yield pa.RecordBatch.from_arrays([question_ids.take(pa.array(at[question])), found, pa.array(best[n].distance[place, question])], ["q", "d", "distance"])

    return run
