"""Nearest neighbours by block matrix products on int8 tiles (operator 9).

Queries go through in blocks of a fixed size. Each block meets every vector in one scan: a task
cuts its vectors into tiles, quantises them to int8, and gets all products of a tile with the
block by one matrix product of floats that hold these integers, exactly. The lengths of the quantisation residues bound the
error of each product, hence each distance from both sides. A pair survives if its lower bound
is not above the smallest k-th best known to the task; survivors are computed again from the
original vectors in double precision and kept in a heap per query. A task sends at most k
rows per query, and the final k are taken among those. The table is read once per block of queries.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
take no part. A query's own row is any row with its id. Queries that repeat are one; if rows
of one id differ, the smallest vector asks. A query meets vectors of its own length only.
Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch

#: Queries of a block: the broadcast is this many vectors at most, whatever the table's size.
BLOCK_QUERIES = 4096
TILE = 2048
QUERY_TILE = 512

FOUND_SCHEMA = "query_id long, vec_id long, score double"


def takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


class Quantised:
    """Rows of a matrix as int8 multiples of a step per row, with the lengths of both parts."""

    def __init__(self, rows: np.ndarray) -> None:
        self.step = np.abs(rows).max(axis=1) / 127
        # A step that underflows to zero would lose the row.
        self.step = np.where(self.step > 0, self.step, np.abs(rows).max(axis=1))
        self.codes = np.rint(rows / self.step[:, None]).astype(np.int8)
        near = self.codes * self.step[:, None]
        self.near_length = np.sqrt((near * near).sum(axis=1))
        self.rest_length = np.sqrt(((rows - near) ** 2).sum(axis=1))
        self.square = (rows * rows).sum(axis=1)
        self.length = np.sqrt(self.square)


def tile_bounds(queries: Quantised, vectors: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of all pairs of a tile."""
    # Sums of int8 products stay below 2^24 for up to 1040 components and are exact in single precision.
    kind = np.float32 if queries.codes.shape[1] <= 1040 else np.float64
    product = (queries.codes.astype(kind) @ vectors.codes.astype(kind).T).astype(np.float64)
    product *= queries.step[:, None]
    product *= vectors.step[None, :]
    error = queries.near_length[:, None] * vectors.rest_length[None, :] + queries.rest_length[:, None] * vectors.length[None, :]
    square = queries.square[:, None] + vectors.square[None, :]
    error += 1e-12 * square
    middle = square - 2 * product
    return middle - 2 * error, middle + 2 * error


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows; components are added in their order."""
    if not len(a):
        return np.zeros(0)
    return np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1])


def rows_by_length(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch as matrices, by the length of the vectors."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(lengths) - lengths
    return {
        int(n): (ids[lengths == n], values[(starts[lengths == n][:, None] + np.arange(n)).ravel()].reshape(-1, n)) for n in np.unique(lengths)
    }


class Heaps:
    """The k smallest (distance, id) of each query of a block."""

    def __init__(self, count: int, k: int) -> None:
        self.k = k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(count)]
        self.worst = np.full(count, np.inf)

    def add(self, query: int, distance: float, vec_id: int) -> None:
        heap, entry = self.heaps[query], (-distance, -vec_id)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.worst[query] = -heap[0][0]


def search_tile(heaps: Heaps, first: int, ids: np.ndarray, rows: np.ndarray, coded: Quantised, vec_ids: np.ndarray, vectors: np.ndarray, coded_vectors: Quantised) -> None:
    lower, upper = tile_bounds(coded, coded_vectors)
    own = ids[:, None] == vec_ids[None, :]
    upper[own] = np.inf
    k = heaps.k
    reach = heaps.worst[first : first + len(ids)] ** 2 * (1 + 1e-9)
    if len(vec_ids) >= k:
        reach = np.minimum(reach, np.partition(upper, k - 1, axis=1)[:, k - 1])
    query, vector = np.nonzero((lower <= reach[:, None]) & ~own)
    for at in range(0, len(query), 1 << 16):
        q, v = query[at : at + (1 << 16)], vector[at : at + (1 << 16)]
        for a, d, b in zip((first + q).tolist(), distances(rows[q], vectors[v]).tolist(), vec_ids[v].tolist(), strict=True):
            heaps.add(a, d, b)


def search_block(vectors: DataFrame, ids: np.ndarray, lists: list, k: int) -> DataFrame:
    """The best k of each task for a block of queries."""
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = np.array([len(x) for x in lists])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        by_length[int(n)] = (ids[at], np.array([lists[i] for i in at], dtype=np.float64))
    shared = vectors.sparkSession.sparkContext.broadcast(by_length)

    def search(batches):
        own = {}
        for n, (query_ids, rows) in shared.value.items():
            parts = [slice(a, a + QUERY_TILE) for a in range(0, len(query_ids), QUERY_TILE)]
            own[n] = (Heaps(len(query_ids), k), [(p.start, query_ids[p], rows[p], Quantised(rows[p])) for p in parts])
        for batch in batches:
            for n, (vec_ids, rows) in rows_by_length(batch).items():
                if n not in own:
                    continue
                heaps, parts = own[n]
                for a in range(0, len(vec_ids), TILE):
                    tile = rows[a : a + TILE].astype(np.float64)
                    coded = Quantised(tile)
                    for part in parts:
                        search_tile(heaps, *part, vec_ids[a : a + TILE], tile, coded)
        for n, (heaps, _) in own.items():
            query_ids = shared.value[n][0].tolist()
            found = [(q, -b, -d) for q, heap in zip(query_ids, heaps.heaps, strict=True) for d, b in heap]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(search, FOUND_SCHEMA)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and Euclidean distance of the k nearest rows of each query of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = -(-asked.count() // block_queries)
    # Ids are dealt to twice as many blocks as needed at least, so that no block outgrows its bound.
    blocks = 1 if blocks <= 1 else 2 * blocks
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow()
        if block.num_rows:
            ids = block.column("vec_id").to_numpy()
            scratch.add(search_block(rows, ids, block.column("embedding").to_pylist(), k), "found")
        elif blocks == 1:
            scratch.add(spark.createDataFrame([], FOUND_SCHEMA), "found")
    found = scratch.read("found", FOUND_SCHEMA)
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
