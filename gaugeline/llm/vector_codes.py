"""Product codes of vectors through dictionaries of the values of each dimension (operator 12).

Components become integers floor(scale * x). Vectors are cut into equal consecutive parts; every part
position has a codebook, fitted by rounds of assignment and rounded-down means in exact integers.

Rows are packed once into blocks. A block holds, for every dimension, the sorted distinct integers
that occur in it (the dictionary) and the rows as numbers of dictionary entries. A round tabulates,
per dimension, the squared differences of every distinct integer to all codebook entries; the
distances of a part are then gathers from these tables by the rows' dictionary codes, added over the
part's dimensions. A dictionary is as long as its block at most, so memory follows the block
and never the table. A task sends counts and sums per entry, which Spark adds up; the driver holds the
codebook alone (entries x dimensions numbers).

Rows whose vector is null, empty or holds null or non-finite components are dropped. All kept vectors
have one length, a multiple of the number of parts: the commonest such length (of equals the
smaller); rows of another length are dropped too. The first entries are those of the smallest ids; rows
without an id come last, equal ids are ordered by their vectors. With fewer rows than entries the
codebook has as many entries as rows. Ties of distance go to the lower index; repeated rows
count as often as they occur. An empty table gives no rows. Other columns, whatever their names,
never enter. Components of 2^26 or more after scaling raise an error, as squared distances could leave
64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, only

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Dictionary codes of a block: rows times dimensions.
BLOCK_CELLS = 1 << 20
#: Codes are 16-bit numbers, so a dictionary has at most 2^16 entries.
BLOCK_ROWS = 1 << 14
LIMIT = 1 << 26

SUM_SCHEMA = "part int, entry int, position int, n long, total long"


def usable(vector):
    """Not null, not empty, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def common_length(rows: DataFrame, column: str, multiple: int = 1) -> int | None:
    """The commonest length of the vectors among multiples of ``multiple``; of equals the smaller."""
    lengths = rows.groupBy(F.size(column).alias("n")).count().where(F.col("n") % multiple == 0)
    found = lengths.orderBy(F.col("count").desc(), "n").first()
    return found["n"] if found else None


@dataclass
class Block:
    """Rows of integers behind dictionaries: ``values[d][codes[:, d]]`` is dimension d."""

    codes: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def of(cls, rows: np.ndarray) -> Block:
        codes = np.empty(rows.shape, dtype=np.uint16)
        values = []
        for d in range(rows.shape[1]):
            distinct, codes[:, d] = np.unique(rows[:, d], return_inverse=True)
            values.append(distinct)
        return cls(codes, values)

    def assign(self, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every row and part; ``codebooks`` is part x entry x position."""
        parts, entries, width = codebooks.shape
        nearest = np.empty((len(self.codes), parts), dtype=np.int64)
        distance = np.empty((len(self.codes), parts), dtype=np.int64)
        for p in range(parts):
            sums = np.zeros((len(self.codes), entries), dtype=np.int64)
            for j in range(width):
                d = p * width + j
                table = (self.values[d][:, None] - codebooks[p, :, j][None, :]) ** 2
                sums += table[self.codes[:, d]]
            nearest[:, p] = sums.argmin(axis=1)
            distance[:, p] = sums.min(axis=1)
        return nearest, distance

    def totals(self, nearest: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows per part and entry, and sums of their integers per part, entry and position."""
        parts = nearest.shape[1]
        width = self.codes.shape[1] // parts
        counts = np.stack([np.bincount(nearest[:, p], minlength=entries) for p in range(parts)])
        sums = np.zeros((parts, entries, width), dtype=np.int64)
        for p in range(parts):
            for j in range(width):
                # Sums of a block stay below 2^53, where doubles are exact.
                column = self.values[p * width + j][self.codes[:, p * width + j]]
                sums[p, :, j] = np.bincount(nearest[:, p], weights=column, minlength=entries).astype(np.int64)
        return counts, sums

    def pack(self) -> tuple[bytes, list[int], bytes]:
        return self.codes.tobytes(), [len(v) for v in self.values], np.concatenate(self.values).astype(np.int32).tobytes()

    @classmethod
    def unpack(cls, codes: bytes, sizes: list[int], values: bytes) -> Block:
        flat = np.frombuffer(values, dtype=np.int32).astype(np.int64)
        return cls(np.frombuffer(codes, dtype=np.uint16).reshape(-1, len(sizes)), np.split(flat, np.cumsum(sizes)[:-1]))


def pack_blocks(rows: DataFrame, dims: int, id_type: str, label_type: str) -> DataFrame:
    """Blocks of (vec_id, label, v) rows: ids and labels as lists, integers as dictionary codes."""
    most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // dims))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                codes, sizes, values = Block.of(part.column(2).flatten().to_numpy().reshape(-1, dims)).pack()
                whole = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(whole, part.column(0)), pa.ListArray.from_arrays(whole, part.column(1)),
                        pa.array([codes]), pa.array([sizes], pa.list_(pa.int32())), pa.array([values]),
                    ],
                    ["ids", "labels", "codes", "sizes", "dictionary"],
                )

    return rows.mapInArrow(run, f"ids array<{id_type}>, labels array<{label_type}>, codes binary, sizes array<int>, dictionary binary")


def blocks_of(batch: pa.RecordBatch):
    names = batch.schema.names
    columns = [batch.column(names.index(c)) for c in ("codes", "sizes", "dictionary")]
    for row in zip(*columns, strict=True):
        yield Block.unpack(*[x.as_py() for x in row])


def improved(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Every entry as the rounded-down mean of the parts nearest to it; unused entries stay."""
    parts, entries, width = codebooks.shape
    shared = blocks.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        counts = np.zeros((parts, entries), dtype=np.int64)
        sums = np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            for block in blocks_of(batch):
                n, s = block.totals(block.assign(shared.value)[0], entries)
                counts += n
                sums += s
        part, entry, position = (x.ravel() for x in np.indices(sums.shape, dtype=np.int32))
        n = np.repeat(counts.ravel(), width)
        used = np.flatnonzero(n)
        columns = [part[used], entry[used], position[used], n[used], sums.ravel()[used]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "position", "n", "total"])

    added = blocks.select("codes", "sizes", "dictionary").mapInArrow(run, SUM_SCHEMA)
    # One row per number of the codebook comes back, whatever the size of the table.
    total = added.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    shared.unpersist()
    got = {c: total.column(c).to_numpy() for c in total.column_names}
    better = codebooks.copy()
    better[got["part"], got["entry"], got["position"]] = got["total"] // got["n"]
    return better


def encoded(blocks: DataFrame, codebooks: np.ndarray, id_type: str, label_type: str) -> DataFrame:
    """vec_id, label, code and error of every row of the blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(codebooks)
    digits = np.array([f"{k:02x}" for k in range(codebooks.shape[1])])

    def run(batches):
        for batch in batches:
            for k, block in enumerate(blocks_of(batch)):
                nearest, distance = block.assign(shared.value)
                code = digits[nearest[:, 0]]
                for p in range(1, nearest.shape[1]):
                    code = np.char.add(code, digits[nearest[:, p]])
                columns = [batch.column(0).slice(k, 1).flatten(), batch.column(1).slice(k, 1).flatten(), pa.array(code, pa.string()), pa.array(distance.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")


@dataclass
class Compressed:
    """The rows with their codes, and the codebooks as part x entry x position integers."""

    codes: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all integers in decimal, in the order part, entry, position, with commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> Compressed:
    """Codes (vec_id, label, code, error) of all usable rows, one byte of code per part, and the codebooks."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    if entries > 256:
        raise ValueError("a code is one byte: at most 256 entries")
    rows = only(vectors, id_column, label, vector).toDF("vec_id", "label", "v")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.withColumn("v", F.col("v").cast("array<double>")).where(usable(F.col("v")))
    dims = common_length(rows, "v", parts)
    if dims is None:
        empty = spark.createDataFrame([], f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")
        return Compressed(empty, np.zeros((parts, 0, 0), dtype=np.int64))
    outside = F.raise_error(F.lit(f"a component of {LIMIT} or more after scaling"))
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale)).otherwise(outside))
    numbers = rows.where(F.size("v") == dims).withColumn("v", whole)
    first = numbers.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    start = np.array(first.column("v").to_pylist(), dtype=np.int64)
    codebooks = np.ascontiguousarray(start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))
    blocks = scratch.settle(pack_blocks(numbers, dims, types["vec_id"], types["label"]), "blocks")
    for _ in range(rounds):
        codebooks = improved(blocks, codebooks)
    codes = scratch.settle(encoded(blocks, codebooks, types["vec_id"], types["label"]), "codes")
    scratch.drop("blocks")
    return Compressed(codes, codebooks)


def with_label_errors(found: Compressed) -> DataFrame:
    """vec_id, code, error, the error summed over equal labels (nulls together), and the digest of the codebooks."""
    scratch = Scratch(found.codes.sparkSession, "label-errors")
    sums = found.codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    # Written, the sums have a known size, by which Spark chooses between a broadcast and a shuffle join.
    sums = scratch.settle(sums, "sums")
    joined = found.codes.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))
