"""SimHash near-duplicates found through tables of distances to pivots (operator 4).

Distances from a fingerprint to fixed reference fingerprints (pivots) are its coordinates. By the
triangle inequality two fingerprints within r bits differ by at most r in every coordinate.

Two families of pivots are used. A base pivot and its copies with one small field of bits
flipped tell, from the difference of two distances, how many bits of that field differ from
the base. The fields form six groups; of two fingerprints within three bits at least three groups
have the same field weights, so they meet in one of the 20 cells that three groups name. In a
cell, pairs whose distances to any of the scattered pivots differ by more than r are discarded,
and the rest are verified bit by bit. No link is lost, and a cell gives back a spanning forest
of its links, not all pairs. Cells with many fingerprints are split in parts that meet pairwise
in tasks of their own, so no task holds a whole hot cell.

Equal fingerprints are one node, so copies are never paired with each other. Links, nodes and
components stay in tables; nothing of them passes through the driver.

Null and empty texts have fingerprint zero and are linked like any other. A null doc_id is
never the smallest of its component; a component of such rows alone has a null id. Repeated
rows share a fingerprint and each gives its row. An empty table gives no rows. Texts come to the
workers in small batches, and a text of any length is taken a run of words at a time.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, bytes_of, shuffle_width
from gaugeline.llm.components import components

BITS = 64
SEED = 42
FIELD_BITS = 2
GROUPS = 6
#: Pivots scattered over the space, besides the base and its copies with one field flipped.
SCATTERED = 16
#: Fingerprints of one cell that meet in one task.
CELL_PART = 2048
#: Cells up to this size are compared pair by pair at once.
SMALL_CELL = 16
#: Bytes of a text whose words and shingles are held at a time.
BYTES_AT_ONCE = 1 << 16
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Texts of a batch that goes to a worker.
BATCH_TEXTS = 1000


def pivots() -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """The base pivot, the masks of its fields, and the scattered pivots: hashes of their numbers."""
    base = np.uint64(xxhash.xxh64_intdigest(b"base", SEED))
    field = (1 << FIELD_BITS) - 1
    masks = np.array([field << k for k in range(0, BITS, FIELD_BITS)], dtype=np.uint64)
    scattered = np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(SCATTERED)], dtype=np.uint64)
    return base, masks, scattered


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The table of Hamming distances, a row per fingerprint and a column per reference."""
    return np.bitwise_count(prints[:, None] ^ references[None, :])


def cells(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """Cell numbers of each fingerprint, a column per choice of groups that may all be untouched."""
    base, masks, _ = pivots()
    to_base = np.bitwise_count(prints ^ base).astype(np.int64)
    weights = (to_base[:, None] - distances(prints, base ^ masks).astype(np.int64) + FIELD_BITS) // 2
    groups = np.array_split(np.arange(len(masks)), GROUPS)
    chosen = list(itertools.combinations(range(GROUPS), GROUPS - radius))
    result = []
    for number, choice in enumerate(chosen):
        cell = np.full(len(prints), number, dtype=np.int64)
        for k in np.concatenate([groups[g] for g in choice]):
            cell = cell * (FIELD_BITS + 1) + weights[:, k]
        result.append(cell)
    return result


def runs_of_words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, A-Z lower-cased, as many at a time as ``BYTES_AT_ONCE`` hold."""
    at = 0
    while at < len(data):
        # A word that the end falls into is taken whole.
        space = SPACE.search(data, at + BYTES_AT_ONCE)
        end = space.start() if space else len(data)
        yield data[at:end].lower().split()
        at = end


def fingerprint(data: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of UTF-8 bytes, A-Z lower-cased."""
    digest = xxhash.xxh64_intdigest
    counts, n, words = np.zeros(BITS, dtype=np.int64), 0, []
    for run in runs_of_words(data):
        # The last words of the runs before begin the shingles that reach into this one.
        words = words[max(0, len(words) - width + 1) :] + run
        if len(words) < width:
            continue
        text = b" ".join(words)
        ends = list(itertools.accumulate((len(w) + 1 for w in words), initial=-1))
        # A shingle runs from behind the space before its first word to the end of its last.
        part = [digest(text[a + 1 : b], SEED) for a, b in zip(ends, ends[width:])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    if not n:
        return digest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def row_key() -> Column:
    """A hash of a row's id and text; the sign of a missing id keeps it apart from others."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, the key of the row and the fingerprint as a signed long, one row per row of ``docs``."""

    def make(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in bytes_of(batch.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64), pa.int64())], ["doc_id", "row", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id long, row long, print long")


def within(left: np.ndarray, right: np.ndarray, left_table: np.ndarray, right_table: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs link: the coordinates discard pairs one after another, the rest are verified."""
    alive = np.arange(len(right))
    one = len(left) == 1
    for k in range(left_table.shape[1]):
        a = left_table[0, k] if one else left_table[alive, k]
        alive = alive[np.abs(right_table[alive, k] - a) <= radius]
        if not len(alive):
            return alive
    a = left[0] if one else left[alive]
    return alive[np.bitwise_count(right[alive] ^ a) <= radius]


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of one cell that join all that its links join: each fingerprint is reached once."""
    _, _, scattered = pivots()
    table = distances(prints, scattered).astype(np.int16)
    left = np.arange(len(prints))
    links = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = within(prints[at : at + 1], prints[left], table[at : at + 1], table[left], radius)
            if len(hit):
                found = left[hit]
                links += [(at, int(k)) for k in found]
                queue += found.tolist()
                left = np.delete(left, hit)
    return links


def link_cells(radius: int):
    def link(bucket: pa.Table) -> pa.Table:
        cell = np.column_stack([bucket.column(c).to_numpy() for c in ("cell", "part_a", "part_b")])
        prints = bucket.column("print").to_numpy().view(np.uint64)
        order = np.lexsort((prints, cell[:, 2], cell[:, 1], cell[:, 0]))
        cell, prints = cell[order], prints[order]
        edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[edges, len(prints)])
        number = np.repeat(np.arange(len(sizes)), sizes)
        a, b = [], []
        _, _, scattered = pivots()
        small = sizes <= SMALL_CELL
        inside = np.flatnonzero(small[number])
        if len(inside):
            few, of = prints[inside], number[inside]
            table = distances(few, scattered).astype(np.int16)
            for shift in range(1, int(sizes[small].max())):
                left = np.flatnonzero(of[shift:] == of[:-shift])
                if not len(left):
                    break
                hit = left[within(few[left], few[left + shift], table[left], table[left + shift], radius)]
                a.append(few[hit])
                b.append(few[hit + shift])
        for k in np.flatnonzero(~small):
            members = prints[edges[k] : edges[k] + sizes[k]]
            links = np.array(forest(members, radius), dtype=np.int64).reshape(-1, 2)
            a.append(members[links[:, 0]])
            b.append(members[links[:, 1]])
        pairs = np.column_stack([np.concatenate([np.zeros(0, np.uint64), *a]), np.concatenate([np.zeros(0, np.uint64), *b])]).view(np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return link


def near_links(prints: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all that are within ``radius`` bits."""

    def deal(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            columns = cells(own.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(columns), pa.int64()), pa.array(np.tile(own, len(columns)), pa.int64())], ["cell", "print"]
            )

    # So many tasks that the cells counted in one are few: most cells hold one fingerprint, so counts are as many as rows.
    width = shuffle_width(scratch.spark)
    dealt = prints.repartition(width).mapInArrow(deal, "cell long, print long")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / F.lit(CELL_PART)).cast("int")
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    # A part meets every part of its cell, itself too, in the task of the two numbers.
    met = (
        dealt.join(sizes, "cell").withColumn("parts", parts).withColumn("own", own)
        .withColumn("other", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        .select("cell", "print", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"))
    )
    bucketed = met.withColumn("bucket", F.pmod(F.xxhash64("cell", "part_a", "part_b"), F.lit(8 * width)).cast("int"))
    return bucketed.groupBy("bucket").applyInArrow(link_cells(radius), "a long, b long")


def grouped(docs: DataFrame, radius: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints, and the root fingerprint of each distinct one."""
    if not 0 <= radius < GROUPS:
        raise ValueError(f"radius must be below {GROUPS}")
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.settle(fingerprints(docs, width), "prints", BATCH_TEXTS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = prints.groupBy("print").agg(first)
    found = components(near_links(nodes.select("print"), radius, scratch), scratch)
    rooted = nodes.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    return prints, rooted


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    prints, rooted = grouped(docs, radius, width)
    smallest = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    of_print = rooted.select("print", "root").join(smallest, "root").select("print", "component_id")
    return prints.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """The row of the smallest doc_id of every component (rows without an id come last), one row of repeated ones."""
    _, rooted = grouped(docs, radius, width)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    return docs.withColumn("__row", row_key()).join(kept, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
