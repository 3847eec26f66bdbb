"""Removal of repeated byte strings by blocks of hashed suffixes behind a cover-sample filter (operator 1).

Every byte covered by a string of ``match`` bytes that also starts earlier (smaller doc_id, or
the same document and an earlier start) is removed; strings never cross documents.

1. Texts are laid out in document order in blocks of about half a MB, written once.
2. Cover samples: the places of a text whose offset modulo the period is in a difference
   cover. Any two places have a common distance below the period at which both meet a
   sample, so two equal strings hold two samples that agree on ``match - period + 1`` bytes.
   Hashes of that many bytes are grouped, one block of buckets after another; those that occur
   twice or more are kept. They are a filter, not ranks.
3. A suffix takes part only if a sample in its first ``period`` bytes has a hash that is kept: all others
   cannot have an equal one. Only the bytes of these suffixes are kept.
4. These suffixes are grouped by 80-bit hashes of their first ``match`` bytes, again one block of buckets
   after another; no suffix is ordered against another, and equal hashes are not compared byte by byte. In
   every group the first suffix stays and the others are marked.

The number of blocks is fixed, so a block's memory and disk follow a fixed part of the corpus; its shuffle files go before
the next begins. A block of text sends at most one suffix per tie, so a string that a third of
all texts share puts one entry per block in its bucket.

Null texts are empty; a null doc_id counts as smaller than any other. Rows with one doc_id
are ordered by a hash of their text, then by the text; of repeated rows one is the first. Texts shorter than ``match``
bytes stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, release, shuffle_width, tidy

#: Perfect difference sets: every distance modulo the period is a difference of two members.
COVERS = {
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
BLOCK_BYTES = 1 << 19
#: Blocks of an Arrow batch.
BATCH_BLOCKS = 16
#: Blocks of suffix buckets, sorted one after another: for the cover samples, and for the suffixes.
SAMPLE_PASSES, PASSES = 2, 4
#: Bytes of sort entries in a bucket, for texts of which a quarter repeats.
BUCKET_BYTES = 8 << 20
#: Key, second fingerprint and place of a suffix.
ENTRY_BYTES = 14
_FAR = 65535
_FIRST = -(1 << 63)
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

BLOCK_SCHEMA = "block long, ids binary, lengths binary, data binary, carried array<string>"
BUCKET_SCHEMA = "bucket int, block long, entries binary, marked binary"
PLACES_SCHEMA = "block long, places binary"
SUFFIX_SCHEMA = "block long, starts binary, lengths binary, data binary"
KEPT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, carried string"


def words_at(data: bytes) -> np.ndarray:
    """The eight bytes from every place of ``data`` as one number, zero bytes behind the end."""
    padded = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def fingerprints(words: np.ndarray, places: np.ndarray, length: int, two: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """A 64-bit fingerprint of the ``length`` bytes from each place, and 16 bits of a second one."""
    first = np.full(len(places), length, dtype=np.uint64)
    second = np.full(len(places), ~np.uint64(length), dtype=np.uint64) if two else None
    for offset in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        word = words[places + offset]
        first ^= word
        first *= _ODD1
        first ^= first >> np.uint64(32)
        if two:
            second += word
            second *= _ODD2
            second ^= second >> np.uint64(29)
    first *= _ODD2
    first ^= first >> np.uint64(29)
    return first, (second >> np.uint64(48)).astype(np.uint16) if two else None


def gaps(places: np.ndarray) -> bytes:
    """Sorted places as their distances in 16 bits; a far one is reached in steps of 65535 that stand for no place."""
    step = np.diff(places.astype(np.int64), prepend=0)
    far, rest = step // _FAR, (step % _FAR).astype(np.uint16)
    if far.any():
        out = np.full(len(step) + int(far.sum()), _FAR, dtype=np.uint16)
        out[np.cumsum(far + 1) - 1] = rest
        rest = out
    return rest.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, dtype=np.uint16)
    return np.cumsum(step, dtype=np.int64)[step != _FAR]


def runs_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one after another."""
    total = int(counts.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def groups_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each stretch of equal values."""
    if not len(values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return edges, np.r_[edges[1:], len(values)]


class Plan:
    """The difference cover for a match length."""

    def __init__(self, match: int) -> None:
        if match < 24:
            raise ValueError("strings of 24 bytes or more can be matched")
        self.match = match
        self.period = max(p for p in COVERS if p <= 0.6 * match)
        self.cover = np.array(COVERS[self.period], dtype=np.int64)
        self.depth = match - self.period + 1
        # The leading bytes that decide in which block of buckets a suffix is sorted.
        self.lead = min(16, self.depth // 8 * 8)

    def samples(self, lengths: np.ndarray) -> np.ndarray:
        """Places of the cover samples of texts laid end to end; texts too short for a match have none."""
        room = np.where(lengths >= self.match, lengths - self.depth, -1)
        if not len(room) or room.max() < 0:
            return np.zeros(0, dtype=np.int64)
        grid = (np.arange(int(room.max()) // self.period + 1)[:, None] * self.period + self.cover).ravel()
        counts = np.searchsorted(grid, room, side="right")
        offsets = grid[runs_of(np.zeros(len(counts), dtype=np.int64), counts)]
        return offsets + np.repeat(np.cumsum(lengths) - lengths, counts)


def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, texts, carried, size = [], [], [], 0

    def block():
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
                pa.array([np.array([len(t) for t in texts], dtype=np.int64).tobytes()], pa.binary()),
                pa.array([b"".join(texts)], pa.binary()),
                pa.array([carried], pa.list_(pa.string())),
            ],
            ["block", "ids", "lengths", "data", "carried"],
        )

    for batch in batches:
        for doc_id, text, extra in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            carried.append(extra.as_py())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield block()
                number += 1
                ids, texts, carried, size = [], [], [], 0
    if ids:
        yield block()


def by_bucket(block: int, keys: np.ndarray, entries: list[np.ndarray], marked: np.ndarray | None, marked_keys: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """One row per bucket that has entries: their columns one after another, in key order."""
    bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges, ends = groups_of(bucket)
    columns = [e[order] for e in entries]
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(edges, ends, strict=True)]
    extra = [None] * len(edges)
    if marked is not None and len(marked):
        # A marked suffix has an equal one in this block, so its bucket has a row.
        home = ((marked_keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        home, places = home[by], marked[by]
        low, high = np.searchsorted(home, bucket[edges], side="left"), np.searchsorted(home, bucket[edges], side="right")
        extra = [places[a:b].tobytes() if b > a else None for a, b in zip(low, high, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[edges], pa.int32()), pa.array([block] * len(edges), pa.int64()), pa.array(blobs, pa.binary()), pa.array(extra, pa.binary())],
        ["bucket", "block", "entries", "marked"],
    )


def longs(column: pa.Array, row: int) -> np.ndarray:
    return np.frombuffer(column[row].as_py(), dtype=np.int64)


def of_pass(plan: Plan, words: np.ndarray, places: np.ndarray, number: int, passes: int) -> np.ndarray:
    """Which places belong to a block of buckets, by their leading bytes."""
    lead, _ = fingerprints(words, places, plan.lead)
    return np.flatnonzero((lead >> np.uint64(24)) % np.uint64(passes) == number)


def sample_keys(plan: Plan, words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return fingerprints(words, places, plan.depth)[0] & ~np.uint64(1)


def deal_samples(plan: Plan, number: int, passes: int, buckets: int):
    def deal(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                words, places = words_at(batch.column("data")[row].as_py()), plan.samples(longs(batch.column("lengths"), row))
                mine = places[of_pass(plan, words, places, number, passes)]
                keys, counts = np.unique(sample_keys(plan, words, mine), return_counts=True)
                # The lowest bit says that the block itself holds the sample twice.
                yield by_bucket(batch.column("block")[row].as_py(), keys, [keys | (counts > 1)], None, None, buckets)

    return deal


def rank_samples(bucket: pa.Table) -> pa.Table:
    """The samples of a bucket whose rank another sample shares, by block."""
    parts = [np.frombuffer(e.as_py(), dtype=np.uint64) for e in bucket.column("entries")]
    keys = np.concatenate(parts)
    block = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(keys, kind="stable")
    name = keys[order] >> np.uint64(1)
    new = np.r_[True, name[1:] != name[:-1]]
    rank = np.cumsum(new) - 1
    shared = (np.bincount(rank) > 1) | (np.bincount(rank, weights=keys[order] & np.uint64(1)) > 0)
    hit = order[shared[rank]]
    found = per_block(bucket.column("block"), block[hit], keys[hit] & ~np.uint64(1), np.ndarray.tobytes)
    release()
    return found


def per_block(numbers: pa.ChunkedArray, block: np.ndarray, values: np.ndarray, pack) -> pa.Table:
    order = np.argsort(block, kind="stable")
    block, values = block[order], values[order]
    edges, ends = groups_of(block)
    names = numbers.to_pylist()
    return pa.table({
        "block": pa.array([names[block[a]] for a in edges], pa.int64()),
        "places": pa.array([pack(np.sort(values[a:b])) for a, b in zip(edges, ends, strict=True)], pa.binary()),
    })


def keep_suffixes(plan: Plan):
    """Of each block, the stretches where a suffix has a sample of shared rank in reach."""

    def keep(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data, lengths = batch.column("data")[row].as_py(), longs(batch.column("lengths"), row)
                places = plan.samples(lengths)
                keys = sample_keys(plan, words_at(data), places)
                shared = np.sort(np.frombuffer(b"".join(batch.column("shared")[row].as_py()), dtype=np.uint64))
                at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
                places = places[shared[at] == keys]
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, places, side="right")
                low = np.maximum(places - plan.period + 1, ends[doc] - lengths[doc])
                high = np.minimum(places, ends[doc] - plan.match)
                low, high = low[high >= low], high[high >= low]
                if not len(low):
                    continue
                # low and high rise together: stretches that touch are one, unless a text ends between.
                doc = np.searchsorted(ends, low, side="right")
                new = np.r_[True, (low[1:] > high[:-1] + 1) | (doc[1:] != doc[:-1])]
                first = np.flatnonzero(new)
                starts, stops = low[first], np.maximum.reduceat(high, first) + 1
                pieces = [data[a : b + plan.match - 1] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(row, 1), pa.array([starts.tobytes()], pa.binary()), pa.array([(stops - starts).tobytes()], pa.binary()), pa.array([b"".join(pieces)], pa.binary())],
                    ["block", "starts", "lengths", "data"],
                )

    return keep


def deal_suffixes(plan: Plan, number: int, passes: int, buckets: int):
    def deal(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                starts, counts = longs(batch.column("starts"), row), longs(batch.column("lengths"), row)
                widths = counts + plan.match - 1
                local = runs_of(np.cumsum(widths) - widths, counts)
                words = words_at(batch.column("data")[row].as_py())
                mine = of_pass(plan, words, local, number, passes)
                place = runs_of(starts, counts)[mine].astype(np.uint32)
                key, check = fingerprints(words, local[mine], plan.match, two=True)
                order = tie_order(key, check, place)
                key, check, place = key[order], check[order], place[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])] if len(key) else np.zeros(0, dtype=bool)
                yield by_bucket(batch.column("block")[row].as_py(), key[new], [key[new], check[new], place[new]], place[~new], key[~new], buckets)

    return deal


def tie_order(key: np.ndarray, check: np.ndarray, *later: np.ndarray) -> np.ndarray:
    """Order by key, second fingerprint and then as given; the second one matters only where keys collide."""
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_check = key[order], check[order]
    if ((sorted_key[1:] == sorted_key[:-1]) & (sorted_check[1:] != sorted_check[:-1])).any():
        order = np.lexsort((*reversed(later), check, key))
    return order


def mark_ties(bucket: pa.Table) -> pa.Table:
    """The suffixes of a bucket that tie with an earlier one, by block; also those marked inside their block."""
    numbers = np.array(bucket.column("block").to_pylist())
    rows = np.argsort(numbers, kind="stable")
    entries, marked = bucket.column("entries"), bucket.column("marked")
    keys, checks, places, blocks, old, old_blocks = [], [], [], [], [], []
    for row in rows.tolist():
        blob = entries[row].as_py()
        n = len(blob) // ENTRY_BYTES
        keys.append(np.frombuffer(blob, dtype=np.uint64, count=n))
        checks.append(np.frombuffer(blob, dtype=np.uint16, count=n, offset=8 * n))
        places.append(np.frombuffer(blob, dtype=np.uint32, count=n, offset=10 * n))
        blocks.append(np.full(n, row))
        if (inside := marked[row].as_py()) is not None:
            old.append(np.frombuffer(inside, dtype=np.uint32))
            old_blocks.append(np.full(len(old[-1]), row))
    key, check, place, block = map(np.concatenate, (keys, checks, places, blocks))
    order = tie_order(key, check, np.argsort(rows)[block], place)
    key, check = key[order], check[order]
    late = order[np.r_[False, (key[1:] == key[:-1]) & (check[1:] == check[:-1])]]
    found = per_block(bucket.column("block"), np.concatenate([block[late], *old_blocks]), np.concatenate([place[late], *old]), gaps)
    release()
    return found


def cut_runs(plan: Plan, whole_characters: bool):
    """Every text without the bytes that marked suffixes cover, and without parts of characters if wanted."""

    def cut(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data, lengths, ids = batch.column("data")[row].as_py(), longs(batch.column("lengths"), row), longs(batch.column("ids"), row)
                parts = batch.column("places")[row].as_py() or []
                places = np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *map(from_gaps, parts)]))
                ends = np.cumsum(lengths)
                starts = ends - lengths
                doc = np.searchsorted(ends, places, side="right")
                if len(places):
                    first = np.flatnonzero(np.r_[True, (places[1:] > places[:-1] + plan.match) | (doc[1:] != doc[:-1])])
                    run_doc, run_start = doc[first], places[first]
                    run_end = places[np.r_[first[1:], len(places)] - 1] + plan.match
                else:
                    run_doc = run_start = run_end = np.zeros(0, dtype=np.int64)
                spans = np.bincount(run_doc, minlength=len(ids))
                removed = np.bincount(run_doc, weights=run_end - run_start, minlength=len(ids)).astype(np.int64)
                at, kept = 0, []
                for k in range(len(ids)):
                    begin, parts = int(starts[k]), []
                    for _ in range(int(spans[k])):
                        parts.append(data[begin : int(run_start[at])])
                        begin = int(run_end[at])
                        at += 1
                    parts.append(data[begin : int(ends[k])])
                    left = b"".join(parts)
                    kept.append(left.decode("utf-8", "ignore").encode() if whole_characters and len(parts) > 1 else left)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=ids == _FIRST), pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()),
                        pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(batch.column("carried")[row].as_py(), pa.string()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "carried"],
                )

    return cut


def remove_repeats(docs: DataFrame, match: int = 100, passes: int = PASSES, carry: Sequence[str] = (), whole_characters: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, bytes, removed bytes and runs, the kept bytes, and ``carry`` columns as JSON text.

    ``whole_characters`` drops what is left of a character that a removed run cut.
    """
    spark, plan = docs.sparkSession, Plan(match)
    scratch = Scratch(spark, "suffixes")
    carried = F.to_json(F.struct(*[F.col(f"`{c}`") for c in carry])) if carry else F.lit(None).cast("string")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), carried.alias("carried"),
    )
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    width = shuffle_width(spark)
    by = F.xxhash64("text")
    ranged = rows.repartitionByRange(max(width, math.ceil(total / (32 << 20))), F.col("id"), by).sortWithinPartitions(F.col("id"), by, F.col("text"))
    # A row group is checked for its size after 100 rows at the earliest; a row is a block.
    blocks = scratch.settle(ranged.mapInArrow(tidy(pack_blocks), BLOCK_SCHEMA), "blocks", 1000, parquet__block__size=str(16 << 20))

    # Buckets follow the bytes, not the number of partitions: every bucket gives a row per block.
    buckets = max(2 * spark.sparkContext.defaultParallelism, math.ceil(total / passes * 0.25 * ENTRY_BYTES / BUCKET_BYTES))
    for number in range(SAMPLE_PASSES):
        dealt = blocks.select("block", "lengths", "data").mapInArrow(tidy(deal_samples(plan, number, SAMPLE_PASSES, buckets)), BUCKET_SCHEMA)
        scratch.add(dealt.groupBy("bucket").applyInArrow(rank_samples, PLACES_SCHEMA), "ranks", BATCH_BLOCKS)
    shared = scratch.read("ranks", "block long, places binary").groupBy("block").agg(F.collect_list("places").alias("shared"))
    suffixes = scratch.settle(
        blocks.select("block", "lengths", "data").join(shared, "block").mapInArrow(tidy(keep_suffixes(plan)), SUFFIX_SCHEMA), "suffixes", BATCH_BLOCKS, parquet__block__size=str(16 << 20)
    )
    scratch.drop("ranks")
    for number in range(passes):
        dealt = suffixes.mapInArrow(tidy(deal_suffixes(plan, number, passes, buckets)), BUCKET_SCHEMA)
        scratch.add(dealt.groupBy("bucket").applyInArrow(mark_ties, PLACES_SCHEMA), "ties", BATCH_BLOCKS)
    scratch.drop("suffixes")
    ties = scratch.read("ties", "block long, places binary").groupBy("block").agg(F.collect_list("places").alias("places"))
    cut = blocks.join(ties, "block", "left").mapInArrow(tidy(cut_runs(plan, whole_characters)), KEPT_SCHEMA)
    kept = scratch.settle(cut, "kept", BATCH_BLOCKS, parquet__block__size=str(16 << 20))
    scratch.drop("ties")
    scratch.drop("blocks")
    return kept
