"""WARC records and a Merkle audit of replicas (operator 10).

Every record has a digest and a place (file, offset, length). A file's tree has the records that begin
in one range of offsets under one leaf, and a fixed number of neighbouring ranges under
every node above; a node's hash covers the places and digests, or the hashes, of what is
below in order. Two replicas are compared from the roots down: a level is read only below the
nodes that differ, until the differing leaves are opened and their records compared. Sound
replicas cost one comparison of roots; the records of sound branches are never joined.

Hashing, trees and descent are DataFrame expressions; a group is never larger than a leaf's
range of offsets or a node's children. Only digests and places are shuffled, not contents.

Null contents are empty payloads; a null URL is written empty; null page ids share files of
their own by a hash of the content. Pages of one id lie in one file, ordered by URL and
content. Empty replicas have no trees and no differences.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch

#: Page ids that share a file.
FILE_PAGES = 256
#: Bytes of offsets under a leaf, and children of an inner node.
RANGE_BYTES = 1 << 16
FAN = 8
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"

READ_SCHEMA = "file string, offset long, length long, record_id string, uri string, payload binary, digest string"
FINDING_SCHEMA = "file string, offset long, status string, length long, expected_sha256 string, found_sha256 string"


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """One resource record: head lines, an empty line, the payload and the record's end."""
    payload = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit(_END), payload, F.lit(_END),
    )


def file_name(page_id: Column, html: Column, file_pages: int = FILE_PAGES) -> Column:
    number = F.floor(page_id / F.lit(file_pages)).cast("string")
    spread = F.concat(F.lit("none-"), F.pmod(F.xxhash64(html), F.lit(64)).cast("string"))
    return F.concat(F.lit("pages-"), F.when(page_id.isNotNull(), number).otherwise(spread), F.lit(".warc"))


def records(pages: DataFrame, html: Column | None = None, keep_text: bool = False, file_pages: int = FILE_PAGES) -> DataFrame:
    """file, offset, length and digest of the records that ``pages`` (page_id, url, html) make.

    Places follow the original pages; ``html`` gives other payloads of the same length,
    as a damaged replica holds them. Only places and digests go through the shuffle unless the text is kept.
    """
    page_id, url, own = F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    text = record_text(page_id, url, own if html is None else html)
    made = pages.select(
        file_name(page_id, own, file_pages).alias("file"), page_id.alias("page_id"), F.struct(page_id, url, F.xxhash64(own)).alias("place"),
        F.octet_length(record_text(page_id, url, own)).cast("long").alias("length"), F.sha2(text, 256).alias("digest"), *([text.alias("record")] if keep_text else []),
    )
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("file", "offset", "length", "digest", *(["record"] if keep_text else []))


def write_warc(kept: DataFrame, folder: str) -> None:
    """One WARC file per ``file`` of records with their text, in offset order."""
    body = F.expr(f"substring(record, 1, length(record) - {len(_END)})")
    ordered = kept.repartition("file").sortWithinPartitions("file", "offset")
    ordered.select("file", body.alias("value")).write.partitionBy("file").option("lineSep", _END).text(folder)


def parse_records(data: bytes):
    """(offset, length, head fields, payload) of the records of one file; a broken record ends the file's list with what is left."""
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        fields: dict[str, str] = {}
        if head_end >= 0 and data.startswith(b"WARC/", at):
            for line in data[at:head_end].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        size = fields.get("content-length", "")
        begin = head_end + 4
        stop = begin + int(size) + 4 if size.isdecimal() and len(size) < 16 else len(data) + 1
        if stop > len(data):
            yield at, len(data) - at, fields, data[begin:] if fields else data[at:]
            return
        yield at, stop - at, fields, data[begin : stop - 4]
        at = stop


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all WARC files below a folder of ``write_warc``, read file by file."""

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = data.as_py()
                rows = [
                    (name, at, length, fields.get("warc-record-id"), fields.get("warc-target-uri"), payload, hashlib.sha256(content[at : at + length]).hexdigest())
                    for at, length, fields, payload in parse_records(content)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()))],
                        ["file", "offset", "length", "record_id", "uri", "payload", "digest"],
                    )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    name = F.regexp_extract("path", "file=([^/]+)/", 1)
    return files.select(name.alias("file"), "content").mapInArrow(parse, READ_SCHEMA)


def leaves(replica: DataFrame, range_bytes: int) -> DataFrame:
    """(file, node, hash) of each range of offsets that records begin in."""
    entry = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 19, "0"), "length", "digest")
    of = F.floor(F.col("offset") / F.lit(range_bytes)).cast("long")
    return replica.groupBy("file", of.alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("hash"))


def parents(level: DataFrame, fan: int) -> DataFrame:
    entry = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 19, "0"), "hash")
    return level.groupBy("file", F.floor(F.col("node") / F.lit(fan)).cast("long").alias("node")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("hash")
    )


def tree(replica: DataFrame, levels: int, scratch: Scratch, name: str, range_bytes: int, fan: int) -> list[DataFrame]:
    """All levels, leaves first, roots last; each is written once and read by the descent."""
    found = [scratch.settle(leaves(replica, range_bytes), f"{name}0")]
    for k in range(1, levels + 1):
        found.append(scratch.settle(parents(found[-1], fan), f"{name}{k}"))
    return found


def differing(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    both = left.withColumnRenamed(value, "expected").join(right.withColumnRenamed(value, "found"), keys, "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")))


def audit(master: DataFrame, copy: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """file, offset and status (changed, missing, added) of the records in which two replicas differ.

    Both are tables of records: file, offset, length, digest. Records of the same place are compared;
    repeated places compare as the set of their digests.
    """
    spark = master.sparkSession
    scratch = Scratch(spark, "audit")
    one, two = (scratch.settle(r.select("file", "offset", "length", "digest"), n) for r, n in ((master, "master"), (copy, "copy")))
    last = one.union(two).agg(F.max("offset")).first()[0] or 0
    levels, nodes = 0, last // range_bytes + 1
    while nodes > 1:
        nodes, levels = -(-nodes // fan), levels + 1
    first, second = (tree(r, levels, scratch, n, range_bytes, fan) for r, n in ((one, "m"), (two, "c")))
    suspect = differing(first[-1], second[-1], ["file", "node"], "hash").select("file", "node")
    for level in range(levels - 1, -1, -1):
        parent = [F.floor(F.col("node") / F.lit(fan)).cast("long").alias("parent")]
        above = suspect.withColumnRenamed("node", "parent")
        near, far = (side[level].select("*", *parent).join(above, ["file", "parent"], "left_semi").drop("parent") for side in (first, second))
        suspect = differing(near, far, ["file", "node"], "hash").select("file", "node")
    suspect = scratch.settle(suspect, "suspect")
    of = F.floor(F.col("offset") / F.lit(range_bytes)).cast("long").alias("node")

    def opened(side: DataFrame, name: str) -> DataFrame:
        rows = side.select("*", of).join(suspect, ["file", "node"], "left_semi")
        return rows.groupBy("file", "offset").agg(F.array_join(F.array_sort(F.collect_set("digest")), ",").alias(name), F.max("length").alias(f"{name}_length"))

    both = opened(one, "expected_sha256").join(opened(two, "found_sha256"), ["file", "offset"], "full_outer")
    status = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("expected_sha256").isNull(), "added").otherwise("changed")
    return both.where(~F.col("expected_sha256").eqNullSafe(F.col("found_sha256"))).select(
        "file", "offset", status.alias("status"), F.coalesce("expected_sha256_length", "found_sha256_length").alias("length"), "expected_sha256", "found_sha256"
    )


def damaged(html: Column, page_id: Column) -> Column:
    """The payload as a failing disk returns it: one byte turned in some pages, zeros in others; the length stays."""
    turned = F.concat(F.lit("?"), F.substr(html, F.lit(2)))
    plain = F.octet_length(F.substring(html, 1, 1)) == 1
    zeroed = F.repeat(F.lit("\u0000"), F.octet_length(html))
    return F.when((page_id % 97 == 13) & plain, turned).when(page_id % 389 == 7, zeroed).otherwise(html)
