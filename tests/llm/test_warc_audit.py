"""WARC files written and read back, and differences found by the tree against a plain comparison."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import warc_audit as W


def pages(spark, n=60):
    rng = random.Random(4)
    rows = [(k, f"http://x/{k}", "é<p>" + "word " * rng.randrange(0, 300) + "\r\n\r\nWARC/1.0\r\n") for k in range(n)]
    rows += [(None, None, None), (None, "u", "text"), (3, "http://x/3", rows[3][2]), (5, "http://x/other", "")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")


def test_files_round_trip(spark, tmp_path):
    kept = W.records(pages(spark), keep_text=True, file_pages=16)
    folder = str(tmp_path / "archive")
    W.write_warc(kept, folder)
    got = {(r.file, r.offset): r for r in W.read_warc(spark, folder).collect()}
    want = {(r.file, r.offset): r for r in kept.collect()}
    assert set(got) == set(want)
    for key, r in want.items():
        assert (got[key].length, got[key].digest) == (r.length, r.digest) == (len(r.record.encode()), hashlib.sha256(r.record.encode()).hexdigest())
        assert got[key].payload.decode() == r.record.split("\r\n\r\n", 1)[1][:-4]
    assert W.audit(W.read_warc(spark, folder), kept, range_bytes=512, fan=2).collect() == []
    # One byte turned on disk is found in its record.
    some = next((tmp_path / "archive").glob("file=*/part-*"))
    data = bytearray(some.read_bytes())
    data[len(data) // 2] ^= 1
    some.with_name(".crc-free").write_bytes(b"")
    for extra in some.parent.glob(".*.crc"):
        extra.unlink()
    some.write_bytes(bytes(data))
    hit = W.audit(kept, W.read_warc(spark, folder), range_bytes=512, fan=2).collect()
    inside = [r for r in hit if r.offset <= len(data) // 2 < r.offset + r.length]
    assert len(inside) == 1 and inside[0].status in ("changed", "missing")


@pytest.mark.parametrize("range_bytes,fan", [(256, 2), (1000, 3), (1 << 20, 8)])
def test_differences(spark, range_bytes, fan):
    rng = random.Random(range_bytes)
    rows = [(f"f{k % 3}", 100 * (k // 3), 100, f"{k:064x}") for k in range(200)]
    other = [r for r in rows if rng.random() > 0.02]
    other = [(a, b, c, "x" + d[1:]) if rng.random() < 0.03 else (a, b, c, d) for a, b, c, d in other] + [("f1", 55, 3, "new"), ("f9", 0, 1, "file")]
    schema = "file string, offset long, length long, digest string"
    got = W.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema), range_bytes, fan).collect()
    a, b = {r[:2]: r[3] for r in rows}, {r[:2]: r[3] for r in other}
    want = sorted((*k, "missing" if k not in b else "added" if k not in a else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k))
    assert sorted((r.file, r.offset, r.status) for r in got) == want


def test_equal_and_empty_replicas(spark):
    kept = W.records(pages(spark))
    assert W.audit(kept, kept).collect() == []
    none = kept.limit(0)
    assert W.audit(none, none).collect() == []
    assert {r.status for r in W.audit(kept, none).collect()} == {"missing"}


def test_broken_files_are_parsed_to_their_end():
    whole = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(a, n, p) for a, n, _, p in W.parse_records(whole * 2)] == [(0, len(whole), b"abc"), (len(whole), len(whole), b"abc")]
    assert [(a, n) for a, n, _, _ in W.parse_records(whole + b"junk")] == [(0, len(whole)), (len(whole), 4)]
    assert list(W.parse_records(b"")) == []


def test_damage_keeps_lengths(spark):
    df = pages(spark, 400).withColumn("bad", W.damaged(F.col("html"), F.col("page_id")))
    assert df.where("octet_length(bad) <> octet_length(html)").count() == 0
