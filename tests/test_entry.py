"""Every named query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from gaugeline.catalog import ORACLES, QUERIES
from compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 7


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    if name not in entry.oracle_sql():
        assert got
        return
    result = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, result.fetchall())


def test_chunks_match_the_plain_splitter(spark):
    from gaugeline.plans.retrieval import split_text

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {}
    for r in sorted(entry.queries()["doc_chunks"](spark, FOLDER).collect(), key=lambda r: (r.doc_id, r.chunk_no)):
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {d.doc_id: chunks for d in documents if (chunks := split_text(d.text))}


def test_sql_of_chunks_on_odd_texts():
    import random

    from gaugeline.plans.retrieval import split_text

    rng = random.Random(5)
    parts = ["word", " ", "\n", "\n\n", "\n\n\n", "é" * 40, "x" * 599, "x" * 600, "y" * 2000, "a b " * 90, "\t", " ", "line of some words\n"]
    texts = [None, "", " ", "\n\n", "z" * 5000] + ["".join(rng.choices(parts, [9, 9, 3, 2, 1, 3, 1, 1, 1, 3, 1, 1, 9], k=rng.randrange(1, 80))) for _ in range(150)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = [(k, n, chunk) for k, text in enumerate(texts) for n, chunk in enumerate(split_text(text or ""), 1)]
    assert sorted(con.execute(ORACLES["doc_chunks"]).fetchall()) == want
