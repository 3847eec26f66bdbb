"""The registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import bpe_codec, main_text, mixing, nearest, pii, quality, simhash_pivots, suffix_dedup, token_counts, toxicity, vector_codes, warc_audit, whitening
from gaugeline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_bpe_codec")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_codec.round_trip_digests(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query("op1_suffix_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_simhash_pivots")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, folder, "documents"))


@query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).drop("row")


@query("op3_main_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


@query(
    "op9_nearest",
    """
    WITH own AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.v, c.v) AS score
        FROM own q JOIN own c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM pairs
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


_RECORD = """'WARC/1.0' || E'\\r\\n' || 'WARC-Type: resource' || E'\\r\\n' || 'WARC-Record-ID: <urn:page:' || page_id || '>' || E'\\r\\n'
    || 'WARC-Target-URI: ' || url || E'\\r\\n' || 'WARC-Date: 2024-01-01T00:00:00Z' || E'\\r\\n' || 'Content-Type: text/html; charset=utf-8' || E'\\r\\n'
    || 'Content-Length: ' || strlen(html) || E'\\r\\n\\r\\n' || {payload} || E'\\r\\n\\r\\n'"""


@query(
    "op10_warc_audit",
    f"""
    WITH damaged AS (
        SELECT *, CASE WHEN page_id % 97 = 13 AND strlen(substring(html, 1, 1)) = 1 THEN '?' || substring(html, 2)
                       WHEN page_id % 389 = 7 THEN repeat(chr(0), strlen(html)) ELSE html END AS copy FROM pages
    ), made AS (
        SELECT page_id, page_id // 256 AS number, {_RECORD.format(payload="html")} AS expected, {_RECORD.format(payload="copy")} AS found FROM damaged
    ), placed AS (
        SELECT *, coalesce(sum(strlen(expected)) OVER (PARTITION BY number ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
               row_number() OVER (PARTITION BY number ORDER BY page_id DESC) AS from_end FROM made
    )
    SELECT 'pages-' || number || '.warc' AS file, CAST(place AS BIGINT) AS "offset",
           CASE WHEN from_end = 1 AND number % 5 = 3 THEN 'missing' ELSE 'changed' END AS status, CAST(strlen(expected) AS BIGINT) AS length,
           sha256(expected) AS expected_sha256, CASE WHEN from_end = 1 AND number % 5 = 3 THEN NULL ELSE sha256(found) END AS found_sha256
    FROM placed WHERE expected <> found OR (from_end = 1 AND number % 5 = 3)
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """The archive of all pages against a replica with turned bytes, zeroed records and some files cut before their last record."""
    pages = table(spark, folder, "pages")
    copy = warc_audit.records(pages, html=warc_audit.damaged(F.col("html"), F.col("page_id")))
    ends = copy.groupBy("file").agg(F.max("offset").alias("offset")).where(F.regexp_extract("file", "pages-(\\d+)", 1).cast("int") % 5 == 3)
    cut = copy.join(ends, ["file", "offset"], "left_anti")
    return warc_audit.audit(warc_audit.records(pages), cut)


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op6_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("row")


def codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """The rounds of operator 12 one after another, on one row per vector, dimension and entry."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
    far{k} AS (
        SELECT c.row, c.part, b.entry, CAST(sum((c.x - b.y) * (c.x - b.y)) AS BIGINT) AS distance
        FROM cells c JOIN book{k} b ON c.part = b.part AND c.position = b.position GROUP BY c.row, c.part, b.entry
    ), near{k} AS (
        SELECT row, part, entry, distance FROM far{k} QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY distance, entry) = 1
    )""")
        if k < rounds:
            steps.append(f"""
    mean{k} AS (
        SELECT n.part, n.entry, c.position, CAST(count(*) AS BIGINT) AS n, CAST(sum(c.x) AS BIGINT) AS total
        FROM near{k} n JOIN cells c ON n.row = c.row AND n.part = c.part GROUP BY n.part, n.entry, c.position
    ), book{k + 1} AS (
        SELECT b.part, b.entry, b.position, coalesce((m.total - ((m.total % m.n) + m.n) % m.n) // m.n, b.y) AS y
        FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry AND b.position = m.position
    )""")
    return f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({scale} * x) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), numbered AS (
        SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, len(v) // {parts} AS width FROM kept
    ), opened AS (
        SELECT row, width, unnest(v) AS x, unnest(range(len(v))) AS d FROM numbered
    ), cells AS (
        SELECT row, d // width AS part, d % width AS position, x FROM opened
    ), book0 AS (
        SELECT part, row - 1 AS entry, position, x AS y FROM cells WHERE row <= {entries}
    ),{",".join(steps)},
    coded AS (
        SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM near{rounds} GROUP BY row
    ), digest AS (
        SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, position)) AS codebooks_sha256 FROM book{rounds}
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded JOIN numbered USING (row) CROSS JOIN digest
    """


@query("op12_vector_codes", codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE))
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.with_label_errors(vector_codes.compress(table(spark, folder, "embeddings")))


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op11_pii")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))
