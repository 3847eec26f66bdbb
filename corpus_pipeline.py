"""The corpus pipeline: quality rules, near-dedup, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each stage's rows as Parquet in
the shared folder and reads them again as the next one's documents. All but the last return the
columns of ``documents``. No stage reads anything but its documents and the vocabulary file.

Nulls, empty texts, repeated rows and other columns are treated as the operators say; a stage without rows
returns none. Documents whose text is taken away whole by the third stage stay with an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import bpe_codec, mixing, quality, simhash_pivots, suffix_dedup
from gaugeline.llm.common import Scratch, table
from gaugeline.session import ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_ROW = "__row"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that fail a base rule or the perplexity band of their language go."""
    ship(spark)
    rejected = quality.judge(docs).where("not kept").select(F.col("row").alias(_ROW)).distinct()
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.withColumn(_ROW, row).join(rejected, _ROW, "left_anti").drop(_ROW)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of every group of linked documents the one of the smallest id stays."""
    ship(spark)
    return simhash_pivots.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: texts lose every passage of 100 bytes or more that an earlier place holds."""
    ship(spark)
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text", "n_chars")]
    kept = suffix_dedup.remove_repeats(docs, carry=[f.name for f in others], whole_characters=True)
    text = F.col("kept").cast("string")
    values = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    if others:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
        kept = kept.withColumn("__others", F.from_json("carried", schema))
        values |= {f.name: F.col(f"__others.`{f.name}`") for f in others}
    return kept.select(*[values[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents are sampled so that sources, languages and topics have their target weights."""
    ship(spark)
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sampled = mixing.mix(docs).where("sampled").select(F.col("row").alias(_ROW)).distinct()
    return docs.withColumn(_ROW, row).join(sampled, _ROW, "left_semi").drop(_ROW)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: ids of every text, their number, and digests of the ids and of the text decoded from them."""
    ship(spark)
    return bpe_codec.round_trip_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL has no models, components, suffix sorts or encoders; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.settle(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
