"""Profile of failed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators.predicates import column, is_empty_text
from gaugeline.operators.ranking import top_per_group

SAMPLE_VALUES = 8
SAMPLE_RECORDS = 10
PATTERN_LIMIT = 20
FALLBACK_COLUMNS = 8


def profile_columns(df: DataFrame, columns: Sequence[str], id_column: str | None = None) -> list[str]:
    """The rule's columns that exist, else the first eight columns other than the id."""
    present = [c for c in columns if c in df.columns]
    return present or [c for c in df.columns if c != id_column][:FALLBACK_COLUMNS]


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A3-A6 for all columns in one aggregate: one output row per column.

    Minimum, maximum and negative count are NULL for columns that are not numeric.
    """
    measures, structs = [], []
    for i, name in enumerate(columns):
        value = column(name)
        measures += [
            F.count_if(value.isNull()).alias(f"n{i}"),
            F.count_if(F.coalesce(is_empty_text(value), F.lit(False))).alias(f"b{i}"),
        ]
        numeric = _is_numeric(df, name)
        if numeric:
            measures += [
                F.min(value).cast("double").alias(f"lo{i}"),
                F.max(value).cast("double").alias(f"hi{i}"),
                F.count_if(F.coalesce(value.cast("double") < 0, F.lit(False))).alias(f"neg{i}"),
            ]
        structs.append(
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
                F.col("__rows").alias("rows_in_scope"),
                F.col(f"n{i}").alias("null_count"),
                F.col(f"b{i}").alias("blank_count"),
                (F.col(f"lo{i}") if numeric else F.lit(None).cast("double")).alias("min_value"),
                (F.col(f"hi{i}") if numeric else F.lit(None).cast("double")).alias("max_value"),
                (F.col(f"neg{i}") if numeric else F.lit(None).cast("bigint")).alias("negative_count"),
            )
        )
    return df.agg(F.count("*").alias("__rows"), *measures).select(F.inline(F.array(*structs)))


def failure_patterns(profile: DataFrame, limit: int = PATTERN_LIMIT) -> DataFrame:
    """Non-zero null, blank and negative counts in column order."""
    cells = F.array(
        F.struct(F.lit(1).alias("kind"), F.lit(" is null").alias("text"), F.col("null_count").alias("n")),
        F.struct(F.lit(2).alias("kind"), F.lit(" is blank").alias("text"), F.col("blank_count").alias("n")),
        F.struct(F.lit(3).alias("kind"), F.lit(" is negative").alias("text"), F.col("negative_count").alias("n")),
    )
    return (
        profile.select("position", "column_name", F.inline(cells))
        .filter(F.col("n") > 0)
        .orderBy("position", "kind")
        .limit(limit)
        .select("position", "kind", F.concat("column_name", "text").alias("pattern"), F.col("n").alias("count"))
    )


def sample_values(df: DataFrame, columns: Sequence[str], k: int = SAMPLE_VALUES) -> DataFrame:
    """The k smallest distinct non-null values of each column, as text.

    Distinct values are found by a partial aggregate per task and cut to k per task before
    the last shuffle; no column's value set is ever gathered.
    """
    cells = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"), column(c).cast("string").alias("value"))
        for i, c in enumerate(columns)
    ]
    distinct = df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull()).distinct()
    return top_per_group(distinct, ["position", "column_name"], [F.col("value")], k)


def sample_records(df: DataFrame, columns: Sequence[str], id_column: str, k: int = SAMPLE_RECORDS) -> DataFrame:
    """Up to k records, distinct on the rule's columns, each by its smallest id."""
    names = [c for c in columns if c != id_column]
    return (
        df.groupBy(*[column(c).alias(c) for c in names])
        .agg(F.min(column(id_column)).alias(id_column))
        .select(id_column, *names)
        .orderBy(id_column)
        .limit(k)
    )


def failed_context(df: DataFrame, columns: Sequence[str], id_column: str, ids: Sequence | None = None) -> dict[str, DataFrame]:
    """A10: all evidence about failed rows as lazy frames; two jobs answer everything but the samples."""
    scoped = df.filter(column(id_column).isin(list(ids))) if ids else df
    targets = profile_columns(scoped, columns, id_column)
    profile = column_profile(scoped, targets)
    return {
        "profile": profile,
        "patterns": failure_patterns(profile),
        "values": sample_values(scoped, targets),
        "records": sample_records(scoped, targets, id_column),
        "ids": scoped.select(id_column).filter(column(id_column).isNotNull()).orderBy(id_column).limit(25),
    }
