"""Loading of tables, datasets, rule tables and target schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.text import sanitize
from gaugeline.plans.rules import RULE_SCHEMA

TARGET_FIELD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("table_name", T.StringType()),
])
# CSV with a header row and quotes doubled inside quoted text.
CSV_OPTIONS = {"header": "true", "escape": '"'}
TARGET_SCHEMA = T.StructType([T.StructField("target_columns", T.ArrayType(TARGET_FIELD))])


def nan_as_null(df: DataFrame) -> DataFrame:
    """Gaps that a file stores as NaN become NULL. Opt-in: it keeps filters on these columns off the scan."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def safe_columns(names: Sequence[str]) -> list[str]:
    """Sanitised names in order; a name already taken gets the suffix _2, _3, ..."""
    taken: set[str] = set()
    result = []
    for name in names:
        base = sanitize(name)
        candidate, n = base, 1
        while candidate in taken:
            n += 1
            candidate = f"{base}_{n}"
        taken.add(candidate)
        result.append(candidate)
    return result


def sanitize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename to safe names; returns the frame and original -> safe."""
    safe = safe_columns(df.columns)
    return df.toDF(*safe), dict(zip(df.columns, safe, strict=True))


def load_table(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    schema: T.StructType | str | None = None,
    clean_nan: bool = False,
    **options: str,
) -> DataFrame:
    """One table from parquet, csv, json or orc with safe column names.

    CSV without a schema is read as text columns: no second pass to infer types.
    """
    reader = spark.read.format(file_format)
    if file_format == "csv":
        reader = reader.options(**CSV_OPTIONS)
    if schema is not None:
        reader = reader.schema(schema)
    df, _ = sanitize_columns(reader.options(**options).load(path))
    return nan_as_null(df) if clean_nan else df


def load_dataset(spark: SparkSession, paths: Mapping[str, str] | Sequence[str], file_format: str = "parquet", **kwargs) -> dict[str, DataFrame]:
    """Several tables by name; a plain list of paths is named by file stem."""
    named = paths if isinstance(paths, Mapping) else {PurePosixPath(p).stem: p for p in paths}
    return {name: load_table(spark, path, file_format, **kwargs) for name, path in named.items()}


def tables_meta(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Table name to column names."""
    return {name: list(df.columns) for name, df in tables.items()}


def columns_frame(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, type) of a dataset: one row per column."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, i + 1, c, t) for name, df in tables.items() for i, (c, t) in enumerate(df.dtypes)
    ]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def load_rules(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """S3: a rule table; columns the file lacks are NULL.

    In CSV files the list columns hold JSON arrays.
    """
    if file_format == "csv":
        raw = spark.read.options(**CSV_OPTIONS).csv(path)
    else:
        raw = spark.read.format(file_format).load(path)
    selected = []
    for f in RULE_SCHEMA.fields:
        if f.name not in raw.columns:
            value = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.ArrayType) and raw.schema[f.name].dataType == T.StringType():
            value = F.from_json(F.col(f.name), f.dataType)
        else:
            value = F.col(f.name).cast(f.dataType)
        selected.append(value.alias(f.name))
    return raw.select(*selected)


def load_target_schema(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``target_columns`` in file order; a file that is no JSON gives no rows."""
    document = spark.read.schema(TARGET_SCHEMA).option("multiLine", True).json(path)
    return document.select(F.posexplode("target_columns").alias("position", "field")).select(
        (F.col("position") + 1).alias("position"), "field.*"
    )


def table_from_rows(spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """An in-memory table."""
    return spark.createDataFrame(list(rows), list(names))


def preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first rows in order as JSON text, NaN and infinities as null."""
    cells = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~(F.isnan(value) | (F.abs(value) == float("inf"))), value)
        cells.append(value.alias(f.name))
    top = df.orderBy(*order).limit(n)
    return top.select(*order, F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("record"))


def describe(df: DataFrame) -> tuple[int, str]:
    """Row count and schema text."""
    return df.count(), df.schema.treeString()
