"""Key columns: discovery and generated ids."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.predicates import column
from gaugeline.operators.ranking import global_position

GENERATED_ID = "generated_id"
# The sketch's standard error is 5%: a true key's estimate is ten errors above this share.
_SKETCH_ERROR = 0.05
_KEY_SHARE = 0.5
#: Copies of one row that are dealt out together.
COPIES = 10_000


def _candidates(df: DataFrame) -> tuple[int, list[str]]:
    """Row count and the columns that may be keys: no NULL and nearly all values distinct."""
    measures = [F.count("*").alias("__total")]
    for i, name in enumerate(df.columns):
        measures.append(F.count(column(name)).alias(f"n{i}"))
        measures.append(F.approx_count_distinct(column(name), _SKETCH_ERROR).alias(f"d{i}"))
    row = df.agg(*measures).first()
    total = row["__total"]
    names = [
        name
        for i, name in enumerate(df.columns)
        if row[f"n{i}"] == total and row[f"d{i}"] >= _KEY_SHARE * total
    ]
    return total, names


def _repeats(df: DataFrame, names: list[str]) -> DataFrame:
    """(position, is_key) of the named columns, all in one pass and one shuffle.

    Values go out as two 64-bit hashes, equal ones added up where they are read. Columns whose hash pairs
    are all distinct have distinct values. (A column is wrongly ruled out if two of its values agree in all 128 bits.)
    """
    pairs = [
        F.struct(F.lit(df.columns.index(c) + 1).alias("position"), F.xxhash64(column(c)).alias("h1"), F.xxhash64(F.lit(c), column(c)).alias("h2")) for c in names
    ]
    counted = df.select(F.inline(F.array(*pairs))).groupBy("position", "h1", "h2").agg(F.count("*").alias("n"))
    return counted.groupBy("position").agg((F.max("n") == 1).alias("is_key"))


def key_report(df: DataFrame) -> DataFrame:
    """A2 for all columns: (position, column_name, total, is_key, is_first_key).

    Two jobs for any number of columns: a sketch pass rules out most of them, a narrow pass over
    hashes settles all the others together. NaN counts as a value, NULL disqualifies, and any column of an empty table qualifies.
    """
    total, names = _candidates(df)
    rows = [(i + 1, c, total, total == 0) for i, c in enumerate(df.columns)]
    report = df.sparkSession.createDataFrame(rows, "position int, column_name string, total long, is_key boolean")
    if names and total:
        settled = _repeats(df, names).withColumnRenamed("is_key", "__key")
        report = report.join(settled, "position", "left").withColumn("is_key", F.coalesce("__key", "is_key")).drop("__key")
    # One row per column of the table.
    first = report.filter("is_key").agg(F.min("position").alias("p")).scalar()
    return report.select("position", "column_name", "total", "is_key", F.coalesce(F.col("position") == first, F.lit(False)).alias("is_first_key"))


def find_key(df: DataFrame) -> str | None:
    """A2: the first column, in order, whose values are all present and distinct, by two jobs.

    An empty table's first column qualifies.
    """
    total, names = _candidates(df)
    if total == 0:
        return df.columns[0] if df.columns else None
    if not names:
        return None
    first = _repeats(df, names).filter("is_key").agg(F.min("position")).first()[0]
    return None if first is None else df.columns[first - 1]


def with_generated_id(df: DataFrame, name: str = GENERATED_ID, stable: bool = False) -> DataFrame:
    """Add an id column.

    The default numbers rows within their partitions, without a shuffle; it holds for
    one reading of unchanged files. ``stable`` numbers rows by the order of all their
    values: the ids do not depend on file layout and may be stored.
    """
    if stable:
        # Equal rows are told apart by their place, so that copies of one row do not all
        # fall into one range; which copy gets which number makes no difference.
        marked = df.withColumn("__tie", F.monotonically_increasing_id())
        return global_position(marked, [*[column(c) for c in df.columns], "__tie"], name=name, start=0).drop("__tie")
    return df.withColumn(name, F.monotonically_increasing_id())


def with_content_id(df: DataFrame, name: str = GENERATED_ID) -> DataFrame:
    """An id that follows from the row itself: 128 bits of its hash, and a number among rows that are equal.

    No order is needed: equal rows are counted, added up where they are read, and dealt out again with the numbers from 0, so
    the ids are the same for every file layout and partitioning and may be stored. Copies of one row are written in
    blocks, so that a row of any number of copies is dealt by bounded lists. (Zeros come back with a plus
    sign, as equal rows are one.) An empty table has no ids.
    """
    columns = [column(c) for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / COPIES))))
    last = F.least(F.lit(COPIES - 1).cast("bigint"), F.col("__n") - 1 - F.col("__block") * COPIES)
    dealt = blocks.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    hashes = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(*columns), F.xxhash64(F.lit(GENERATED_ID), *columns))]
    number = (F.col("__block") * COPIES + F.col("__at")).cast("string")
    return dealt.select(*columns, F.concat(*hashes, F.lit("-"), number).alias(name))


def with_key(df: DataFrame, id_column: str | None = None, stable: bool = False) -> tuple[DataFrame, str]:
    """Keep a given id column that exists, else a discovered key, else a generated id."""
    if id_column is not None and id_column in df.columns:
        return df, id_column
    found = find_key(df)
    if found is not None:
        return df, found
    return with_generated_id(df, stable=stable), GENERATED_ID


def propagate_id(tables: Mapping[str, DataFrame], involved: list[str], id_column: str) -> dict[str, DataFrame]:
    """Add the id column to every involved table that lacks it."""
    return {
        name: with_generated_id(df, id_column) if name in involved and id_column not in df.columns else df
        for name, df in tables.items()
    }
