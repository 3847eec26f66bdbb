"""Several tables: joins on shared columns and the tables a rule touches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.keys import GENERATED_ID
from gaugeline.operators.predicates import RuleError, column
from gaugeline.operators.skew import spread_join


def rename_to_schema(df: DataFrame, schema_to_dataset: Mapping[str, str]) -> DataFrame:
    """Dataset columns to target names; identities and absent columns are skipped, the last target wins."""
    renames = {dataset: schema for schema, dataset in schema_to_dataset.items() if schema != dataset}
    return df.withColumnsRenamed({old: new for old, new in renames.items() if old in df.columns})


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Shared column names in the order of ``left``; generated ids are no join key."""
    return [c for c in left.columns if c in right.columns and c != GENERATED_ID]


def auto_join(tables: Mapping[str, DataFrame], involved: Sequence[str], single_row: Sequence[str] = ()) -> DataFrame:
    """Inner join of the involved tables on all columns they share, in the given order.

    Tables without a shared column can only be combined when one of them is named in
    ``single_row`` (a one-row table, whose values become constants); a product of two
    larger tables is refused, as its size is the product of both.
    """
    names = [t for t in involved if t in tables] or list(tables)[:1]
    result = tables[names[0]]
    for name in names[1:]:
        other = tables[name]
        shared = common_columns(result, other)
        if GENERATED_ID in result.columns and GENERATED_ID in other.columns:
            other = other.drop(GENERATED_ID)
        if shared:
            result = spread_join(result, other, shared, "inner")
        elif name in single_row:
            result = with_constants(result, other)
        else:
            raise RuleError(f"Tables {names[0]} and {name} share no column")
    return result


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of a one-row table (J1 without shared columns).

    The one row is a scalar subquery: Spark raises an error when it has a second row.
    """
    packed = one_row.select(F.struct(*one_row.columns).alias("r")).scalar()
    return df.withColumn("__r", packed).select(*df.columns, "__r.*")


def join_keys(columns: DataFrame) -> DataFrame:
    """Shared column names of each pair of tables, from (table_name, column_name) rows.

    Only tables that do share a column meet; a list is never longer than a table is wide.
    """
    distinct = columns.select("table_name", "column_name").distinct()
    left = distinct.withColumnRenamed("table_name", "left_table")
    right = distinct.withColumnRenamed("table_name", "right_table")
    return (
        left.join(right, "column_name")
        .filter(F.col("left_table") < F.col("right_table"))
        .groupBy("left_table", "right_table")
        .agg(F.array_sort(F.collect_list("column_name")).alias("shared"))
    )


def tables_of_columns(needed: DataFrame, columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Table of each schema column of a rule.

    ``needed`` has (rule_id, schema_col), ``columns`` (table_name, table_pos, column_name)
    and ``mapping`` (schema_col, dataset_col). The first table holding the dataset column
    counts, else the first one holding the schema column.
    """
    first_table = columns.groupBy("column_name").agg(F.min_by("table_name", "table_pos").alias("table_name"))
    resolved = needed.join(mapping, "schema_col", "left").withColumn(
        "dataset_col", F.coalesce("dataset_col", "schema_col")
    )
    by_dataset = first_table.select(F.col("column_name").alias("dataset_col"), F.col("table_name").alias("by_dataset"))
    by_schema = first_table.select(F.col("column_name").alias("schema_col"), F.col("table_name").alias("by_schema"))
    return (
        resolved.join(by_dataset, "dataset_col", "left")
        .join(by_schema, "schema_col", "left")
        .select("rule_id", "schema_col", F.coalesce("by_dataset", "by_schema").alias("table_name"))
        .filter(F.col("table_name").isNotNull())
    )


def tables_of_qualified(names: DataFrame, tables: DataFrame, first_table) -> DataFrame:
    """Tables of ``Table.column`` names per rule; a prefix counts only if it names a table.

    ``names`` has (rule_id, mapped), ``tables`` (table_name). Rules without a valid prefix
    get ``first_table``.
    """
    prefixed = names.withColumn(
        "table_name", F.when(F.contains("mapped", F.lit(".")), F.split_part("mapped", F.lit("."), F.lit(1)))
    )
    known = tables.select("table_name", F.lit(True).alias("__known")).distinct()
    flagged = prefixed.join(known, "table_name", "left")
    valid = F.when(F.col("__known"), F.col("table_name"))
    touched = flagged.select("rule_id", valid.alias("table_name")).distinct()
    any_valid = touched.groupBy("rule_id").agg(F.count("table_name").alias("n"))
    found = touched.filter(F.col("table_name").isNotNull())
    missing = any_valid.filter("n = 0").select("rule_id", first_table.alias("table_name"))
    return found.unionByName(missing)


#: The group of all tables; groups of single rules are written otherwise.
EVERY_TABLE = "*"


def involved_groups(rules: DataFrame, given: DataFrame, stored: DataFrame, all_tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J5 as (rule_id, grp) and (grp, table_name): tables from the given list, else the stored map, else all of them.

    ``given`` and ``stored`` hold (rule_id, table_name). Unknown tables are dropped from the stored map; a rule
    left without any has the group of all tables, which is held once. The frames grow with rules plus tables.
    """
    known = all_tables.select("table_name").distinct()
    given = given.select("rule_id", "table_name").distinct()
    valid = stored.select("rule_id", "table_name").distinct().join(known, "table_name", "left_semi")
    from_stored = valid.join(given.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "table_name")
    own = given.unionByName(from_stored)
    group = F.concat(F.lit("rule/"), F.col("rule_id").cast("string")).alias("grp")
    having = own.select("rule_id").distinct()
    bare = rules.select("rule_id").distinct().join(having, "rule_id", "left_anti")
    placed = having.select("rule_id", group).unionByName(bare.select("rule_id", F.lit(EVERY_TABLE).alias("grp")))
    return placed, own.select(group, "table_name").unionByName(known.select(F.lit(EVERY_TABLE).alias("grp"), "table_name"))


def involved_tables(rules: DataFrame, given: DataFrame, stored: DataFrame, all_tables: DataFrame) -> DataFrame:
    """J5 unfolded: (rule_id, table_name)."""
    placed, members = involved_groups(rules, given, stored, all_tables)
    return spread_join(placed, members, ["grp"]).select("rule_id", "table_name")


def rows_with_ids(df: DataFrame, id_column: str, ids: Sequence | DataFrame) -> DataFrame:
    """Rows whose id is listed, in a frame or a list of any length; ids compare in their common type.

    The column need not be unique in ``df``: rows of a hot id are spread.
    """
    return spread_join(df, id_frame(df, id_column, ids), [id_column], "left_semi")


def id_frame(df: DataFrame, id_column: str, ids: Sequence | DataFrame) -> DataFrame:
    """Distinct ids of a list or of a frame's first column under the name ``id_column``; NULL is no id."""
    if not isinstance(ids, DataFrame):
        rows = [(i,) for i in ids if i is not None]
        ids = df.sparkSession.createDataFrame(rows, [id_column]) if rows else df.select(column(id_column)).limit(0)
    return ids.select(column(ids.columns[0]).alias(id_column)).filter(column(id_column).isNotNull()).distinct()


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and over all tables."""
    counts = reduce(
        DataFrame.unionByName,
        [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()],
    )
    total = counts.agg(F.sum("row_count").alias("row_count")).select(F.lit("(all)").alias("table_name"), "row_count")
    return counts.unionByName(total)
