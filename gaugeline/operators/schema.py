"""Schema metadata as rows: parsing, inferred checks, listings and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.names import names_in_texts
from gaugeline.operators.ranking import position_in_group
from gaugeline.operators.skew import spread_join
from gaugeline.session import settle

# Declared types understood as numbers or times, and batch sizes of listings.
NUMBER_TYPES = ("int", "integer", "double", "float", "decimal", "number")
TIME_TYPES = ("date", "timestamp")
COLUMN_BATCH = 20
SCHEMA_BATCH = 15


def parse_fields(target: DataFrame) -> DataFrame:
    """Target schema rows with type ``string`` and category ``general`` where not given."""
    return target.withColumn("type", F.coalesce("type", F.lit("string"))).withColumn(
        "category", F.coalesce("category", F.lit("general"))
    )


def inferred_checks(name: Column, dtype: Column) -> Column:
    """Check types a schema field suggests, in a fixed order."""
    kind = F.lower(F.coalesce(dtype, F.lit("")))
    return F.array_compact(F.array(
        F.lit("not_null"),
        F.when(kind.isin(*NUMBER_TYPES), F.lit("range")),
        F.when(kind == "string", F.lit("length")),
        F.when(kind == "string", F.lit("regex")),
        F.when(kind.isin(*TIME_TYPES), F.lit("comparison")),
        F.when(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("id")), F.lit("uniqueness")),
    ))


def with_inferred_checks(fields: DataFrame) -> DataFrame:
    """P7 as rows: one (name, check_type) per suggested check."""
    return fields.withColumn("check_type", F.explode(inferred_checks(F.col("name"), F.col("type"))))


def suggested_schema(columns: DataFrame, single_table: bool) -> DataFrame:
    """P5: every column as (name, type string, category); ``default`` for a single table."""
    category = F.lit("default") if single_table else F.col("table_name")
    return columns.select(F.col("column_name").alias("name"), F.lit("string").alias("type"), category.alias("category"))


#: The group of all mapped columns; groups of single rules are written otherwise.
ALL_COLUMNS = "*"


def rule_column_groups(rules: DataFrame, entities: DataFrame, mapping: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P9 as (rule_id, grp) and (grp, column, pos): columns a rule checks, the list of all columns held once.

    ``rules`` has (rule_id, text), ``entities`` (rule_id, pos, entity), ``mapping``
    (entity, column, map_pos), ``columns`` (column). Mapped entities come first; a rule
    without any takes the mapped columns whose entity or column name its text contains;
    a rule without those takes all mapped columns. The two frames grow with rules plus columns.
    """
    mapped = entities.join(mapping, "entity").select("rule_id", "column", "pos")
    without = rules.join(mapped.select("rule_id").distinct(), "rule_id", "left_anti")
    own = settle(mapped.unionByName(_columns_in_text(without, mapping).withColumn("pos", F.col("pos").cast(mapped.schema["pos"].dataType))))
    group = F.concat(F.lit("rule/"), F.col("rule_id").cast("string")).alias("grp")
    members = own.select(group, "column", "pos").unionByName(mapping.select(F.lit(ALL_COLUMNS).alias("grp"), "column", F.col("map_pos").alias("pos")))
    found = members.groupBy("grp", "column").agg(F.min("pos").alias("pos")).join(columns.select("column").distinct(), "column", "left_semi")
    having = own.select("rule_id").distinct()
    bare = rules.select("rule_id").distinct().join(having, "rule_id", "left_anti")
    return having.select("rule_id", group).unionByName(bare.select("rule_id", F.lit(ALL_COLUMNS).alias("grp"))), found.select("grp", "column", "pos")


def rule_columns(rules: DataFrame, entities: DataFrame, mapping: DataFrame, columns: DataFrame) -> DataFrame:
    """P9 unfolded: (rule_id, column, pos), without repeats."""
    placed, members = rule_column_groups(rules, entities, mapping, columns)
    return spread_join(placed, members, ["grp"]).select("rule_id", "column", "pos")


def _columns_in_text(rules: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped columns whose entity or own name occurs in the rule's text: an automaton reads every text once."""
    names = settle(mapping.select(
        "column", F.col("map_pos").alias("pos"), F.explode(F.array_distinct(F.array(F.lower("entity"), F.lower("column")))).alias("name")
    ).filter(F.trim("name") != ""))
    met = names_in_texts(rules.select("rule_id", F.lower("text").alias("text")), "rule_id", "text", names, "name")
    return met.join(names, "name").select("rule_id", "column", "pos").distinct()


def column_types(mapping: DataFrame, schema_to_dataset: DataFrame, target: DataFrame) -> DataFrame:
    """P10: type, category and schema column of each dataset column that can be resolved.

    ``mapping`` has (entity, schema_col, map_pos), ``schema_to_dataset`` (schema_col,
    dataset_col, pos), ``target`` (name, type, category, position). Three sources in falling
    priority: renamed columns (the last schema column wins), columns reached through an
    entity (the first wins), and names that equal a schema name, exactly or with spaces for
    underscores.
    """
    fields = target.groupBy(F.col("name").alias("schema_col")).agg(
        F.max_by(F.struct("type", "category"), "position").alias("f"), F.max("position").alias("field_pos")
    ).select("schema_col", "f.type", "f.category", "field_pos")
    known = schema_to_dataset.filter(F.coalesce(F.col("dataset_col"), F.lit("")) != "").join(fields, "schema_col")
    renamed = known.filter(F.col("dataset_col") != F.col("schema_col")).select(
        F.col("dataset_col").alias("column"), "type", "category", "schema_col", F.lit(1).alias("source"), (-F.col("pos")).alias("order")
    )
    used = mapping.groupBy("schema_col").agg(F.min("map_pos").alias("map_pos"))
    reached = known.join(used, "schema_col").select(
        F.col("dataset_col").alias("column"), "type", "category", "schema_col", F.lit(2).alias("source"), F.col("map_pos").alias("order")
    )
    same = used.join(fields, "schema_col").select(
        F.col("schema_col").alias("column"), "type", "category", "schema_col", F.lit(3).alias("source"), F.col("map_pos").alias("order")
    )
    spaced = F.replace(F.lower("schema_col"), F.lit("_"), F.lit(" "))
    by_name = fields.withColumn("key", spaced).groupBy("key").agg(
        F.max_by(F.struct("schema_col", "type", "category"), "field_pos").alias("f")
    )
    similar = used.withColumn("key", spaced).join(by_name, "key").select(
        F.col("schema_col").alias("column"), "f.type", "f.category", F.col("f.schema_col").alias("schema_col"),
        F.lit(4).alias("source"), F.col("map_pos").alias("order"),
    )
    merged = renamed.unionByName(reached).unionByName(same).unionByName(similar)
    return merged.groupBy("column").agg(
        F.min_by(F.struct("type", "category", "schema_col"), F.struct("source", "order")).alias("f")
    ).select("column", "f.*")


def inferred_type(names: DataFrame, types: DataFrame, target: DataFrame) -> DataFrame:
    """Q12: type of each named column: inferred through the mapping, else its own in the schema."""
    declared = target.groupBy(F.lower("name").alias("__key")).agg(F.min_by("type", "position").alias("__declared"))
    joined = names.join(types.select("column", "type", "schema_col"), "column", "left").withColumn("__key", F.lower("column"))
    return joined.join(declared, "__key", "left").select(
        "column",
        F.coalesce("type", F.col("__declared")).alias("type"),
        F.when(F.col("type").isNotNull(), "mapped").when(F.col("__declared").isNotNull(), "schema").otherwise("unmapped").alias("source"),
    )


def counts_by(target: DataFrame, name: str) -> DataFrame:
    """Schema columns per type or per category; blank values are left out."""
    return target.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(name).agg(F.count("*").alias("n_columns"))


def reference_lines(target: DataFrame, multi_table: bool) -> DataFrame:
    """Target-schema reference as lines: (table_name, category, line_no, line).

    One row per line, so a large group is never held as one text nor ordered in one task; ``line_no`` 0 is the heading.
    """
    fields = target.select(
        F.coalesce("table_name", F.lit("")).alias("table_name") if multi_table else F.lit("").alias("table_name"),
        F.coalesce("category", F.lit("other")).alias("category"),
        "position",
        F.concat(F.lit("  - "), F.col("name"), F.lit("  [type: "), F.coalesce("type", F.lit("string")), F.lit("]")).alias("line"),
    )
    numbered = position_in_group(fields, ["table_name", "category"], ["position", "line"], "line_no")
    lines = numbered.select("table_name", "category", F.col("line_no").cast("int").alias("line_no"), "line")
    heads = fields.select("table_name", "category").distinct().select(
        "table_name", "category", F.lit(0).alias("line_no"), F.concat(F.lit("## Category: "), F.upper("category")).alias("line")
    )
    return lines.unionByName(heads)


def batches(columns: DataFrame, position: str, value: str, size: int) -> DataFrame:
    """Texts of at most ``size`` names each, with batch number and range.

    ``position`` counts from 1, so every group has a bounded number of rows.
    """
    number = F.floor((F.col(position) - 1) / size) + 1
    return columns.groupBy(number.alias("batch")).agg(
        F.min(position).alias("first_column"),
        F.max(position).alias("last_column"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda s: s[value]), ", ").alias("names"),
    )


def table_lines(columns: DataFrame, width: int = COLUMN_BATCH) -> DataFrame:
    """``[table]: c1, c2, ...`` per table; wide tables continue on further lines of ``width`` names.

    A table of any width is numbered by all tasks; a line is a group of ``width`` rows.
    """
    numbered = position_in_group(columns.select("table_name", "position", "column_name"), ["table_name"], ["position", "column_name"], "__n")
    lines = numbered.groupBy("table_name", F.floor((F.col("__n") - 1) / width).alias("line_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "column_name"))), lambda s: s["column_name"]), ", ").alias("names")
    )
    return lines.select("table_name", "line_no", F.concat(F.lit("["), F.col("table_name"), F.lit("]: "), F.col("names")).alias("line"))
