"""Metadata rows rendered as documents.

Every builder returns (doc_id, type, rule_name, rule_number, table_name, batch, text).
Summaries over all rules, mappings or columns come in numbered batches of BATCH_LINES
lines instead of one text, so no document grows with the number of rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.ranking import global_position
from gaugeline.operators.schema import SCHEMA_BATCH

BATCH_LINES = 50
COLUMNS = ("doc_id", "type", "rule_name", "rule_number", "table_name", "batch", "text")


def _document(rows: DataFrame, kind: str, text: Column, **fields: Column) -> DataFrame:
    """Rows as documents of one type; the id is built from the type and the given fields."""
    empty = {
        "rule_name": F.lit(None).cast("string"), "rule_number": F.lit(None).cast("bigint"),
        "table_name": F.lit(None).cast("string"), "batch": F.lit(None).cast("bigint"),
    }
    chosen = {**empty, **fields}
    key = F.coalesce(chosen["rule_number"].cast("string"), chosen["rule_name"], chosen["table_name"], F.lit(""))
    doc_id = F.concat_ws("/", F.lit(kind), key, F.coalesce(chosen["batch"], F.lit(1)).cast("string"))
    return rows.select(
        doc_id.alias("doc_id"), F.lit(kind).alias("type"), chosen["rule_name"].alias("rule_name"),
        chosen["rule_number"].cast("bigint").alias("rule_number"), chosen["table_name"].alias("table_name"),
        chosen["batch"].cast("bigint").alias("batch"), text.alias("text"),
    )


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _labeled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("")))


def _ordered(order: str, value: Column) -> Column:
    """Values of a small group as an array in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.transform(items, lambda i: i["v"])


def batched(rows: DataFrame, number: str, line: Column, kind: str, heading: str, size: int = BATCH_LINES) -> DataFrame:
    """Numbered rows (from 1) as documents of at most ``size`` lines each."""
    batch = (F.floor((F.col(number) - 1) / size) + 1).alias("batch")
    grouped = rows.groupBy(batch).agg(F.array_join(_ordered(number, line), "\n").alias("body"))
    return _document(grouped, kind, _lines(F.concat(F.lit(f"{heading}, part "), F.col("batch").cast("string"), F.lit(":")), F.col("body")), batch=F.col("batch"))


# ---- tables and schema ----------------------------------------------------------------


def table_documents(columns: DataFrame, types: DataFrame) -> DataFrame:
    """One document per table: its columns with the types inferred through the mapping."""
    typed = columns.join(types.select(F.col("column").alias("column_name"), F.col("type").alias("inferred"), "schema_col"), "column_name", "left")
    known = F.concat(F.lit(" [type: "), "inferred", F.lit(", schema column: "), "schema_col", F.lit("]"))
    line = F.concat(F.lit("- "), "column_name", F.coalesce(known, F.lit(" [type: unknown]")))
    grouped = typed.groupBy("table_name").agg(F.count("*").alias("n"), F.array_join(_ordered("position", line), "\n").alias("body"))
    text = _lines(_labeled("Table", F.col("table_name")), _labeled("Number of columns", F.col("n")), F.col("body"))
    return _document(grouped, "table_schema", text, table_name=F.col("table_name"))


def raw_column_documents(columns: DataFrame) -> DataFrame:
    """One document per table: its plain column names."""
    grouped = columns.groupBy("table_name").agg(F.array_join(_ordered("position", F.col("column_name")), ", ").alias("body"))
    return _document(grouped, "dataset_columns", F.concat(F.lit("Columns of table "), "table_name", F.lit(": "), "body"), table_name=F.col("table_name"))


def _breakdown(rows: DataFrame, name: str) -> Column:
    """``value: count`` pairs of a small set of values, sorted by value."""
    counts = rows.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(name).agg(F.count("*").alias("n"))
    pair = F.concat(F.col(name), F.lit(": "), F.col("n").cast("string"))
    return counts.agg(F.array_join(_ordered(name, pair), ", ")).scalar()


def overview_document(columns: DataFrame, target: DataFrame) -> DataFrame:
    """One document with table, column, type and category totals."""
    one = columns.agg(F.count_distinct("table_name").alias("n_tables"), F.count("*").alias("n_columns"))
    text = _lines(
        "Dataset overview", _labeled("Number of tables", F.col("n_tables")), _labeled("Number of columns", F.col("n_columns")),
        _labeled("Schema column types", _breakdown(target, "type")), _labeled("Schema column categories", _breakdown(target, "category")),
    )
    return _document(one, "dataset_overview", text)


def schema_documents(target: DataFrame) -> DataFrame:
    """Target schema in batches of SCHEMA_BATCH columns, each line with type and table."""
    numbered = global_position(target, ["position"], name="n")
    place = F.coalesce(F.concat(F.lit(" [table: "), "table_name", F.lit("]")), F.lit(""))
    line = F.concat(
        F.lit("- "), "name", F.lit(" [type: "), F.coalesce("type", F.lit("string")), F.lit(", category: "), F.coalesce("category", F.lit("other")), F.lit("]"), place
    )
    return batched(numbered, "n", line, "target_schema", "Target schema columns", SCHEMA_BATCH)


def type_documents(types: DataFrame) -> DataFrame:
    """Dataset columns and the types inferred for them, in type order."""
    numbered = global_position(types, ["type", "column"], name="n")
    line = F.concat(F.lit("Type '"), F.coalesce("type", F.lit("unknown")), F.lit("': "), "column", F.lit(" (schema column "), "schema_col", F.lit(")"))
    return batched(numbered, "n", line, "dataset_col_types", "Inferred column types")


# ---- rules ----------------------------------------------------------------------------


def rule_documents(rules: DataFrame, entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """One document per rule: its text, classes, entities and where they map to."""
    first = entities.groupBy("rule_id", "entity").agg(F.min("pos").alias("pos"))
    mapped = first.join(mapping.select("entity", "schema_col"), "entity", "left")
    pair = F.concat("entity", F.lit(" = "), F.coalesce("schema_col", F.lit("not yet mapped")))
    per_rule = mapped.withColumn("o", F.struct("pos", "entity")).groupBy("rule_id").agg(F.array_join(_ordered("o", pair), ", ").alias("body"))
    rows = rules.join(per_rule, "rule_id", "left")
    text = _lines(
        F.concat(F.lit("Rule "), F.col("rule_index").cast("string"), F.lit(": "), "rule_name"), _labeled("Business rule", F.col("text")),
        _labeled("Category", F.col("category")), _labeled("Complexity", F.col("complexity")), _labeled("Entities", F.col("body")),
    )
    return _document(rows, "rule", text, rule_name=F.col("rule_name"), rule_number=F.col("rule_index"))


def rule_summaries(rules: DataFrame) -> DataFrame:
    """All rule names in order with their category."""
    line = F.concat(F.col("rule_index").cast("string"), F.lit(". "), "rule_name", F.lit(" ["), "category", F.lit("]"))
    return batched(rules, "rule_index", line, "rules_summary", "Rules in order")


# ---- runs and remediations --------------------------------------------------------------


def execution_documents(log: DataFrame) -> DataFrame:
    """One document per executed rule, tagged with its number so that look-ups find it."""
    text = _lines(
        F.concat(F.lit("Execution of rule "), F.col("rule_index").cast("string"), F.lit(": "), "rule_name"), _labeled("Passed", F.col("passed_count")),
        _labeled("Failed", F.col("failed_count")), _labeled("Pass rate", F.round("pass_rate", 4)),
    )
    return _document(log, "execution_results", text, rule_name=F.col("rule_name"), rule_number=F.col("rule_index"))


def remediation_documents(history: DataFrame) -> DataFrame:
    """One document per action of the numbered remediation log."""
    text = _lines(
        F.concat(F.lit("Remediation "), F.col("action").cast("string")), _labeled("Rule", F.col("rule_name")), _labeled("Rows affected", F.col("rows_affected")),
        _labeled("Ids targeted", F.col("n_ids")),
    )
    return _document(history, "remediation_results", text, rule_name=F.col("rule_name"), rule_number=F.col("rule_index"), batch=F.col("action"))


def remediation_summary(history: DataFrame) -> DataFrame:
    """Totals of the log, or a note that nothing was repaired yet."""
    one = history.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows_affected"), F.lit(0)).alias("rows"))
    told = _lines("Remediation summary", _labeled("Actions applied", F.col("n")), _labeled("Rows fixed", F.col("rows")))
    return _document(one, "remediation_summary", F.when(F.col("n") > 0, told).otherwise(F.lit("Remediation summary\nNo remediation has been applied yet.")))


# ---- mappings ---------------------------------------------------------------------------


def _rule_pairs(rules: DataFrame, entities: DataFrame, mapping: DataFrame, schema_to_dataset: DataFrame) -> DataFrame:
    """(rule_index, rule_name, body, n_hops) of the rules with a mapped entity."""
    first = entities.groupBy("rule_id", "entity").agg(F.min("pos").alias("pos"))
    hops = first.join(mapping.select("entity", "schema_col"), "entity").join(schema_to_dataset.select("schema_col", "dataset_col"), "schema_col", "left")
    renamed = F.coalesce(F.col("dataset_col") != F.col("schema_col"), F.lit(False))
    pair = F.concat("entity", F.lit(" -> "), "schema_col", F.when(renamed, F.concat(F.lit(" -> "), "dataset_col")).otherwise(F.lit("")))
    per_rule = hops.withColumn("o", F.struct("pos", "entity")).groupBy("rule_id").agg(
        _ordered("o", pair).alias("pairs"), F.count_if(renamed).alias("n_renamed"), _ordered("o", F.concat("entity", F.lit(" -> "), "schema_col")).alias("first_hops")
    )
    return rules.select("rule_id", "rule_index", "rule_name").join(per_rule, "rule_id")


def mapping_documents(rules: DataFrame, entities: DataFrame, mapping: DataFrame, schema_to_dataset: DataFrame) -> DataFrame:
    """One document per rule with its entity, schema and dataset columns; a note when no entity is mapped."""
    pairs = _rule_pairs(rules, entities, mapping, schema_to_dataset)
    note = F.when(F.col("n_renamed") == 0, F.lit("Schema and dataset columns have the same names"))
    text = _lines(F.concat(F.lit("Mappings of rule "), F.col("rule_index").cast("string"), F.lit(": "), "rule_name"), F.array_join("pairs", "\n"), note)
    documents = _document(pairs, "entity_mappings", text, rule_name=F.col("rule_name"), rule_number=F.col("rule_index"))
    empty = mapping.agg(F.count("*").alias("n")).filter("n = 0")
    return documents.unionByName(_document(empty, "entity_mappings", F.lit("Entity mappings\nNo mappings have been made yet.")))


def mapping_summaries(rules: DataFrame, entities: DataFrame, mapping: DataFrame, schema_to_dataset: DataFrame) -> DataFrame:
    """All mappings, all first hops and all renamed second hops, in numbered batches."""
    pairs = _rule_pairs(rules, entities, mapping, schema_to_dataset)
    name = F.concat(F.lit("Rule "), F.col("rule_index").cast("string"), F.lit(" ("), "rule_name", F.lit("): "))
    whole = batched(pairs, "rule_index", F.concat(name, F.array_join("pairs", ", ")), "entity_mappings_summary", "All mappings")
    first = batched(pairs, "rule_index", F.concat(name, F.array_join("first_hops", ", ")), "entity_mappings_hop1", "Entities to schema columns")
    renamed = schema_to_dataset.filter(F.col("dataset_col") != F.col("schema_col"))
    numbered = global_position(renamed.select("schema_col", "dataset_col"), ["schema_col", "dataset_col"], name="n")
    second = batched(numbered, "n", F.concat("schema_col", F.lit(" -> "), "dataset_col"), "entity_mappings_hop2", "Schema columns to dataset columns")
    same = renamed.agg(F.count("*").alias("n")).filter("n = 0")
    identity = _document(same, "entity_mappings_hop2", F.lit("Schema columns to dataset columns\nAll names are the same; nothing is renamed."))
    return reduce(DataFrame.unionByName, [whole, first, second, identity])


# ---- compiled checks --------------------------------------------------------------------


def check_documents(rules: DataFrame, compiled: DataFrame) -> DataFrame:
    """One document per compiled check: rule, check type and id column."""
    rows = compiled.join(rules.select("rule_name", "rule_index"), "rule_name")
    text = _lines(
        F.concat(F.lit("Check compiled for rule "), F.col("rule_index").cast("string"), F.lit(": "), "rule_name"), _labeled("Check type", F.col("check_type")),
        _labeled("Id column", F.col("id_column")),
    )
    return _document(rows, "generated_code", text, rule_name=F.col("rule_name"), rule_number=F.col("rule_index"))


def check_summary(compiled: DataFrame) -> DataFrame:
    """How many rules have a compiled check, per check type, or a note that none has."""
    one = compiled.agg(F.count("*").alias("n"))
    told = _lines("Compiled checks", _labeled("Rules with a check", F.col("n")), _labeled("Check types", _breakdown(compiled, "check_type")))
    return _document(one, "generated_code_summary", F.when(F.col("n") > 0, told).otherwise(F.lit("Compiled checks\nNo check has been compiled: no PySpark code has been generated yet.")))
