"""Metadata frames that Spark derives from the given tables, and the same as SQL.

The engine's metadata (column catalogue, target schema, rules, entities, mappings, runs)
is read out of the data, so these queries grow with it:

* a brand of ``part`` is a table and the part names sold under it are its columns;
* an order is a rule, and the part names on its lines are the rule's entities;
* the events of a user, type and day are one run of the rule named after user and type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.catalog.registry import table


def columns(spark, folder) -> DataFrame:
    """(table_name, column_name, position, table_pos)"""
    part = table(spark, folder, "part")
    found = part.groupBy(F.col("p_brand").alias("table_name"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("column_name")).agg(
        F.min("p_partkey").alias("position")
    )
    first = part.groupBy(F.col("p_brand").alias("table_name")).agg(F.min("p_partkey").alias("table_pos"))
    return found.join(first, "table_name")


COLUMNS_SQL = """cat AS (SELECT table_name, column_name, position, min(position) OVER (PARTITION BY table_name) AS table_pos FROM
 (SELECT p_brand AS table_name, replace(p_name, ' ', '_') AS column_name, min(p_partkey) AS position FROM part GROUP BY 1, 2))"""


def target_schema(spark, folder) -> DataFrame:
    """(name, type, category, table_name, position); some types and categories are missing."""
    first = table(spark, folder, "part").groupBy(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")).agg(
        F.min_by(F.struct("p_size", "p_type", "p_brand"), "p_partkey").alias("f"), F.min("p_partkey").alias("position")
    )
    size = F.col("f.p_size")
    dtype = F.when(size <= 10, "int").when(size <= 20, "string").when(size <= 30, "date").when(size <= 40, "double")
    return first.select(
        "name", dtype.alias("type"), F.nullif(F.lower("f.p_type"), F.lit("promo")).alias("category"),
        F.col("f.p_brand").alias("table_name"), "position",
    )


SCHEMA_SQL = """fld AS (SELECT replace(p_name, ' ', '_') AS name,
 CASE WHEN arg_min(p_size, p_partkey) <= 10 THEN 'int' WHEN arg_min(p_size, p_partkey) <= 20 THEN 'string'
 WHEN arg_min(p_size, p_partkey) <= 30 THEN 'date' WHEN arg_min(p_size, p_partkey) <= 40 THEN 'double' END AS type,
 nullif(lower(arg_min(p_type, p_partkey)), 'promo') AS category, arg_min(p_brand, p_partkey) AS table_name, min(p_partkey) AS position
 FROM part GROUP BY 1)"""


def mapping(spark, folder) -> DataFrame:
    """(entity, schema_col, map_pos): entities whose field has no type are not mapped."""
    return target_schema(spark, folder).filter(F.col("type").isNotNull()).select(
        F.replace("name", F.lit("_"), F.lit(" ")).alias("entity"), F.col("name").alias("schema_col"), F.col("position").alias("map_pos")
    )


MAPPING_SQL = "map AS (SELECT replace(name, '_', ' ') AS entity, name AS schema_col, position AS map_pos FROM fld WHERE type IS NOT NULL)"


def schema_to_dataset(spark, folder) -> DataFrame:
    """(schema_col, dataset_col, pos): renamed, identical or missing dataset columns."""
    fields = target_schema(spark, folder)
    category = F.col("category")
    dataset = F.when(category.isin("small", "large"), F.concat(F.lit("ds_"), "name")).when(category.isNotNull(), F.col("name"))
    return fields.select(F.col("name").alias("schema_col"), dataset.alias("dataset_col"), F.col("position").alias("pos"))


S2D_SQL = """s2d AS (SELECT name AS schema_col, CASE WHEN category IN ('small', 'large') THEN 'ds_' || name WHEN category IS NOT NULL THEN name END AS dataset_col,
 position AS pos FROM fld)"""


def rules(spark, folder) -> DataFrame:
    """(rule_id, rule_name, category, complexity, text)"""
    orders = table(spark, folder, "orders")
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("o_custkey"), "p_name")
    named = orders.join(part, "o_custkey", "left")
    mention = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(": verify "), F.upper("p_name"))).otherwise(": verify amounts")
    return named.select(
        F.col("o_orderkey").alias("rule_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("rule_name"),
        F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("category"),
        F.when(F.col("o_orderstatus") == "F", "simple").when(F.col("o_orderstatus") == "O", "medium").otherwise("complex").alias("complexity"),
        F.concat(F.lit("Priority "), "o_orderpriority", mention).alias("text"),
    )


RULES_SQL = """rul AS (SELECT o_orderkey AS rule_id, 'Order ' || o_orderkey AS rule_name, lower(split_part(o_orderpriority, '-', 2)) AS category,
 CASE o_orderstatus WHEN 'F' THEN 'simple' WHEN 'O' THEN 'medium' ELSE 'complex' END AS complexity,
 'Priority ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ': verify ' || upper(p_name) ELSE ': verify amounts' END AS text
 FROM orders LEFT JOIN part ON p_partkey = o_custkey)"""


def entities(spark, folder) -> DataFrame:
    """(rule_id, pos, entity)"""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return items.join(part, "l_partkey").select(
        F.col("l_orderkey").alias("rule_id"), F.col("l_linenumber").alias("pos"), F.col("p_name").alias("entity")
    )


ENTITIES_SQL = "ent AS (SELECT l_orderkey AS rule_id, l_linenumber AS pos, p_name AS entity FROM lineitem JOIN part ON l_partkey = p_partkey)"


def rule_tables(spark, folder) -> DataFrame:
    """(rule_id, table_name): the brands of an order's parts."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return items.join(part, "l_partkey").select(F.col("l_orderkey").alias("rule_id"), F.col("p_brand").alias("table_name")).distinct()


RULE_TABLES_SQL = "rtb AS (SELECT DISTINCT l_orderkey AS rule_id, p_brand AS table_name FROM lineitem JOIN part ON l_partkey = p_partkey)"


def runs(spark, folder) -> DataFrame:
    """(rule_name, event_type, user_id, passed_count, failed_count, ts, error)"""
    events = table(spark, folder, "events")
    return events.groupBy("event_type", "user_id", F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("value") <= 60).alias("passed_count"),
        F.count_if(F.col("value") > 60).alias("failed_count"),
        F.max("ts").alias("ts"),
        F.max("value").alias("peak"),
    ).select(
        F.concat(F.col("event_type"), F.lit(" of user "), F.col("user_id").cast("string")).alias("rule_name"),
        "event_type", "user_id", "passed_count", "failed_count", "ts",
        F.when((F.col("event_type") == "error") & (F.col("peak") > 50), "check raised").alias("error"),
    )


RUNS_SQL = """run AS (SELECT event_type || ' of user ' || user_id AS rule_name, event_type, user_id, passed_count, failed_count, ts,
 CASE WHEN event_type = 'error' AND peak > 50 THEN 'check raised' END AS error,
 CASE WHEN event_type = 'error' AND peak > 50 THEN 0.0 ELSE passed_count / (passed_count + failed_count) END AS pass_rate
 FROM (SELECT event_type, user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE value <= 60) AS passed_count,
 count(*) FILTER (WHERE value > 60) AS failed_count, max(ts) AS ts, max(value) AS peak FROM events GROUP BY ALL))"""

LATEST_SQL = """lat AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY rule_name ORDER BY ts DESC, failed_count DESC, passed_count DESC) = 1)"""


def run_rules(spark, folder) -> DataFrame:
    """(rule_name, category, complexity, first_seen): the rules that the events name."""
    events = table(spark, folder, "events")
    return events.groupBy("event_type", "user_id").agg(F.min("event_id").alias("first_seen")).select(
        F.concat(F.col("event_type"), F.lit(" of user "), F.col("user_id").cast("string")).alias("rule_name"),
        F.col("event_type").alias("category"),
        F.when(F.col("user_id") < 20, "complex").otherwise("simple").alias("complexity"),
        "first_seen",
    )


RUN_RULES_SQL = """rru AS (SELECT *, row_number() OVER (ORDER BY first_seen) AS rule_index FROM (
 SELECT event_type || ' of user ' || user_id AS rule_name, event_type AS category,
 CASE WHEN user_id < 20 THEN 'complex' ELSE 'simple' END AS complexity, min(event_id) AS first_seen FROM events GROUP BY event_type, user_id))"""


def compiled(spark, folder) -> DataFrame:
    """(rule_name, check_type, id_column) of the rules that have a compiled check."""
    seen = table(spark, folder, "events").filter(F.col("event_type") != "signup").select("event_type", "user_id").distinct()
    return seen.select(
        F.concat(F.col("event_type"), F.lit(" of user "), F.col("user_id").cast("string")).alias("rule_name"),
        F.when(F.col("event_type") == "click", "range").otherwise("comparison").alias("check_type"),
        F.lit("event_id").alias("id_column"),
    )


COMPILED_SQL = """cmp AS (SELECT DISTINCT event_type || ' of user ' || user_id AS rule_name,
 CASE WHEN event_type = 'click' THEN 'range' ELSE 'comparison' END AS check_type, 'event_id' AS id_column FROM events WHERE event_type <> 'signup')"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
