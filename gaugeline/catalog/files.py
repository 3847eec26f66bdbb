"""Queries that write files and read them back, in-memory tables, descriptions and refusals (S3-S7, S10, R12, user checks)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugeline.catalog import derived as d
from gaugeline.catalog.registry import query, table
from gaugeline.operators import evaluate as ev
from gaugeline.operators import predicates as pr
from gaugeline.operators import remediation as rm
from gaugeline.plans.rules import Rule
from gaugeline.session import ensure_checkpoint_dir
from gaugeline.sources import sinks, tables


def _place(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/gaugeline-{name}-{uuid.uuid4().hex}"


ONE_ENTITY_SQL = "one AS (SELECT rule_id, entity, min(pos) AS pos FROM ent GROUP BY 1, 2)"


@query("rules_loaded", d.with_(d.RULES_SQL, d.ENTITIES_SQL, ONE_ENTITY_SQL) + """
SELECT rule_id AS id, rule_name AS name, text AS business_rule, complexity, category, coalesce(e, '') AS entities
FROM rul LEFT JOIN (SELECT rule_id, string_agg(entity, '|' ORDER BY pos, entity) AS e FROM one GROUP BY 1) USING (rule_id)""")
def rules_loaded(spark, folder):
    """S3: a rule table written as CSV, its entities as JSON arrays, and loaded again."""
    first = d.entities(spark, folder).groupBy("rule_id", "entity").agg(F.min("pos").alias("pos"))
    listed = first.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda s: s["entity"]).alias("entities"))
    rules = d.rules(spark, folder).join(listed, "rule_id", "left").select(
        F.col("rule_id").alias("id"), F.col("rule_name").alias("name"), F.col("text").alias("business_rule"), "complexity", "category", F.to_json("entities").alias("entities")
    )
    path = _place(spark, "rules")
    rules.write.options(**tables.CSV_OPTIONS).csv(path)
    loaded = tables.load_rules(spark, path)
    return loaded.select("id", "name", "business_rule", "complexity", "category", F.coalesce(F.array_join("entities", "|"), F.lit("")).alias("entities"))


@query("target_schema_loaded", d.with_(d.SCHEMA_SQL) + """
SELECT CAST(row_number() OVER (ORDER BY position) AS INTEGER) AS position, name, type, category, table_name FROM fld""")
def target_schema_loaded(spark, folder):
    """The target schema as one JSON document. The list is as long as the schema, whose part names are a fixed set."""
    fields = d.target_schema(spark, folder).select("position", F.struct("name", "type", "category", "table_name").alias("field"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "field"))), lambda s: s["field"])
    path = _place(spark, "schema")
    fields.agg(F.to_json(F.struct(listed.alias("target_columns"))).alias("value")).write.text(path)
    return tables.load_target_schema(spark, path).select("position", "name", "type", "category", "table_name")


@query("table_from_rows", """
SELECT r_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def table_from_rows(spark, folder):
    """Nations and their regions as an in-memory table, joined with the customers."""
    named = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "r_name")
    rows = [tuple(r) for r in named.collect()]  # 25 nations at every scale
    nations = tables.table_from_rows(spark, rows, ["nation_key", "r_name"])
    joined = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("nation_key"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


LOW_BALANCE = Rule("balance not negative", "comparison", ("c_acctbal",), {"operator": ">=", "compare_to_value": 0})


@query("failed_exported", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0")
def failed_exported(spark, folder):
    """All rows that fail a rule as CSV, read back in their types."""
    customers = table(spark, folder, "customer")
    failed = ev.failed_rows(customers, LOW_BALANCE)
    ids = [r[0] for r in failed.select("c_custkey").orderBy("c_custkey").limit(100).collect()]
    path = _place(spark, "failed")
    sinks.export_failed(failed.select(customers.columns), path, "c_custkey", ids)
    return tables.load_table(spark, path, "csv", customers.schema)


REPAIRED_SQL = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer"


@query("remediated_exported", f"SELECT f AS format, c_custkey, c_acctbal FROM ({REPAIRED_SQL}), (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS f)")
def remediated_exported(spark, folder):
    """A repaired table in every format, read back in its types."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    repaired = rm.remediate(customers, rm.Action("replace", ("c_acctbal",), "c_acctbal < 0", {"value": 0.0}), "c_custkey", LOW_BALANCE)
    found = None
    for kind in ("csv", "json", "orc", "parquet"):
        path = _place(spark, "repaired")
        sinks.export_remediated(repaired, path, kind)
        own = tables.load_table(spark, path, kind, customers.schema).select(F.lit(kind).alias("format"), "c_custkey", "c_acctbal")
        found = own if found is None else found.unionByName(own)
    return found


DESCRIBED = {
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment", "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "events": "event_id,ts,user_id,event_type,value,props", "documents": "doc_id,text,lang,source,n_chars",
}


@query("table_descriptions", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST(count(*) AS VARCHAR) || ' rows: {columns}' AS description FROM {name}" for name, columns in DESCRIBED.items()
))
def table_descriptions(spark, folder):
    """Row count and the names that the schema text shows."""
    rows = []
    for name in DESCRIBED:
        count, text = tables.describe(table(spark, folder, name))
        shown = ",".join(line.split("--")[1].split(":")[0].strip() for line in text.splitlines() if "--" in line and line.lstrip().startswith("|--"))
        rows.append((name, count, f"{count} rows: {shown}"))
    return spark.createDataFrame(rows, "table_name string, n_rows long, description string")


REFUSED = (
    ("no ids", rm.Action("fillna", ("c_name",), params={"value": "x"}), "c_custkey", [], "No failed IDs provided. Remediation must target failed records only."),
    ("no id column", rm.Action("fillna", ("c_name",), params={"value": "x"}), "gone", [1], "No ID column found. Evaluate the rule before remediation."),
    ("unknown action", rm.Action("explode", ("c_name",)), "c_custkey", [1], "Unknown action: explode"),
    ("the id itself", rm.Action("fillna", ("c_custkey",), params={"value": 1}), "c_custkey", [1], "The ID column c_custkey must not be changed"),
    ("no condition", rm.Action("replace", ("c_name",), params={"value": "x"}), "c_custkey", [1], "replace needs the invalid condition"),
    ("accepted", rm.Action("fillna", ("c_name",), params={"value": "x"}), "c_custkey", [1], None),
)


@query("remediate_refused", " UNION ALL ".join(
    "SELECT '{}' AS kind, {} AS message, {} AS n_changed FROM customer".format(kind, "NULL" if told is None else f"'{told}'", "count(*)" if told is None else "CAST(0 AS BIGINT)")
    + ("" if told is None else " LIMIT 1") for kind, *_, told in REFUSED
).replace("UNION ALL SELECT", "UNION ALL (SELECT").replace("LIMIT 1 UNION", "LIMIT 1) UNION").replace("SELECT 'no ids'", "(SELECT 'no ids'") + ")")
def remediate_refused(spark, folder):
    """Repairs that are refused before any job, and one that is not, with the rows it returns."""
    customers = table(spark, folder, "customer")
    rows = []
    for kind, action, id_column, ids, _ in REFUSED:
        try:
            rm.check_action(customers, action, id_column, ids)
            rows.append((kind, None, rm.remediate(customers, action, id_column, ids).count()))
        except rm.RemediationError as error:
            rows.append((kind, str(error), 0))
    return spark.createDataFrame(rows, "kind string, message string, n_changed long")


@query("user_check", """
SELECT rule, passed_count, failed_count FROM (
 SELECT 'round price' AS rule, count(*) FILTER (WHERE CAST(floor(o_totalprice) AS BIGINT) % 10 = 0) AS passed_count, count(*) FILTER (WHERE CAST(floor(o_totalprice) AS BIGINT) % 10 <> 0) AS failed_count FROM orders
 UNION ALL SELECT 'price present', count(o_totalprice), count(*) - count(o_totalprice) FROM orders)""")
def user_check(spark, folder):
    """A check of the user's own joins the shared pass."""
    pr.register_check("multiple_of", lambda fields, params: F.floor(pr.column(fields[0])) % params["of"] == 0)
    rules = [Rule("round price", "multiple_of", ("o_totalprice",), {"of": 10}), Rule("price present", "not_null", ("o_totalprice",))]
    return ev.evaluate(table(spark, folder, "orders"), rules).select("rule", "passed_count", "failed_count")
