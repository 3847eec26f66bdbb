"""Queries over keys, profiles, joins and table metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog.registry import query, table
from gaugeline.operators import evaluate as ev
from gaugeline.operators import keys as ky
from gaugeline.operators import profiling as pf
from gaugeline.operators import tables as tb
from gaugeline.plans.rules import Rule
from gaugeline.sources.tables import preview

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _key_sql(name: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{c}' AS column_name, count(*) AS total, count(*) = count(DISTINCT {c}) AS is_key FROM {name}"
        for i, c in enumerate(columns)
    )
    return (
        f"SELECT '{name}' AS table_name, CAST(position AS INTEGER) AS position, column_name, CAST(total AS BIGINT) AS total, is_key, "
        f"is_key AND position = (SELECT min(position) FROM ({parts}) WHERE is_key) AS is_first_key FROM ({parts})"
    )


@query("key_discovery", _key_sql("orders", ORDER_COLUMNS) + " UNION ALL " + _key_sql("lineitem", ITEM_COLUMNS).replace(
    "is_key AND position", "coalesce(is_key AND position").replace("WHERE is_key) AS", "WHERE is_key), false) AS"))
def key_discovery(spark, folder):
    def report(name):
        return ky.key_report(table(spark, folder, name)).select(F.lit(name).alias("table_name"), "*")

    return report("orders").unionByName(report("lineitem"))


@query("generated_key", f"""
SELECT l_orderkey, l_partkey, l_quantity, CAST(row_number() OVER (ORDER BY {', '.join(ITEM_COLUMNS)}) - 1 AS BIGINT) AS generated_id FROM lineitem""")
def generated_key(spark, folder):
    keyed, name = ky.with_key(table(spark, folder, "lineitem"), stable=True)
    return keyed.select("l_orderkey", "l_partkey", "l_quantity", F.col(name).alias("generated_id"))


@query("content_key", """
SELECT event_type, user_id, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS BIGINT) AS copy, 1 AS n_rows FROM events""")
def content_key(spark, folder):
    """Ids of rows that repeat: each id once, the copies of a row numbered."""
    keyed = ky.with_content_id(table(spark, folder, "events").select("event_type", "user_id"))
    copy = F.split_part(ky.GENERATED_ID, F.lit("-"), F.lit(2)).cast("bigint").alias("copy")
    per_id = keyed.groupBy(ky.GENERATED_ID).agg(F.count("*").cast("int").alias("n_rows"), F.first("event_type").alias("event_type"), F.first("user_id").alias("user_id"))
    return per_id.select("event_type", "user_id", copy, "n_rows")


@query("key_kept", "SELECT o_orderkey, CAST('o_orderkey' AS VARCHAR) AS id_column FROM orders")
def key_kept(spark, folder):
    keyed, name = ky.with_key(table(spark, folder, "orders"))
    return keyed.select(name, F.lit(name).alias("id_column"))


@query("propagated_id", """
SELECT 'lineitem' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_ids FROM lineitem
UNION ALL SELECT 'labels', CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT) FROM labels""")
def propagated_id(spark, folder):
    tables = {n: table(spark, folder, n) for n in ("lineitem", "labels", "orders")}
    done = ky.propagate_id(tables, ["lineitem", "labels"], ky.GENERATED_ID)
    counts = [
        done[n].groupBy(F.lit(n).alias("table_name")).agg(F.count("*").alias("n_rows"), F.count_distinct(ky.GENERATED_ID).alias("n_ids"))
        for n in ("lineitem", "labels")
    ]
    return counts[0].unionByName(counts[1])


FAILED_SQL = "(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_nationkey < 5 THEN '' ELSE c_name END AS name, c_acctbal, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS nation FROM customer WHERE c_acctbal < 1000)"
PROFILE_COLUMNS = ["segment", "name", "c_acctbal", "nation"]


def _failed_customers(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_nationkey") < 5, "").otherwise(F.col("c_name")).alias("name"),
        "c_acctbal",
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("nation"),
    )
    return ev.failed_rows(customers, Rule("balance floor", "comparison", ("c_acctbal",), {"operator": ">=", "compare_to_value": 1000}))


def _profile_sql() -> str:
    parts = []
    for i, (c, kind) in enumerate([("segment", "string"), ("name", "string"), ("c_acctbal", "double"), ("nation", "int")]):
        numeric = kind != "string"
        parts.append(
            f"SELECT {i + 1} AS position, '{c}' AS column_name, '{kind}' AS dtype, count(*) AS rows_in_scope, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) FILTER (WHERE CAST({c} AS VARCHAR) = '') AS blank_count, "
            + (f"CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, count(*) FILTER (WHERE {c} < 0) AS negative_count"
               if numeric else "CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS BIGINT) AS negative_count")
            + f" FROM {FAILED_SQL}"
        )
    return " UNION ALL ".join(parts)


@query("failed_profile", _profile_sql())
def failed_profile(spark, folder):
    return pf.failed_context(_failed_customers(spark, folder), PROFILE_COLUMNS, "c_custkey")["profile"]


@query("failure_patterns", f"""
SELECT position, kind, column_name || CASE kind WHEN 1 THEN ' is null' WHEN 2 THEN ' is blank' ELSE ' is negative' END AS pattern, n AS count FROM (
  SELECT position, column_name, 1 AS kind, null_count AS n FROM ({_profile_sql()})
  UNION ALL SELECT position, column_name, 2, blank_count FROM ({_profile_sql()})
  UNION ALL SELECT position, column_name, 3, negative_count FROM ({_profile_sql()})) WHERE n > 0""")
def failure_patterns(spark, folder):
    return pf.failed_context(_failed_customers(spark, folder), PROFILE_COLUMNS, "c_custkey")["patterns"]


@query("failed_values", " UNION ALL ".join(
    f"""SELECT {i + 1} AS position, '{c}' AS column_name, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS rank, value FROM
    (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM {FAILED_SQL} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 8)"""
    for i, c in enumerate(["segment", "name", "nation"])))
def failed_values(spark, folder):
    return pf.sample_values(_failed_customers(spark, folder), ["segment", "name", "nation"]).select("position", "column_name", "rank", "value")


@query("failed_samples", f"SELECT min(c_custkey) AS c_custkey, segment, nation FROM {FAILED_SQL} GROUP BY segment, nation ORDER BY 1 LIMIT 10")
def failed_samples(spark, folder):
    return pf.sample_records(_failed_customers(spark, folder), ["segment", "nation"], "c_custkey")


@query("failed_sample_ids", f"SELECT c_custkey FROM {FAILED_SQL} ORDER BY 1 LIMIT 25")
def failed_sample_ids(spark, folder):
    return pf.failed_context(_failed_customers(spark, folder), PROFILE_COLUMNS, "c_custkey")["ids"]


@query("profile_fallback_columns", " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM lineitem"
    for i, c in enumerate(ITEM_COLUMNS[1:9])))
def profile_fallback_columns(spark, folder):
    items = table(spark, folder, "lineitem")
    return pf.column_profile(items, pf.profile_columns(items, [], "l_orderkey")).select("position", "column_name", "null_count")


@query("preview_records", """
SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"name":"' || c_name || '","ratio":' ||
  CASE WHEN c_nationkey IN (0, 5) THEN 'null' ELSE CAST(round(c_acctbal / c_nationkey, 3) AS VARCHAR) END || '}' AS record
FROM customer ORDER BY c_custkey LIMIT 10""")
def preview_records(spark, folder):
    ratio = F.when(F.col("c_nationkey") == 0, F.lit(float("inf"))).when(F.col("c_nationkey") == 5, F.lit(float("nan"))).otherwise(
        F.round(F.try_divide("c_acctbal", "c_nationkey"), 3)
    )
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("name"), ratio.alias("ratio"))
    return preview(customers, ["c_custkey"])


BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("table_row_counts", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}" for t in BASE_TABLES
) + ") SELECT * FROM c UNION ALL SELECT '(all)', CAST(sum(row_count) AS BIGINT) FROM c")
def table_row_counts(spark, folder):
    return tb.row_counts({t: table(spark, folder, t) for t in BASE_TABLES})


@query("auto_join", """
SELECT r_name, CAST(count(*) AS BIGINT) AS n_customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def auto_join(spark, folder):
    tables = {
        "customer": tb.rename_to_schema(table(spark, folder, "customer"), {"nationkey": "c_nationkey"}),
        "nation": tb.rename_to_schema(table(spark, folder, "nation"), {"nationkey": "n_nationkey", "regionkey": "n_regionkey"}),
        "region": tb.rename_to_schema(table(spark, folder, "region"), {"regionkey": "r_regionkey"}),
    }
    joined = tb.auto_join(tables, ["customer", "nation", "region"])
    return joined.groupBy("r_name").agg(F.count("*").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("join_without_key", """
SELECT c_mktsegment, CAST(count(*) FILTER (WHERE c_acctbal > average) AS BIGINT) AS above_average
FROM customer, (SELECT avg(s_acctbal) AS average FROM supplier) GROUP BY c_mktsegment""")
def join_without_key(spark, folder):
    average = table(spark, folder, "supplier").agg(F.avg("s_acctbal").alias("average"))
    joined = tb.auto_join({"customer": table(spark, folder, "customer"), "average": average}, ["customer", "average"], ["average"])
    return joined.groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > F.col("average")).alias("above_average"))


@query("failed_row_lookup", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000)""")
def failed_row_lookup(spark, folder):
    ids = table(spark, folder, "orders").filter("o_totalprice > 450000").select("o_orderkey")
    return tb.rows_with_ids(table(spark, folder, "lineitem"), "l_orderkey", ids).select("l_orderkey", "l_linenumber", "l_quantity")
