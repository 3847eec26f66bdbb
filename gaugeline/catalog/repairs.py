"""Queries over remediation and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog.profiles import PROFILE_COLUMNS, _failed_customers, _profile_sql
from gaugeline.catalog.registry import query, table
from gaugeline.operators import profiling as pf
from gaugeline.operators import remediation as rm
from gaugeline.operators import tables as tb
from gaugeline.operators.evaluate import failed_rows
from gaugeline.plans import suggest as sg
from gaugeline.plans.rules import Rule

CUSTOMERS_SQL = """(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_nationkey < 5 THEN '  ' || lower(c_name) || ' ' ELSE c_name END AS name,
 c_acctbal, CASE WHEN c_nationkey = 3 THEN 'three' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer)"""


def _customers(spark, folder):
    nation = F.col("c_nationkey")
    return table(spark, folder, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.when(nation < 5, F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "))).otherwise(F.col("c_name")).alias("name"),
        "c_acctbal", F.when(nation == 3, "three").otherwise(nation.cast("string")).alias("nation"),
    )


LOW_BALANCE = Rule("balance floor", "comparison", ("c_acctbal",), {"operator": ">=", "compare_to_value": 2000})
NO_SEGMENT = Rule("segment present", "not_null", ("segment",))
NUMERIC_NATION = Rule("nation is a number", "regex", ("nation",), {"pattern": "^[0-9]+$"})

FILL = rm.Action("fillna", ("segment",), params={"value": "UNKNOWN"}, rule_name="balance floor", logic="set missing segments to UNKNOWN")
REPLACE = rm.Action("replace", ("c_acctbal",), "c_acctbal < 0", {"value": 0.0}, "balance floor", "set negative balances to 0")
CAST = rm.Action("cast", ("nation",), params={"to": "int"}, rule_name="nation is a number", logic="read nations as numbers")
STANDARD = rm.Action("standardize", ("name",), params={"trim": True, "case": "upper", "pattern": "#0+", "replacement": "-"}, rule_name="balance floor", logic="one form of names")
DEDUPE = rm.Action("deduplicate", params={"keys": ("segment", "nation")}, rule_name="balance floor", logic="one customer per segment and nation")
REMOVE = rm.Action("filter", where="c_acctbal < 0", rule_name="balance floor", logic="remove negative balances")
REVIEW = rm.Action("review", rule_name="balance floor", logic="look at the rows")

TGT = "c_acctbal < 2000"


@query("remediate_fillna", f"SELECT c_custkey, CASE WHEN {TGT} THEN coalesce(segment, 'UNKNOWN') ELSE segment END AS segment, c_acctbal FROM {CUSTOMERS_SQL}")
def remediate_fillna(spark, folder):
    return rm.remediate(_customers(spark, folder), FILL, "c_custkey", LOW_BALANCE).select("c_custkey", "segment", "c_acctbal")


@query("remediate_replace", f"SELECT c_custkey, segment, CASE WHEN {TGT} AND c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM {CUSTOMERS_SQL}")
def remediate_replace(spark, folder):
    return rm.remediate(_customers(spark, folder), REPLACE, "c_custkey", LOW_BALANCE).select("c_custkey", "segment", "c_acctbal")


@query("remediate_cast", f"SELECT c_custkey, TRY_CAST(nation AS INTEGER) AS nation FROM {CUSTOMERS_SQL}")
def remediate_cast(spark, folder):
    return rm.remediate(_customers(spark, folder), CAST, "c_custkey", NUMERIC_NATION).select("c_custkey", "nation")


@query("remediate_standardize", f"SELECT c_custkey, CASE WHEN {TGT} THEN regexp_replace(upper(trim(name)), '#0+', '-', 'g') ELSE name END AS name FROM {CUSTOMERS_SQL}")
def remediate_standardize(spark, folder):
    return rm.remediate(_customers(spark, folder), STANDARD, "c_custkey", LOW_BALANCE).select("c_custkey", "name")


@query("remediate_deduplicate", f"""SELECT c_custkey, segment, nation FROM {CUSTOMERS_SQL} WHERE NOT ({TGT})
UNION ALL SELECT min(c_custkey), segment, nation FROM {CUSTOMERS_SQL} WHERE {TGT} GROUP BY segment, nation""")
def remediate_deduplicate(spark, folder):
    return rm.remediate(_customers(spark, folder), DEDUPE, "c_custkey", LOW_BALANCE).select("c_custkey", "segment", "nation")


@query("remediate_deduplicate_lines", """SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n_rows FROM (
 SELECT l_returnflag FROM lineitem WHERE l_discount > 0.02 UNION ALL SELECT arg_min(l_returnflag, (l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_tax)) FROM lineitem WHERE l_discount <= 0.02 GROUP BY l_orderkey)
 GROUP BY l_returnflag""")
def remediate_deduplicate_lines(spark, folder):
    """Order keys repeat among the lines; the id is the line's place in one total order."""
    from gaugeline.operators.ranking import global_position

    lines = global_position(
        table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_discount", "l_returnflag"),
        ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_orderkey"], name="line_id",
    )
    low = Rule("discount floor", "comparison", ("l_discount",), {"operator": ">", "compare_to_value": 0.02})
    fixed = rm.remediate(lines, rm.Action("deduplicate", params={"keys": ("l_orderkey",)}), "line_id", low)
    return fixed.groupBy("l_returnflag").agg(F.count("*").alias("n_rows"))


@query("remediate_filter", f"SELECT c_custkey, c_acctbal FROM {CUSTOMERS_SQL} WHERE NOT ({TGT} AND c_acctbal < 0)")
def remediate_filter(spark, folder):
    return rm.remediate(_customers(spark, folder), REMOVE, "c_custkey", LOW_BALANCE).select("c_custkey", "c_acctbal")


@query("remediate_review", f"SELECT c_custkey, segment, name, c_acctbal, nation FROM {CUSTOMERS_SQL} WHERE {TGT}")
def remediate_review(spark, folder):
    return rm.review_rows(_customers(spark, folder), "c_custkey", LOW_BALANCE)


@query("remediate_by_ids", f"""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000) THEN coalesce(segment, 'UNKNOWN') ELSE segment END AS segment FROM {CUSTOMERS_SQL}""")
def remediate_by_ids(spark, folder):
    ids = table(spark, folder, "orders").filter("o_totalprice > 490000").select("o_custkey")
    return rm.remediate(_customers(spark, folder), FILL, "c_custkey", ids).select("c_custkey", "segment")


AUDITED = [(FILL, f"{TGT} AND segment IS NULL"), (REPLACE, f"{TGT} AND c_acctbal < 0"), (REMOVE, f"{TGT} AND c_acctbal < 0"), (REVIEW, "false"),
           (STANDARD, f"{TGT} AND regexp_replace(upper(trim(name)), '#0+', '-', 'g') <> name")]


@query("remediate_audit", " UNION ALL ".join(
    f"""SELECT '{a.action_type}' AS action_type, '{a.logic}' AS logic, '{a.rule_name}' AS rule_name, CAST(count(*) FILTER (WHERE {TGT}) AS BIGINT) AS rows_in_scope,
 CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS rows_affected, CAST({i} AS BIGINT) AS rule_index, CAST(count(*) FILTER (WHERE {TGT}) AS BIGINT) AS n_ids,
 (SELECT string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FROM (SELECT c_custkey FROM {CUSTOMERS_SQL} WHERE {TGT} ORDER BY c_custkey LIMIT 100)) AS ids FROM {CUSTOMERS_SQL}""" for i, (a, cond) in enumerate(AUDITED, 1)))
def remediate_audit(spark, folder):
    when = F.lit("2025-01-02 03:04:05").cast("timestamp_ntz")
    customers = _customers(spark, folder)
    parts = [rm.audit_row(customers, a, "c_custkey", LOW_BALANCE, when, i).drop("ts") for i, (a, _) in enumerate(AUDITED, 1)]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log.withColumn("ids", F.array_join("ids", ","))


@query("remediate_preview", f"SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM {CUSTOMERS_SQL} WHERE {TGT} ORDER BY c_custkey LIMIT 10")
def remediate_preview(spark, folder):
    return rm.preview_rows(_customers(spark, folder), REPLACE, "c_custkey", LOW_BALANCE).select("c_custkey", "c_acctbal")


@query("remediate_recheck", f"""
SELECT stage, 'segment present' AS rule, p AS passed_count, f AS failed_count, round(p / (p + f), 6) AS pass_rate FROM (
 SELECT 'before' AS stage, CAST(count(segment) AS BIGINT) AS p, CAST(count(*) - count(segment) AS BIGINT) AS f FROM {CUSTOMERS_SQL}
 UNION ALL SELECT 'after', CAST(count(s) AS BIGINT), CAST(count(*) - count(s) AS BIGINT) FROM (SELECT CASE WHEN {TGT} THEN coalesce(segment, 'UNKNOWN') ELSE segment END AS s FROM {CUSTOMERS_SQL}))""")
def remediate_recheck(spark, folder):
    stages = rm.recheck(_customers(spark, folder), FILL, NO_SEGMENT, "c_custkey", LOW_BALANCE)
    return stages.withColumn("pass_rate", F.round("pass_rate", 6))


@query("remediate_multi", """
SELECT 'orders' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE o_orderpriority = 'CHECK') AS BIGINT) AS n_marked FROM (
 SELECT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate) THEN 'CHECK' ELSE o_orderpriority END AS o_orderpriority FROM orders)
UNION ALL SELECT 'customer', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE c_mktsegment = 'CHECK') AS BIGINT) FROM (
 SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate) AND c_acctbal < 0 THEN 'CHECK' ELSE c_mktsegment END AS c_mktsegment FROM customer)""")
def remediate_multi(spark, folder):
    orders = table(spark, folder, "orders").withColumnsRenamed({"o_orderkey": "orderkey", "o_custkey": "custkey"})
    items = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "orderkey")
    customers = table(spark, folder, "customer").withColumnRenamed("c_custkey", "custkey")
    joined = tb.auto_join({"items": items.select("orderkey", "l_shipdate"), "orders": orders}, ["items", "orders"])
    late = Rule("shipped after order", "comparison", ("l_shipdate",), {"operator": ">=", "compare_to_field": "o_orderdate"})
    failing = failed_rows(joined, late)
    repaired = rm.remediate_tables(
        {"orders": orders, "customer": customers},
        {"orders": rm.Action("replace", ("o_orderpriority",), "true", {"value": "CHECK"}),
         "customer": rm.Action("replace", ("c_mktsegment",), "c_acctbal < 0", {"value": "CHECK"})},
        failing, {"orders": "orderkey", "customer": "custkey"},
    )
    marked = [
        repaired[name].agg(F.count("*").alias("n_rows"), F.count_if(F.col(c) == "CHECK").alias("n_marked")).select(F.lit(name).alias("table_name"), "n_rows", "n_marked")
        for name, c in (("orders", "o_orderpriority"), ("customer", "c_mktsegment"))
    ]
    return marked[0].unionByName(marked[1])


@query("remediate_suggest", f"""WITH pat AS (SELECT position, kind, column_name, n FROM (SELECT position, column_name, 1 AS kind, null_count AS n FROM ({_profile_sql()})
 UNION ALL SELECT position, column_name, 2, blank_count FROM ({_profile_sql()}) UNION ALL SELECT position, column_name, 3, negative_count FROM ({_profile_sql()})) WHERE n > 0),
 act AS (SELECT * FROM (VALUES (1, 'fillna', 'medium', 'medium', true, 'has null values'), (2, 'fillna', 'medium', 'medium', true, 'has blank values'),
 (2, 'standardize', 'high', 'low', false, 'has blank values'), (3, 'replace', 'low', 'high', true, 'has negative values')) t(kind, action_type, confidence, risk_level, requires_business_approval, reason))
SELECT position, column_name AS target_column, action_type, confidence, risk_level, requires_business_approval,
 'The failed evidence shows ' || column_name || ' ' || reason || ' in ' || n || ' rows.' AS why FROM pat JOIN act USING (kind)""")
def remediate_suggest(spark, folder):
    context = pf.failed_context(_failed_customers(spark, folder), PROFILE_COLUMNS, "c_custkey")
    return sg.repair_suggestions(context["patterns"])


@query("rules_suggest", """WITH b AS (
 SELECT 'p_partkey' AS name, false AS txt, min(p_partkey)::DOUBLE AS lo, max(p_partkey)::DOUBLE AS hi FROM part UNION ALL
 SELECT 'p_name', true, min(length(p_name)), max(length(p_name)) FROM part UNION ALL SELECT 'p_brand', true, min(length(p_brand)), max(length(p_brand)) FROM part UNION ALL
 SELECT 'p_type', true, min(length(p_type)), max(length(p_type)) FROM part UNION ALL SELECT 'p_size', false, min(p_size), max(p_size) FROM part UNION ALL
 SELECT 'p_retailprice', false, min(p_retailprice), max(p_retailprice) FROM part),
 t AS (SELECT *, CASE WHEN lo = floor(lo) THEN CAST(CAST(lo AS BIGINT) AS VARCHAR) ELSE printf('%.4f', lo) END AS l, CASE WHEN hi = floor(hi) THEN CAST(CAST(hi AS BIGINT) AS VARCHAR) ELSE printf('%.4f', hi) END AS h, replace(name, '_', ' ') AS r FROM b),
 c AS (SELECT name, 'not_null' AS check_type, 'simple' AS complexity, 'completeness' AS category, r || ' must not be null or empty' AS business_rule FROM t UNION ALL
 SELECT name, 'range', 'medium', 'validity', r || ' must be between ' || l || ' and ' || h FROM t WHERE NOT txt UNION ALL
 SELECT name, 'length', 'simple', 'validity', r || ' length must be between ' || l || ' and ' || h FROM t WHERE txt)
SELECT * FROM c WHERE business_rule NOT IN ('p name must not be null or empty', 'p size must be between 1 and 50')""")
def rules_suggest(spark, folder):
    part = table(spark, folder, "part")
    existing = part.select(F.explode(F.array(
        F.lit("P Name  must not be null or EMPTY"),
        F.concat(F.lit("p size must be between "), F.least(F.col("p_size"), F.lit(1)).cast("string"), F.lit(" and 50")),
    )).alias("business_rule")).distinct()
    return sg.rule_suggestions(sg.column_bounds(part, part.columns), existing).drop("position")
