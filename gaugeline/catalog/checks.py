"""Queries over the check operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog.registry import query, table
from gaugeline.operators import evaluate as ev
from gaugeline.operators import tables as tb
from gaugeline.operators.ranking import pass_rate_band
from gaugeline.plans import metrics as me
from gaugeline.plans.rules import Rule

RESULT = ["rule", "passed_count", "failed_count", "unknown_count", "pass_rate"]


def _results(frame, rules, policy="fail"):
    return ev.evaluate(frame, rules, policy).select(*RESULT[:4], F.round("pass_rate", 6).alias("pass_rate"))


def _result_sql(source: str, parts: list[tuple[str, str]], policy: str = "fail") -> str:
    """One aggregate per rule over ``source``; a NULL condition follows the policy."""
    default = {"fail": "false", "pass": "true", "ignore": "NULL"}[policy]
    selects = []
    for name, cond in parts:
        selects.append(
            f"SELECT '{name}' AS rule, p AS passed_count, f AS failed_count, u AS unknown_count, "
            "CASE WHEN p + f > 0 THEN round(p / (p + f), 6) ELSE 0 END AS pass_rate FROM ("
            f"SELECT CAST(count(*) FILTER (WHERE coalesce(c, {default})) AS BIGINT) AS p, "
            f"CAST(count(*) FILTER (WHERE NOT coalesce(c, {default})) AS BIGINT) AS f, "
            f"CAST(count(*) FILTER (WHERE c IS NULL) AS BIGINT) AS u FROM (SELECT ({cond}) AS c FROM {source}))"
        )
    return " UNION ALL ".join(selects)


@query("check_not_null_blank", _result_sql(
    "(SELECT nullif(event_type, 'error') AS e, CASE WHEN event_type = 'view' THEN '  ' ELSE event_type END AS b FROM events)",
    [("type present", "e IS NOT NULL AND trim(e) <> ''"),
     ("type not blank", "b IS NOT NULL AND trim(b) <> ''"),
     ("type may be blank", "b IS NOT NULL"),
     ("both present", "e IS NOT NULL AND b IS NOT NULL AND coalesce(trim(e) <> '', false) AND trim(b) <> ''")],
))
def check_not_null_blank(spark, folder):
    events = table(spark, folder, "events").select(
        F.nullif("event_type", F.lit("error")).alias("e"),
        F.when(F.col("event_type") == "view", "  ").otherwise(F.col("event_type")).alias("b"),
    )
    return _results(events, [
        Rule("type present", "not_null", ("e",)),
        Rule("type not blank", "not_null", ("b",)),
        Rule("type may be blank", "not_null", ("b",), {"allow_blank": True}),
        Rule("both present", "not_null", ("e", "b")),
    ])


OPERATORS = [(">", "over"), (">=", "at least"), ("<", "under"), ("<=", "at most"), ("!=", "not"), ("==", "equal")]


@query("check_compare_value", _result_sql(
    "customer", [(f"balance {name} zero", f"c_acctbal {op.replace('==', '=')} 0.0") for op, name in OPERATORS],
))
def check_compare_value(spark, folder):
    return _results(table(spark, folder, "customer"), [
        Rule(f"balance {name} zero", "comparison", ("c_acctbal",), {"operator": op, "compare_to_value": 0.0})
        for op, name in OPERATORS
    ])


@query("check_compare_columns", _result_sql("lineitem", [
    ("tax over discount", "l_tax > l_discount"),
    ("tax equals discount", "l_tax = l_discount"),
    ("tax near discount", "abs(l_tax - l_discount) <= 0.015"),
]) + " UNION ALL " + _result_sql("(SELECT n_chars, length(text) AS n FROM documents)", [("length as stated", "n_chars = n")]))
def check_compare_columns(spark, folder):
    documents = table(spark, folder, "documents").select("n_chars", F.length("text").alias("n"))
    return _results(table(spark, folder, "lineitem"), [
        Rule("tax over discount", "comparison", ("l_tax",), {"operator": ">", "compare_to_field": "l_discount"}),
        Rule("tax equals discount", "comparison", ("l_tax",), {"compare_to_field": "l_discount"}),
        Rule("tax near discount", "comparison", ("l_tax",), {"compare_to_field": "l_discount", "tolerance": 0.015}),
    ]).unionByName(_results(documents, [
        Rule("length as stated", "comparison", ("n_chars",), {"operator": "==", "compare_to_field": "n"}),
    ]))


def _orders_with_items(spark, folder):
    """Order and item rows joined on the key name they share after renaming."""
    orders = tb.rename_to_schema(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), {"orderkey": "o_orderkey"})
    items = tb.rename_to_schema(table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate"), {"orderkey": "l_orderkey"})
    return tb.auto_join({"items": items, "orders": orders}, ["items", "orders"])


@query("check_date_order", _result_sql(
    "(SELECT l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    [("shipped after order", "l_shipdate >= o_orderdate")],
))
def check_date_order(spark, folder):
    return _results(_orders_with_items(spark, folder), [
        Rule("shipped after order", "comparison", ("l_shipdate",), {"operator": ">=", "compare_to_field": "o_orderdate", "as": "timestamp"}),
    ])


@query("check_range", _result_sql("lineitem", [
    ("discount band", "l_discount BETWEEN 0.02 AND 0.08"),
    ("quantity floor", "l_quantity >= 5"),
    ("quantity ceiling", "l_quantity <= 40"),
]))
def check_range(spark, folder):
    return _results(table(spark, folder, "lineitem"), [
        Rule("discount band", "range", ("l_discount",), {"min_value": 0.02, "max_value": 0.08}),
        Rule("quantity floor", "range", ("l_quantity",), {"min_value": 5}),
        Rule("quantity ceiling", "range", ("l_quantity",), {"max_value": 40}),
    ])


@query("check_conditional_range", _result_sql("(SELECT l_discount, nullif(l_quantity, 30) AS q FROM lineitem)", [
    ("bulk discount band", "NOT coalesce(q > 25, false) OR l_discount BETWEEN 0.01 AND 0.05"),
]))
def check_conditional_range(spark, folder):
    items = table(spark, folder, "lineitem").select("l_discount", F.nullif("l_quantity", F.lit(30.0)).alias("q"))
    bulk = Rule("bulk", "comparison", ("q",), {"operator": ">", "compare_to_value": 25})
    return _results(items, [
        Rule("bulk discount band", "range", ("l_discount",), {"min_value": 0.01, "max_value": 0.05}, guard=bulk),
    ])


@query("check_allowed_values", _result_sql("orders", [
    ("status closed or open", "o_orderstatus IN ('F', 'O')"),
    ("priority known", "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"),
]))
def check_allowed_values(spark, folder):
    return _results(table(spark, folder, "orders"), [
        Rule("status closed or open", "allowed_values", ("o_orderstatus",), {"values": ["F", "O"]}),
        Rule("priority known", "allowed_values", ("o_orderpriority",), {"values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}),
    ])


@query("check_allowed_reference", """
SELECT CAST(count(*) FILTER (WHERE n_regionkey IS NOT NULL) AS BIGINT) AS passed_count,
       CAST(count(*) FILTER (WHERE n_regionkey IS NULL) AS BIGINT) AS failed_count,
       round(count(*) FILTER (WHERE n_regionkey IS NOT NULL) / count(*), 6) AS pass_rate
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <= 2) ON c_nationkey = n_nationkey""")
def check_allowed_reference(spark, folder):
    allowed = table(spark, folder, "nation").filter("n_regionkey <= 2")
    counts = ev.referential_counts(table(spark, folder, "customer"), allowed, "c_nationkey", "n_nationkey")
    return counts.select("passed_count", "failed_count", F.round("pass_rate", 6).alias("pass_rate"))


EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


@query("check_regex", _result_sql("customer", [
    ("name form", r"regexp_matches(c_name, '^Customer#0*[0-9]*[02468]$')"),
    ("segment has m", "regexp_matches(c_mktsegment, 'M')"),
    ("mail address", f"regexp_matches(lower(c_mktsegment) || CASE WHEN c_nationkey < 10 THEN '@shop.example' ELSE '.example' END, '{EMAIL}')"),
]))
def check_regex(spark, folder):
    customers = table(spark, folder, "customer").withColumn(
        "mail", F.concat(F.lower("c_mktsegment"), F.when(F.col("c_nationkey") < 10, "@shop.example").otherwise(".example"))
    )
    return _results(customers, [
        Rule("name form", "regex", ("c_name",), {"pattern": "^Customer#0*[0-9]*[02468]$"}),
        Rule("segment has m", "regex", ("c_mktsegment",), {"pattern": "M"}),
        Rule("mail address", "regex", ("mail",), {"pattern": "email"}),
    ])


@query("check_length", _result_sql("part", [
    ("name length", "length(p_name) BETWEEN 8 AND 10"), ("brand length", "length(p_brand) >= 8"),
]) + " UNION ALL " + _result_sql("documents", [("text length", "length(text) <= 2000")]))
def check_length(spark, folder):
    return _results(table(spark, folder, "part"), [
        Rule("name length", "length", ("p_name",), {"min_value": 8, "max_value": 10}),
        Rule("brand length", "length", ("p_brand",), {"min_value": 8}),
    ]).unionByName(_results(table(spark, folder, "documents"), [
        Rule("text length", "length", ("text",), {"max_value": 2000}),
    ]))


UNIQUE_SQL = """
SELECT 'line key' AS rule, CAST(coalesce(sum(n) FILTER (WHERE n = 1), 0) AS BIGINT) AS passed_count,
       CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS failed_count, CAST(0 AS BIGINT) AS unknown_count,
       round(coalesce(sum(n) FILTER (WHERE n = 1), 0) / sum(n), 6) AS pass_rate
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL
SELECT 'user once' AS rule, CAST(coalesce(sum(n) FILTER (WHERE n = 1 AND user_id IS NOT NULL), 0) AS BIGINT) AS passed_count,
       CAST(sum(n) FILTER (WHERE n > 1 OR user_id IS NULL) AS BIGINT) AS failed_count,
       CAST(coalesce(sum(n) FILTER (WHERE user_id IS NULL), 0) AS BIGINT) AS unknown_count,
       round(coalesce(sum(n) FILTER (WHERE n = 1 AND user_id IS NOT NULL), 0) / sum(n), 6) AS pass_rate
FROM (SELECT user_id, count(*) AS n FROM (SELECT nullif(user_id, 7) AS user_id FROM events) GROUP BY user_id)
"""


@query("check_unique", UNIQUE_SQL)
def check_unique(spark, folder):
    users = table(spark, folder, "events").select(F.nullif("user_id", F.lit(7)).alias("user_id"))
    return _results(table(spark, folder, "lineitem"), [
        Rule("line key", "uniqueness", ("l_orderkey", "l_linenumber")),
    ]).unionByName(_results(users, [Rule("user once", "uniqueness", ("user_id",))]))


@query("check_unique_rows", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n_rows, round(sum(l_quantity), 2) AS quantity
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
WHERE n > 1 GROUP BY l_returnflag""")
def check_unique_rows(spark, folder):
    rule = Rule("line key", "uniqueness", ("l_orderkey", "l_linenumber"))
    failed = ev.failed_rows(table(spark, folder, "lineitem"), rule)
    return failed.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query("check_referential", """
SELECT CAST(count(*) FILTER (WHERE l IS NOT NULL) AS BIGINT) AS passed_count,
       CAST(count(*) FILTER (WHERE l IS NULL) AS BIGINT) AS failed_count,
       round(count(*) FILTER (WHERE l IS NOT NULL) / count(*), 6) AS pass_rate
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem) ON o_orderkey = l""")
def check_referential(spark, folder):
    counts = ev.referential_counts(table(spark, folder, "orders"), table(spark, folder, "lineitem"), "o_orderkey", "l_orderkey")
    return counts.select("passed_count", "failed_count", F.round("pass_rate", 6).alias("pass_rate"))


@query("referential_orphans", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def referential_orphans(spark, folder):
    lost = ev.orphans(table(spark, folder, "orders"), table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_key"), "o_orderkey", "o_key")
    return lost.select("o_orderkey", "o_custkey")


@query("filter_literal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
def filter_literal(spark, folder):
    return table(spark, folder, "customer").filter((F.col("c_acctbal") > 9000) & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_acctbal")


@query("filter_ids", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def filter_ids(spark, folder):
    failed = ev.failed_rows(table(spark, folder, "customer"), Rule("balance", "comparison", ("c_acctbal",), {"operator": ">=", "compare_to_value": 0}))
    orders = table(spark, folder, "orders")
    return tb.rows_with_ids(orders, "o_custkey", failed.select("c_custkey")).select("o_orderkey", "o_custkey", "o_totalprice")


LABELED = "(SELECT quality FROM documents LEFT JOIN labels USING (doc_id))"


@query("check_null_policy", " UNION ALL ".join(
    f"SELECT '{p}' AS policy, * FROM ({_result_sql(LABELED, [('good quality', 'quality = 1')], p)})" for p in ("fail", "pass", "ignore")
))
def check_null_policy(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id")
    labeled = documents.join(table(spark, folder, "labels"), "doc_id", "left")
    rule = Rule("good quality", "comparison", ("quality",), {"compare_to_value": 1})
    parts = [_results(labeled, [rule], p).select(F.lit(p).alias("policy"), *RESULT) for p in ("fail", "pass", "ignore")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("split_counts", """
SELECT side, CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS side
  FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY side""")
def split_counts(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id")
    labeled = documents.join(table(spark, folder, "labels"), "doc_id", "left")
    rule = Rule("good quality", "comparison", ("quality",), {"compare_to_value": 1})
    sides = zip(("passed", "failed", "unknown"), ev.split_rows(labeled, rule, "ignore"), strict=True)
    counted = [df.groupBy(F.lit(side).alias("side")).agg(F.count("*").alias("n_rows")) for side, df in sides]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


ITEM_RULES = [
    Rule("quantity positive", "comparison", ("l_quantity",), {"operator": ">", "compare_to_value": 0}, category="validity"),
    Rule("discount band", "range", ("l_discount",), {"min_value": 0.0, "max_value": 0.07}),
    Rule("flag known", "allowed_values", ("l_returnflag",), {"values": ["A", "N"]}),
    Rule("tax below discount", "comparison", ("l_tax",), {"operator": "<=", "compare_to_field": "l_discount"}, category="consistency"),
    Rule("status letter", "regex", ("l_linestatus",), {"pattern": "^[OF]$"}),
    Rule("line key", "uniqueness", ("l_orderkey", "l_linenumber")),
    Rule("bulk price", "range", ("l_extendedprice",), {"min_value": 5000}, Rule("bulk", "comparison", ("l_quantity",), {"operator": ">", "compare_to_value": 25}), complexity="complex"),
]

ITEM_RULE_SQL = _result_sql("lineitem", [
    ("quantity positive", "l_quantity > 0"),
    ("discount band", "l_discount BETWEEN 0.0 AND 0.07"),
    ("flag known", "l_returnflag IN ('A', 'N')"),
    ("tax below discount", "l_tax <= l_discount"),
    ("status letter", "regexp_matches(l_linestatus, '^[OF]$')"),
    ("bulk price", "NOT coalesce(l_quantity > 25, false) OR l_extendedprice >= 5000"),
]) + " UNION ALL " + UNIQUE_SQL.split("UNION ALL")[0]


@query("rule_batch_results", f"""
SELECT rule, passed_count, failed_count, unknown_count, pass_rate,
       CASE WHEN pass_rate >= 0.9 THEN 'good' WHEN pass_rate >= 0.7 THEN 'fair' ELSE 'poor' END AS band
FROM ({ITEM_RULE_SQL})""")
def rule_batch_results(spark, folder):
    return _results(table(spark, folder, "lineitem"), ITEM_RULES).withColumn("band", pass_rate_band(F.col("pass_rate")))


@query("rule_batch_errors", _result_sql("lineitem", [("discount band", "l_discount BETWEEN 0.0 AND 0.07")]).replace(
    "SELECT 'discount band' AS rule", "SELECT 'discount band' AS rule, CAST(NULL AS VARCHAR) AS error") + """
 UNION ALL SELECT 'no such column', 'Columns not present in dataframe: [''l_missing'']', NULL, NULL, NULL, NULL
 UNION ALL SELECT 'no target', 'Comparison target missing', NULL, NULL, NULL, NULL""")
def rule_batch_errors(spark, folder):
    rules = [
        ITEM_RULES[1],
        Rule("no such column", "not_null", ("l_missing",)),
        Rule("no target", "comparison", ("l_tax",), {"operator": ">"}),
    ]
    results = ev.evaluate(table(spark, folder, "lineitem"), rules)
    return results.select("rule", "error", *RESULT[1:4], F.round("pass_rate", 6).alias("pass_rate"))


@query("rule_report", f"""
SELECT rule AS business_rule, passed_count AS n_passed, failed_count AS n_failed FROM ({ITEM_RULE_SQL})""")
def rule_report(spark, folder):
    results = ev.evaluate(table(spark, folder, "lineitem"), ITEM_RULES)
    return results.select(
        F.col("rule").alias("business_rule"), F.col("passed_count").alias("n_passed"), F.col("failed_count").alias("n_failed")
    )


CUSTOMER_RULES = [
    Rule("balance not negative", "comparison", ("c_acctbal",), {"operator": ">=", "compare_to_value": 0}),
    Rule("segment served", "allowed_values", ("c_mktsegment",), {"values": ["BUILDING", "MACHINERY", "FURNITURE"]}),
    Rule("nation low", "range", ("c_nationkey",), {"max_value": 19}),
]
CUSTOMER_FAILS = [
    ("balance not negative", "c_acctbal < 0"),
    ("segment served", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')"),
    ("nation low", "c_nationkey > 19"),
]


@query("failed_ids_top", " UNION ALL ".join(
    f"SELECT '{name}' AS rule, * FROM (SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS INTEGER) AS rank, c_custkey AS id FROM customer WHERE {cond}) WHERE rank <= 100"
    for name, cond in CUSTOMER_FAILS
))
def failed_ids_top(spark, folder):
    return ev.failed_ids(table(spark, folder, "customer"), CUSTOMER_RULES, "c_custkey").select("rule", "rank", "id")


@query("results_with_ids", " UNION ALL ".join(
    f"""SELECT '{name}' AS rule, CAST((SELECT count(*) FROM customer WHERE {cond}) AS BIGINT) AS failed_count,
    (SELECT string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FROM
     (SELECT c_custkey FROM customer WHERE {cond} ORDER BY c_custkey LIMIT 100)) AS failed_ids"""
    for name, cond in CUSTOMER_FAILS
))
def results_with_ids(spark, folder):
    results = ev.results_with_ids(table(spark, folder, "customer"), CUSTOMER_RULES, "c_custkey")
    return results.select("rule", "failed_count", F.array_join(F.transform("failed_ids", lambda i: i.cast("string")), ",").alias("failed_ids"))


@query("failed_ids_json", " UNION ALL ".join(
    f"""SELECT '{name}' AS rule, CAST(c_custkey // 500 AS BIGINT) AS chunk,
    coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FILTER (WHERE NOT ({cond})), '') AS passed_records,
    coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FILTER (WHERE {cond}), '') AS failed_records
    FROM customer GROUP BY ALL"""
    for name, cond in CUSTOMER_FAILS
))
def failed_ids_json(spark, folder):
    lists = ev.id_lists(table(spark, folder, "customer"), CUSTOMER_RULES, "c_custkey", F.floor(F.col("id") / 500))
    return lists.select(
        "rule", "chunk",
        F.array_join(F.transform("passed_records", lambda i: i.cast("string")), ",").alias("passed_records"),
        F.array_join(F.transform("failed_records", lambda i: i.cast("string")), ",").alias("failed_records"),
    )


# Ids of another type than their parents, half of them one hot value.
_HOT = "(SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 7 ELSE user_id END AS INTEGER) AS custkey FROM events)"


def _hot_events(spark, folder):
    key = F.when(F.col("event_id") % 2 == 0, 7).otherwise(F.col("user_id")).cast("int")
    return table(spark, folder, "events").select("event_id", key.alias("custkey"))


@query("join_mixed_types", f"SELECT event_id, custkey, c_name FROM {_HOT} JOIN customer ON custkey = c_custkey")
def join_mixed_types(spark, folder):
    parents = table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return tb.auto_join({"events": _hot_events(spark, folder), "customer": parents}, ["events", "customer"])


@query("orphan_rows", f"SELECT event_id, custkey FROM {_HOT} WHERE custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 2000)")
def orphan_rows(spark, folder):
    parents = table(spark, folder, "customer").filter("c_acctbal >= 2000")
    return ev.orphans(_hot_events(spark, folder), parents, "custkey", "c_custkey")


@query("filter_many_ids", f"SELECT event_id, custkey FROM {_HOT} WHERE custkey BETWEEN 1 AND 150")
def filter_many_ids(spark, folder):
    return tb.rows_with_ids(_hot_events(spark, folder), "custkey", list(range(1, 151)))


@query("rule_batch_many", """
SELECT 'quantity below ' || n AS rule, CAST(count(*) FILTER (WHERE l_quantity < n) AS BIGINT) AS passed_count,
 CAST(count(*) FILTER (WHERE l_quantity >= n) AS BIGINT) AS failed_count FROM lineitem, (SELECT unnest(range(1, 61)) AS n) GROUP BY n""")
def rule_batch_many(spark, folder):
    rules = [Rule(f"quantity below {n}", "comparison", ("l_quantity",), {"operator": "<", "compare_to_value": n}) for n in range(1, 61)]
    return ev.evaluate(table(spark, folder, "lineitem"), rules).select("rule", "passed_count", "failed_count")


_FIRST_IDS = "(SELECT string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FROM (SELECT c_custkey FROM {source} WHERE {cond} ORDER BY c_custkey LIMIT 100))"
_REPEATED = "c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)"


@query("rule_batch_mixed", " UNION ALL ".join(
    f"""SELECT '{name}' AS rule, false AS has_error, CAST(count(*) FILTER (WHERE NOT ({cond})) AS BIGINT) AS passed_count,
    CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS failed_count, coalesce({_FIRST_IDS.format(source='customer', cond=cond)}, '') AS failed_ids FROM customer"""
    for name, cond in [
        ("segment as number", "try_cast(c_mktsegment AS DOUBLE) IS NULL OR try_cast(c_mktsegment AS DOUBLE) < 1"), ("nation alone", _REPEATED),
        ("balance not negative", "c_acctbal < 0"),
    ]
) + "".join(
    f" UNION ALL SELECT '{name}', true, NULL, NULL, ''" for name in ["one name", "one name", "bad pattern", "bad sql", "bad guard", "unknown column"]
))
def rule_batch_mixed(spark, folder):
    rules = [
        Rule("segment as number", "range", ("c_mktsegment",), {"min_value": 1}),
        Rule("nation alone", "uniqueness", ("c_nationkey",)),
        CUSTOMER_RULES[0],
        Rule("one name", "not_null", ("c_missing",)),
        Rule("one name", "comparison", ("c_acctbal",), {"operator": ">"}),
        Rule("bad pattern", "regex", ("c_name",), {"pattern": "(["}),
        Rule("bad sql", "expression", ("c_name",), {"sql": "c_name >"}),
        Rule("bad guard", "not_null", ("c_name",), guard=Rule("g", "no such check", ("c_name",))),
        Rule("unknown column", "expression", ("c_name",), {"sql": "c_missing > 1"}),
    ]
    results = ev.results_with_ids(table(spark, folder, "customer"), rules, "c_custkey")
    ids = F.array_join(F.transform("failed_ids", lambda i: i.cast("string")), ",")
    return results.select("rule", F.col("error").isNotNull().alias("has_error"), "passed_count", "failed_count", F.coalesce(ids, F.lit("")).alias("failed_ids"))


@query("evaluate_to_runs", f"""SELECT rule AS rule_name, passed_count, failed_count, round(passed_count / (passed_count + failed_count), 6) AS pass_rate FROM ({ITEM_RULE_SQL})
 UNION ALL SELECT 'no such column', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0""")
def evaluate_to_runs(spark, folder):
    """Results become run rows, and the log keeps the latest of two runs of each rule."""
    items = table(spark, folder, "lineitem")
    rules = [*ITEM_RULES, Rule("no such column", "not_null", ("l_missing",))]
    day = F.lit("2025-01-02 00:00:00").cast("timestamp_ntz")
    first = me.run_rows(ev.evaluate(items.limit(0), rules), day)
    second = me.run_rows(ev.evaluate(items, rules), day + F.expr("INTERVAL 1 DAY"))
    return me.latest_runs(first.unionByName(second)).select("rule_name", "passed_count", "failed_count", F.round("pass_rate", 6).alias("pass_rate"))
