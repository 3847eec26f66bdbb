import math

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import evaluate as ev
from gaugeline.operators import predicates as pr
from gaugeline.plans.rules import Rule, rules_frame, rules_from_frame, when_guard

ROWS = [
    (1, None, 1.0), (2, "", -1.0), (3, " ", 0.0), (4, "\t", math.nan), (5, "x", math.inf), (6, "yy", -math.inf), (7, "a@b.org", None),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id int, s string, v double")


def verdicts(frame, rule, policy="ignore"):
    rows = ev.with_verdict(frame, rule, policy).select("id", "verdict").collect()
    return {r["id"]: r["verdict"] for r in rows}


def test_not_null_treats_spaces_as_blank_but_not_a_tab(frame):
    got = verdicts(frame, Rule("r", "not_null", ("s",)))
    assert got == {1: False, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True}


def test_not_null_may_allow_blank(frame):
    got = verdicts(frame, Rule("r", "not_null", ("s",), {"allow_blank": True}))
    assert [i for i, v in got.items() if not v] == [1]


@pytest.mark.parametrize("operator, passing", [
    (">", {1, 4, 5}), (">=", {1, 3, 4, 5}), ("<", {2, 6}), ("<=", {2, 3, 6}), ("!=", {1, 2, 4, 5, 6}), ("==", {3}), ("unknown", {3}),
])
def test_comparison_with_a_value(frame, operator, passing):
    got = verdicts(frame, Rule("r", "comparison", ("v",), {"operator": operator, "compare_to_value": 0.0}))
    assert {i for i, v in got.items() if v} == passing
    assert got[7] is None


def test_comparison_between_columns_with_tolerance_and_casts(spark):
    df = spark.createDataFrame([(1, "1.00", "1.01"), (2, "2", "3"), (3, "x", "1")], "id int, a string, b string")
    close = Rule("r", "comparison", ("a",), {"compare_to_field": "b", "tolerance": 0.05, "as": "number"})
    assert verdicts(df, close) == {1: True, 2: False, 3: None}
    dates = spark.createDataFrame([(1, "2020-01-01", "2020-01-02"), (2, "2020-02-01", "2020-01-02"), (3, "soon", "2020-01-01")], "id int, a string, b string")
    ordered = Rule("r", "comparison", ("a",), {"operator": "<=", "compare_to_field": "b", "as": "timestamp"})
    assert verdicts(dates, ordered) == {1: True, 2: False, 3: None}


def test_range_length_allowed_and_regex(frame):
    assert verdicts(frame, Rule("r", "range", ("v",), {"min_value": -1, "max_value": 1}))[2] is True
    assert verdicts(frame, Rule("r", "length", ("s",), {"min_value": 2, "max_value": 7})) == {1: None, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True}
    assert verdicts(frame, Rule("r", "allowed_values", ("s",), {"values": ["x", "yy"]}))[5] is True
    assert [i for i, v in verdicts(frame, Rule("r", "regex", ("s",), {"pattern": "email"})).items() if v] == [7]


def test_guard_passes_rows_it_does_not_hold_for(spark):
    df = spark.createDataFrame([(1, 9.0, 200.0), (2, 9.0, 1.0), (3, 0.1, 200.0), (4, 9.0, None)], "id int, r double, bal double")
    rule = when_guard(Rule("r", "range", ("r",), {"min_value": -0.5, "max_value": 0.5}), Rule("g", "comparison", ("bal",), {"operator": ">", "compare_to_value": 100}))
    assert verdicts(df, rule) == {1: False, 2: True, 3: True, 4: True}


@pytest.mark.parametrize("policy, counts", [("fail", (3, 4, 1)), ("pass", (4, 3, 1)), ("ignore", (3, 3, 1))])
def test_null_policy(frame, policy, counts):
    rule = Rule("r", "comparison", ("v",), {"operator": ">", "compare_to_value": 0.0})
    row = ev.evaluate(frame, [rule], policy).first()
    assert (row.passed_count, row.failed_count, row.unknown_count) == counts
    passed, failed, unknown = ev.split_rows(frame, rule, policy)
    assert (passed.count(), failed.count(), unknown.count()) == (counts[0], counts[1], 1 if policy == "ignore" else 0)


def test_uniqueness_with_nulls_and_guard(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, None, 1), (5, None, 2)], "id int, k string, g int")
    rule = Rule("u", "uniqueness", ("k",))
    assert verdicts(df, rule) == {1: False, 2: False, 3: True, 4: None, 5: None}
    row = ev.evaluate(df, [rule], "ignore").first()
    assert (row.passed_count, row.failed_count, row.unknown_count) == (1, 2, 2)
    guarded = when_guard(rule, Rule("g", "comparison", ("id",), {"operator": ">", "compare_to_value": 1}))
    assert verdicts(df, guarded, "fail") == {1: True, 2: False, 3: True, 4: False, 5: False}
    row = ev.evaluate(df, [guarded]).first()
    assert (row.passed_count, row.failed_count) == (2, 3)


def test_errors_become_rows_and_do_not_stop_other_rules(frame):
    rules = [
        Rule("ok", "not_null", ("s",)), Rule("lost", "not_null", ("nope",)), Rule("bare", "not_null", ()), Rule("odd", "spell_check", ("s",)),
        Rule("open", "comparison", ("v",), {"operator": ">"}), Rule("far", "comparison", ("v",), {"compare_to_field": "w"}), Rule("free", "range", ("v",)),
    ]
    rows = {r.rule: r for r in ev.evaluate(frame, rules).collect()}
    assert rows["ok"].error is None and rows["ok"].passed_count == 4
    assert all(rows[n].error and rows[n].passed_count is None for n in ("lost", "bare", "odd", "open", "far", "free"))
    with pytest.raises(pr.RuleError):
        pr.validate(None, rules[0])
    with pytest.raises(pr.RuleError):
        pr.validate(frame, rules[0], "missing_id")
    with pytest.raises(pr.RuleError):
        ev.with_verdict(frame, rules[0], "maybe")


def test_empty_table_gives_zeros_and_a_message(frame):
    row = ev.evaluate(frame.filter("false"), [Rule("r", "not_null", ("s",))]).first()
    assert (row.passed_count, row.failed_count, row.pass_rate, row.message) == (0, 0, 0.0, "Empty DataFrame")


def test_more_rules_than_columns_of_a_pass(frame):
    rules = [Rule(f"r{i}", "comparison", ("v",), {"operator": ">", "compare_to_value": float(i)}) for i in range(ev.RULES_AS_COLUMNS * 2 + 3)]
    assert ev.evaluate(frame, rules).count() == len(rules)


def test_user_check_joins_the_shared_pass(frame):
    pr.register_check("starts_with", lambda fields, params: pr.column(fields[0]).startswith(params["prefix"]))
    try:
        rules = [Rule("mine", "starts_with", ("s",), {"prefix": "y"}), Rule("sql", "expression", ("v",), {"sql": "v > 0 AND s = 'x'"})]
        rows = {r.rule: r.passed_count for r in ev.evaluate(frame, rules).collect()}
        assert rows == {"mine": 1, "sql": 1}
    finally:
        del pr.CHECKS["starts_with"]


def test_row_local_checks_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, s string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, s string, v double").parquet(str(tmp_path / "in"))
    flagged = ev.with_verdict(stream, Rule("r", "not_null", ("s",)))
    job = flagged.writeStream.format("memory").queryName("flagged").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    job.awaitTermination(60)
    assert spark.table("flagged").filter("verdict").count() == 4


def test_failed_ids_are_the_smallest_hundred_without_nulls(spark):
    df = spark.range(1000).select(F.when(F.col("id") > 2, F.col("id")).alias("id"), F.lit(-1).alias("v"))
    rules = [Rule("neg", "comparison", ("v",), {"operator": ">=", "compare_to_value": 0}), Rule("fine", "comparison", ("v",), {"operator": "<", "compare_to_value": 0})]
    rows = {r.rule: r.failed_ids for r in ev.results_with_ids(df, rules, "id").collect()}
    assert rows["neg"] == list(range(3, 103)) and rows["fine"] is None
    assert ev.result_id(df, "absent") == "id"


def test_id_lists_are_whole(spark):
    df = spark.range(2500).withColumn("v", F.col("id") % 2)
    lists = ev.id_lists(df, [Rule("even", "comparison", ("v",), {"compare_to_value": 0})], "id", F.floor(F.col("id") / 100))
    row = lists.agg(F.sum(F.size("passed_records")).alias("p"), F.sum(F.size("failed_records")).alias("f"), F.max(F.size("passed_records")).alias("m")).first()
    assert (row.p, row.f, row.m) == (1250, 1250, 50)


def test_rule_table_round_trip(spark):
    guard = Rule("seven guard", "comparison", ("closing_balance",), {"operator": ">", "compare_to_value": 100000})
    rules = [
        Rule("one", "not_null", ("account_number",), entities=("Account Number",), category="completeness"),
        Rule("seven", "range", ("ytd_return",), {"min_value": -0.5, "max_value": 0.5}, guard, complexity="complex"),
    ]
    assert rules_from_frame(rules_frame(spark, rules)) == rules


def test_referential_counts_with_null_and_hot_keys(spark):
    child = spark.createDataFrame([(1,)] * 50 + [(2,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "p int")
    row = ev.referential_counts(child, parent, "k", "p").first()
    assert (row.passed_count, row.failed_count) == (51, 1)
    assert {r.k for r in ev.orphans(child, parent, "k", "p").collect()} == {9, None}


def test_failing_rules_fail_by_themselves(spark):
    df = spark.createDataFrame([(1, "abc", 5.0), (2, "7", 1.0), (2, None, None)], "id int, s string, v double")
    rules = [
        Rule("same name", "not_null", ("gone",)),
        Rule("same name", "comparison", ("v",), {"operator": ">"}),
        Rule("text range", "range", ("s",), {"min_value": 1}),
        Rule("text against number", "comparison", ("s",), {"operator": "<", "compare_to_value": 9}),
        Rule("text against column", "comparison", ("s",), {"operator": ">", "compare_to_field": "v"}),
        Rule("text in numbers", "allowed_values", ("s",), {"values": [7, 8]}),
        Rule("bad pattern", "regex", ("s",), {"pattern": "(["}),
        Rule("bad sql", "expression", ("v",), {"sql": "v >"}),
        Rule("unknown column", "expression", ("v",), {"sql": "nowhere > 1"}),
        Rule("no condition", "expression", ("v",), {"sql": "v + 1"}),
        Rule("bad guard", "not_null", ("v",), guard=Rule("g", "no such check", ("v",))),
        Rule("key", "uniqueness", ("id",)),
        Rule("good", "not_null", ("v",)),
    ]
    rows = ev.results_with_ids(df, rules, "id").collect()
    assert len(rows) == len(rules)
    failed = {r.rule for r in rows if r.error}
    assert failed == {"same name", "bad pattern", "bad sql", "unknown column", "no condition", "bad guard"}
    assert sum(r.rule == "same name" for r in rows) == 2
    got = {r.rule: (r.passed_count, r.failed_count, r.unknown_count, r.failed_ids) for r in rows if not r.error}
    assert got == {
        "text range": (1, 2, 2, [1, 2]), "text against number": (1, 2, 2, [1, 2]), "text against column": (1, 2, 2, [1, 2]), "text in numbers": (1, 2, 2, [1, 2]),
        "key": (1, 2, 0, [2, 2]), "good": (2, 1, 0, [2]),
    }


def test_many_rules_in_one_scan(spark):
    df = spark.range(100)
    rules = [Rule("r", "comparison", ("id",), {"operator": "<", "compare_to_value": n}) for n in range(60)]
    results = ev.evaluate(df, rules)
    assert sorted(r.passed_count for r in results.collect()) == list(range(60))
    assert results._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 100") == 1
    assert {(r.passed_count, r.message) for r in ev.evaluate(df.limit(0), rules).collect()} == {(0, "Empty DataFrame")}
