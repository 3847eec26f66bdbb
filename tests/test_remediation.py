import pytest
from pyspark.sql import functions as F

from gaugeline.operators import remediation as rm
from gaugeline.operators.predicates import RuleError
from gaugeline.plans import suggest as sg
from gaugeline.plans.rules import Rule

ROWS = [(1, None, -5.0, " x ", "7"), (2, None, -5.0, " x ", "bad"), (3, "k", 5.0, "y", "8"), (4, None, 5.0, "y", "9")]
LOW = Rule("not negative", "comparison", ("v",), {"operator": ">=", "compare_to_value": 0})


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, s string, v double, t string, n string")


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_only_targeted_rows_change(df):
    fixed = rows(rm.remediate(df, rm.Action("fillna", ("s",), params={"value": "U"}), "id", [1]))
    assert [r[1] for r in fixed] == ["U", None, "k", None]
    fixed = rows(rm.remediate(df, rm.Action("replace", ("v",), "s IS NULL", {"value": 0}), "id", LOW))
    assert [r[2] for r in fixed] == [0.0, 0.0, 5.0, 5.0]
    fixed = rm.remediate(df, rm.Action("standardize", ("t",), params={"trim": True, "case": "upper", "pattern": "X", "replacement": "Z"}), "id", [1])
    assert [r[3] for r in rows(fixed)] == ["Z", " x ", "y", "y"]
    assert fixed.schema["v"].dataType == df.schema["v"].dataType


def test_cast_and_filter_and_review(df):
    cast = rm.remediate(df, rm.Action("cast", ("n",), params={"to": "int"}), "id", [2])
    assert [r[4] for r in rows(cast)] == [7, None, 8, 9]
    kept = rm.remediate(df, rm.Action("filter", where="v < 0"), "id", [2, 3])
    assert [r[0] for r in rows(kept)] == [1, 3, 4]
    assert [r[0] for r in rows(rm.review_rows(df, "id", [2, 9]))] == [2]
    assert rows(rm.remediate(df, rm.Action("review"), "id", [2])) == rows(df)


def test_deduplicate_keeps_the_smallest_id_among_targets(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id int, k string")
    kept = rm.remediate(df, rm.Action("deduplicate", params={"keys": ("k",)}), "id", [2, 3, 4])
    assert [r[0] for r in rows(kept)] == [1, 2, 4]


def test_targets_as_frame_and_long_list(spark):
    df = spark.range(400).withColumn("v", F.lit(None).cast("int"))
    action = rm.Action("fillna", ("v",), params={"value": 1})
    ids = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x long")
    assert rm.remediate(df, action, "id", ids).filter("v = 1").count() == 2
    assert rm.remediate(df, action, "id", list(range(250))).filter("v = 1").count() == 250


@pytest.mark.parametrize("action, id_column, targets", [
    (rm.Action("fillna", ("s",), params={"value": 1}), "id", []), (rm.Action("fillna", ("s",), params={"value": 1}), None, [1]), (rm.Action("explode", ("s",)), "id", [1]),
    (rm.Action("fillna", ("id",), params={"value": 1}), "id", [1]), (rm.Action("fillna", ("zz",), params={"value": 1}), "id", [1]), (rm.Action("filter"), "id", [1]),
])
def test_refused_repairs(df, action, id_column, targets):
    with pytest.raises(rm.RemediationError):
        rm.remediate(df, action, id_column, targets)


def test_unique_rule_targets_need_ids(df):
    with pytest.raises(RuleError):
        rm.remediate(df, rm.Action("review"), "id", Rule("u", "uniqueness", ("s",)))


def test_audit_counts_real_changes(df):
    row = rm.audit_row(df, rm.Action("review", rule_name="r"), "id", [1, 3, 99], F.lit("2025-01-01").cast("timestamp"), 4).first()
    assert (row.rule_index, row.n_ids, row.ids) == (4, 2, ["1", "3"])
    log = rm.audit_row(df, rm.Action("fillna", ("s",), params={"value": "U"}, rule_name="r", logic="l"), "id", [1, 3, 99], F.lit("2025-01-01").cast("timestamp")).first()
    assert (log.rows_in_scope, log.rows_affected, log.rule_name) == (2, 1, "r")
    removed = rm.changes(df, rm.Action("filter", where="v < 0"), "id", [1, 3]).first()
    assert (removed.rows_in_scope, removed.rows_affected) == (2, 1)
    assert rm.changes(df, rm.Action("review"), "id", [1]).first().rows_affected == 0


def test_recheck_and_preview(df):
    stages = {r.stage: (r.passed_count, r.failed_count) for r in rm.recheck(df, rm.Action("replace", ("v",), "v < 0", {"value": 0}), LOW, "id", LOW).collect()}
    assert stages == {"before": (2, 2), "after": (4, 0)}
    assert [r.id for r in rm.preview_rows(df, rm.Action("fillna", ("s",), params={"value": "U"}), "id", LOW).collect()] == [1, 2]


def test_tables_are_repaired_by_their_own_ids(spark):
    left = spark.createDataFrame([(1, 10, None), (2, 20, None)], "k int, lid int, a string")
    right = spark.createDataFrame([(1, 100), (2, 200)], "rid_k int, rid int")
    failing = spark.createDataFrame([(10, 200)], "lid int, rid int")
    fixed = rm.remediate_tables({"l": left, "r": right}, {"l": rm.Action("fillna", ("a",), params={"value": "z"})}, failing, {"l": "lid"})
    assert rows(fixed["l"])[0] == (1, 10, "z") and fixed["l"].columns == left.columns and fixed["r"] is right


def test_suggested_repairs(spark):
    patterns = spark.createDataFrame([(1, 1, "s is null", 3), (2, 3, "net is blank is negative", 1)], "position int, kind int, pattern string, count long")
    got = {(r.target_column, r.action_type, r.requires_business_approval) for r in sg.repair_suggestions(patterns).collect()}
    assert got == {("s", "fillna", True), ("net is blank", "replace", True)}
    assert sg.repair_suggestions(patterns.filter("false")).first().action_type == "review"


def test_suggested_rules_skip_known_ones(spark):
    df = spark.createDataFrame([(1, "ab", 0.25), (2, "abcd", 1.5)], "acct_id int, name string, rate double")
    known = spark.createDataFrame([("Acct ID must be unique",)], "business_rule string")
    got = {r.business_rule for r in sg.rule_suggestions(sg.column_bounds(df, df.columns), known).collect()}
    assert got == {
        "acct id must not be null or empty", "acct id must be between 1 and 2", "name must not be null or empty", "name length must be between 2 and 4",
        "rate must not be null or empty", "rate must be between 0.2500 and 1.5000",
    }
