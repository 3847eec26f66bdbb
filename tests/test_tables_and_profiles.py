import json
import math

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import evaluate as ev
from gaugeline.operators import keys as ky
from gaugeline.operators import profiling as pf
from gaugeline.operators import schema as sc
from gaugeline.operators import tables as tb
from gaugeline.operators.predicates import RuleError
from gaugeline.plans.rules import Rule, append_rules, new_rules_only, upsert_checks, with_classes
from gaugeline.sources import sinks, tables


# ---- sources and sinks ----------------------------------------------------------------


def test_sanitized_names_never_collide(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a.b", "a b", "a..b", "c"])
    safe, mapping = tables.sanitize_columns(df)
    assert safe.columns == ["a_b", "a_b_2", "a_b_3", "c"]
    assert mapping["a b"] == "a_b_2"


def test_loading_in_several_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", math.nan), (2, "y", 2.0)], "`the id` int, s string, v double")
    for kind in ("parquet", "json", "csv", "orc"):
        df.write.format(kind).option("header", True).save(str(tmp_path / kind))
        loaded = tables.load_table(spark, str(tmp_path / kind), kind)
        assert sorted(loaded.columns) == ["s", "the_id", "v"] and loaded.count() == 2
    clean = tables.load_table(spark, str(tmp_path / "parquet"), clean_nan=True)
    assert [r.v for r in clean.orderBy("the_id").collect()] == [None, 2.0]
    data = tables.load_dataset(spark, [str(tmp_path / "parquet")])
    assert tables.tables_meta(data) == {"parquet": ["the_id", "s", "v"]}
    assert [(r.position, r.column_name) for r in tables.columns_frame(data).orderBy("position").collect()] == [(1, "the_id"), (2, "s"), (3, "v")]
    n, text = tables.describe(clean)
    assert n == 2 and "the_id" in text
    assert tables.table_from_rows(spark, [(1, "A", 30)], ["id", "name", "age"]).filter("age > 28").count() == 1


def test_rule_table_from_csv_lacks_columns(spark, tmp_path):
    (tmp_path / "rules.csv").write_text('id,name,business_rule,entities\n1,First,"A, B must match","[""A"", ""B""]"\n2,Second,x,\n')
    rows = tables.load_rules(spark, str(tmp_path / "rules.csv")).orderBy("id").collect()
    assert rows[0].entities == ["A", "B"] and rows[0].check_type is None and rows[1].entities is None


def test_target_schema_document(spark, tmp_path):
    doc = {"target_columns": [{"name": "a", "type": "int"}, {"name": "b", "category": "money", "table_name": "T"}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    target = tables.load_target_schema(spark, str(tmp_path / "s.json"))
    fields = {r.name: (r.type, r.category, r.position) for r in sc.parse_fields(target).collect()}
    assert fields == {"a": ("int", "general", 1), "b": ("string", "money", 2)}
    (tmp_path / "bad.json").write_text("not json")
    assert tables.load_target_schema(spark, str(tmp_path / "bad.json")).count() == 0


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, s string")
    sinks.export_failed(df, str(tmp_path / "f"), "id", [1])
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).count() == 2
    for frame, id_column, ids in ((None, "id", [1]), (df, "id", []), (df, "nope", [1])):
        with pytest.raises(sinks.ExportError):
            sinks.export_failed(frame, str(tmp_path / "g"), id_column, ids)
    sinks.export_remediated(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["id", "s"]
    lists = ev.id_lists(df, [Rule("r", "allowed_values", ("s",), {"values": ["x"]})], "id", F.lit(0))
    sinks.export_id_lists(lists, str(tmp_path / "l"))
    row = spark.read.json(str(tmp_path / "l")).first()
    assert (row.Rule, row.Passed_records, row.Failed_records) == ("r", [1], [2])
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_preview_is_json_safe(spark):
    df = spark.createDataFrame([(2, math.inf, None), (1, math.nan, "x")], "id int, v double, s string")
    got = [json.loads(r.record) for r in tables.preview(df, ["id"]).collect()]
    assert got == [{"id": 1, "v": None, "s": "x"}, {"id": 2, "v": None, "s": None}]


# ---- keys -------------------------------------------------------------------------------


def test_key_is_the_first_full_and_distinct_column(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (1, "b", "y", 2), (2, "c", "z", 3)], "a int, b string, c string, d int")
    assert ky.find_key(df) == "c"
    report = {r.column_name: (r.is_key, r.is_first_key) for r in ky.key_report(df).collect()}
    assert report == {"a": (False, False), "b": (False, False), "c": (True, True), "d": (True, False)}
    assert ky.with_key(df, "d")[1] == "d" and ky.with_key(df, "gone")[1] == "c"


def test_no_key_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "a int, b string")
    assert ky.find_key(df) is None
    assert not ky.key_report(df).filter("is_key").count()
    keyed, name = ky.with_key(df)
    assert name == ky.GENERATED_ID and keyed.select(name).distinct().count() == 3
    stable = ky.with_generated_id(df, stable=True).orderBy("generated_id").collect()
    assert [(r.a, r.b, r.generated_id) for r in stable] == [(1, "x", 0), (1, "x", 1), (1, "y", 2)]
    assert ky.find_key(df.filter("false")) == "a"
    assert ky.key_report(df.filter("false")).filter("is_first_key").first().column_name == "a"


def test_nan_counts_as_a_value(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,)], "v double")
    assert ky.find_key(df) == "v"
    assert ky.find_key(df.union(df.filter("isnan(v)"))) is None


def test_id_is_added_where_it_lacks(spark):
    frames = {"t1": spark.range(3), "t2": spark.range(2).toDF("gid"), "t3": spark.range(1)}
    done = ky.propagate_id(frames, ["t1", "t2"], "gid")
    assert [("gid" in done[t].columns) for t in ("t1", "t2", "t3")] == [True, True, False]


# ---- profiles -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def failed(spark):
    rows = [(1, "", -1.0, None), (2, " ", 2.0, 5), (3, None, math.nan, 5), (4, "a", None, -2), (None, "a", 2.0, 5)]
    return spark.createDataFrame(rows, "id int, s string, v double, n int")


def test_column_profile(failed):
    rows = {r.column_name: r for r in pf.column_profile(failed, ["s", "v", "n"]).collect()}
    assert (rows["s"].null_count, rows["s"].blank_count, rows["s"].negative_count) == (1, 1, None)
    assert (rows["v"].null_count, rows["v"].min_value, rows["v"].negative_count) == (1, -1.0, 1) and math.isnan(rows["v"].max_value)
    assert (rows["n"].min_value, rows["n"].max_value, rows["n"].rows_in_scope) == (-2.0, 5.0, 5)


def test_patterns_values_and_records(failed):
    context = pf.failed_context(failed, ["s", "v", "gone"], "id")
    assert [(r.pattern, r["count"]) for r in context["patterns"].collect()] == [("s is null", 1), ("s is blank", 1), ("v is null", 1), ("v is negative", 1)]
    assert [r.value for r in context["values"].filter("column_name = 's'").orderBy("rank").collect()] == ["", " ", "a"]
    assert [r.id for r in context["ids"].collect()] == [1, 2, 3, 4]
    records = pf.sample_records(failed, ["n"], "id").collect()
    assert {(r.id, r.n) for r in records} == {(1, None), (2, 5), (4, -2)}
    scoped = pf.failed_context(failed, [], "id", [1, 2])
    assert {r.column_name for r in scoped["profile"].collect()} == {"s", "v", "n"}
    assert scoped["profile"].first().rows_in_scope == 2


# ---- several tables -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def three(spark):
    return {
        "t1": spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string").withColumn("generated_id", F.lit(0)),
        "t2": spark.createDataFrame([(1, "c"), (3, "d")], "k int, y string").withColumn("generated_id", F.lit(9)),
        "t3": spark.createDataFrame([("q",)], "z string"),
    }


def test_auto_join(three):
    joined = tb.auto_join(three, ["t1", "t2"])
    assert [(r.k, r.x, r.y, r.generated_id) for r in joined.collect()] == [(1, "a", "c", 0)]
    with_one = tb.auto_join(three, ["t1", "t3"], single_row=["t3"])
    assert sorted((r.k, r.z) for r in with_one.collect()) == [(1, "q"), (2, "q")]
    with pytest.raises(RuleError):
        tb.auto_join(three, ["t1", "t3"])
    assert tb.auto_join(three, ["unknown"]).columns == three["t1"].columns
    assert tb.common_columns(three["t1"], three["t2"]) == ["k"]


def test_rename_last_target_wins(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tb.rename_to_schema(df, {"x": "a", "y": "a", "b": "b", "z": "gone"}).columns == ["y", "b"]


def test_join_keys_and_row_counts(three):
    pairs = tb.join_keys(tables.columns_frame(three).filter("column_name <> 'generated_id'")).collect()
    assert [(r.left_table, r.right_table, r.shared) for r in pairs] == [("t1", "t2", ["k"])]
    assert {r.table_name: r.row_count for r in tb.row_counts(three).collect()} == {"t1": 2, "t2": 2, "t3": 1, "(all)": 5}


def test_involved_tables_chain(spark):
    rules = spark.createDataFrame([(1,), (2,), (3,)], "rule_id int")
    given = spark.createDataFrame([(1, "T9")], "rule_id int, table_name string")
    stored = spark.createDataFrame([(1, "T1"), (2, "T1"), (2, "gone"), (3, "gone")], "rule_id int, table_name string")
    known = spark.createDataFrame([("T1",), ("T2",)], "table_name string")
    got = sorted((r.rule_id, r.table_name) for r in tb.involved_tables(rules, given, stored, known).collect())
    assert got == [(1, "T9"), (2, "T1"), (3, "T1"), (3, "T2")]


def test_tables_of_columns_prefers_the_dataset_column(spark):
    needed = spark.createDataFrame([(1, "s1"), (1, "s2"), (1, "s3")], "rule_id int, schema_col string")
    columns = spark.createDataFrame([("B", 2, "d1"), ("A", 1, "s1"), ("A", 1, "s2"), ("B", 2, "s2")], "table_name string, table_pos int, column_name string")
    mapping = spark.createDataFrame([("s1", "d1"), ("s2", "lost")], "schema_col string, dataset_col string")
    got = {r.schema_col: r.table_name for r in tb.tables_of_columns(needed, columns, mapping).collect()}
    assert got == {"s1": "B", "s2": "A"}


def test_rows_with_ids_by_list_long_list_and_frame(spark):
    df = spark.range(500)
    assert tb.rows_with_ids(df, "id", [1, 2, 2]).count() == 2
    assert tb.rows_with_ids(df, "id", list(range(150)) * 2).count() == 150
    assert tb.rows_with_ids(df, "id", spark.createDataFrame([(1,), (1,), (None,)], "x long")).count() == 1


# ---- schema metadata and rule tables ----------------------------------------------------------


def test_rule_columns_falls_back_to_text_then_to_all(spark):
    rules = spark.createDataFrame([(1, "x"), (2, "Check the Closing Balance!"), (3, "nothing"), (4, "subperf_dates")], "rule_id int, text string")
    entities = spark.createDataFrame([(1, 2, "net"), (1, 1, "gross"), (1, 3, "net"), (2, 1, "unmapped")], "rule_id int, pos int, entity string")
    mapping = spark.createDataFrame([("net", "net_return", 1), ("gross", "gross_return", 2), ("closing balance", "bal", 3), ("when", "perf_date", 4)], "entity string, column string, map_pos int")
    columns = spark.createDataFrame([("net_return",), ("gross_return",), ("bal",), ("perf_date",)], "column string")
    rows = sc.rule_columns(rules, entities, mapping, columns).orderBy("rule_id", "pos").collect()
    by_rule = {}
    for r in rows:
        by_rule.setdefault(r.rule_id, []).append(r.column)
    assert by_rule == {1: ["gross_return", "net_return"], 2: ["bal"], 3: ["net_return", "gross_return", "bal", "perf_date"], 4: ["perf_date"]}


def test_inferred_checks_and_types(spark):
    fields = spark.createDataFrame([("acct_id", "INT"), ("d", "date"), ("s", "string"), ("b", "boolean")], "name string, type string")
    got = {}
    for r in sc.with_inferred_checks(fields).collect():
        got.setdefault(r.name, []).append(r.check_type)
    assert got == {"acct_id": ["not_null", "range", "uniqueness"], "d": ["not_null", "comparison"], "s": ["not_null", "length", "regex"], "b": ["not_null"]}


def test_column_types_priorities(spark):
    target = spark.createDataFrame([("s1", "int", "c", 1), ("s2", "date", "c", 2), ("Perf Date", "date", "c", 3)], "name string, type string, category string, position int")
    mapping = spark.createDataFrame([("e1", "s1", 1), ("e2", "s2", 2), ("e3", "perf_date", 3)], "entity string, schema_col string, map_pos int")
    hops = spark.createDataFrame([("s1", "d", 1), ("s2", "d", 2)], "schema_col string, dataset_col string, pos int")
    got = {r.column: (r.type, r.schema_col) for r in sc.column_types(mapping, hops, target).collect()}
    assert got == {"d": ("date", "s2"), "s1": ("int", "s1"), "s2": ("date", "s2"), "perf_date": ("date", "Perf Date")}
    names = spark.createDataFrame([("d",), ("S1",), ("other",)], "column string")
    kinds = {r.column: (r.type, r.source) for r in sc.inferred_type(names, sc.column_types(mapping, hops, target), target).collect()}
    assert kinds == {"d": ("date", "mapped"), "S1": ("int", "schema"), "other": (None, "unmapped")}


def test_batches_hold_a_bounded_number_of_names(spark):
    columns = spark.createDataFrame([(i, f"c{i}") for i in range(1, 48)], "position int, name string")
    rows = sc.batches(columns, "position", "name", 20).orderBy("batch").collect()
    assert [(r.batch, r.first_column, r.last_column) for r in rows] == [(1, 1, 20), (2, 21, 40), (3, 41, 47)]
    assert rows[2].names == "c41, c42, c43, c44, c45, c46, c47"


def test_rule_rows(spark):
    old = spark.createDataFrame([("a", 1)], "name string, n int")
    new = spark.createDataFrame([("b", "x")], "name string, extra string")
    assert {tuple(r) for r in append_rules(old, new).collect()} == {("a", 1, None), ("b", None, "x")}
    registry = spark.createDataFrame([("My Check", 1, "old"), ("Other", 1, "o")], "name string, version int, body string")
    change = spark.createDataFrame([("my check", 2, "new")], "name string, version int, body string")
    assert {r.slug: r.body for r in upsert_checks(registry, change).collect()} == {"my_check": "new", "other": "o"}
    text = spark.createDataFrame([("Net  must be > 0",), ("brand new",)], "business_rule string")
    known = spark.createDataFrame([(" net must BE > 0 ",)], "business_rule string")
    assert [r.business_rule for r in new_rules_only(text, known).collect()] == ["brand new"]


def test_sample_rules_get_their_classes(spark):
    guard = Rule("g", "comparison", ("closing_balance",), {"operator": ">", "compare_to_value": 100000})
    rules = [
        Rule("1", "not_null", ("account_number",)), Rule("2", "comparison", ("closing_balance",), {"operator": ">=", "compare_to_value": 0}),
        Rule("3", "range", ("net_return",), {"min_value": -1, "max_value": 1}), Rule("4", "comparison", ("performance_date",), {"operator": "<=", "compare_to_field": "period_end_date"}),
        Rule("6", "comparison", ("total_inflows",), {"compare_to_field": "deposits"}), Rule("7", "range", ("ytd_return",), {"min_value": -0.5, "max_value": 0.5}, guard),
    ]
    from gaugeline.plans.rules import rules_frame

    bare = rules_frame(spark, rules).withColumn("complexity", F.lit(None).cast("string")).withColumn("category", F.lit(None).cast("string"))
    got = {r.name: (r.complexity, r.category) for r in with_classes(bare).collect()}
    assert got == {
        "1": ("simple", "completeness"), "2": ("simple", "validity"), "3": ("medium", "validity"), "4": ("medium", "consistency"),
        "6": ("medium", "consistency"), "7": ("complex", "business_logic"),
    }


def test_all_columns_are_settled_in_two_jobs(spark):
    """Thirty columns that a sketch cannot rule out: keys and near keys are told apart by one pass."""
    df = spark.range(3000).select(*[(F.when((F.col("id") == 7) & F.lit(k % 3 == 1), 8).otherwise(F.col("id")) * (k + 1)).alias(f"c {k}.x") for k in range(30)])
    tracker, group = spark.sparkContext.statusTracker(), "key-jobs"
    spark.sparkContext.setJobGroup(group, "keys")
    try:
        report = {r.position: (r.is_key, r.is_first_key) for r in ky.key_report(df).collect()}
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert report == {k + 1: (k % 3 != 1, k == 0) for k in range(30)}
    assert jobs < 20  # stages of two queries and the scalar, not thirty queries
    assert ky.find_key(df) == "c 0.x" and ky.find_key(df.select(*[f"`c {k}.x`" for k in (1, 4, 5)])) == "c 5.x"


def test_zeros_of_either_sign_are_one_value(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "b")], "v double, s string")
    assert ky.find_key(df) == "s"


def test_ids_from_content_do_not_follow_the_layout(spark, monkeypatch):
    monkeypatch.setattr(ky, "COPIES", 7)
    rows = [(k % 5, f"s{k % 3}", None if k % 4 else float(k % 2)) for k in range(200)] + [(9, "once", 0.5)] * 50 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "`a.b` int, s string, v double")
    found = []
    for n in (1, 13):
        keyed = ky.with_content_id(df.repartition(n)).collect()
        assert sorted(map(repr, ((r["a.b"], r.s, r.v) for r in keyed))) == sorted(map(repr, rows))
        assert len({r.generated_id for r in keyed}) == len(rows)
        found.append({r.generated_id for r in keyed})
    assert found[0] == found[1]
    assert sorted(int(i.split("-")[1]) for i in (r.generated_id for r in ky.with_content_id(df).filter("s = 'once'").collect())) == list(range(50))
    assert ky.with_content_id(df.limit(0)).collect() == []
