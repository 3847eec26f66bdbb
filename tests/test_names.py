"""Names in texts against a plain search."""

import random

from gaugeline.operators import names as nm
from gaugeline.operators import schema as sc
from gaugeline.operators import tables as tb


def check(spark, texts, names):
    got = sorted((r.id, r.name) for r in nm.names_in_texts(spark.createDataFrame(texts, "id int, body string"), "id", "body", spark.createDataFrame([(n,) for n in names], "name string"), "name").collect())
    assert got == sorted((i, n) for i, t in texts for n in {x for x in names if x} if t and n in t)


def test_against_plain_search(spark):
    rng = random.Random(1)
    letters = "ab é🙂"
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["", None, "ab", "ab"]
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))) for i in range(200)] + [(500, None), (501, ""), (3, "ab ab")]
    check(spark, texts, names)


def test_more_names_than_one_automaton_holds(spark, monkeypatch):
    monkeypatch.setattr(nm, "NAMES_PER_PASS", 7)
    names = [f"n{i}" for i in range(60)]
    check(spark, [(i, f"x n{i} and n{i + 30}") for i in range(30)], names)


def test_no_names_no_texts_and_long_words(spark):
    check(spark, [(1, "abc")], [])
    check(spark, [], ["abc"])
    check(spark, [(1, "q" * 200_000 + "needle" + "q" * 200_000), (2, "needl")], ["needle", "qqq"])


def test_groups_hold_the_list_of_all_once(spark):
    rules = spark.createDataFrame([(i, "check total" if i == 1 else "none" + "x" * 3000) for i in range(50)], "rule_id int, text string")
    entities = spark.createDataFrame([(0, 1, "amount"), (0, 2, "amount")], "rule_id int, pos int, entity string")
    mapping = spark.createDataFrame([("amount", "amt", 1), ("total", "tot", 2), ("other", "oth", 3), ("gone", "gone", 4)], "entity string, column string, map_pos int")
    columns = spark.createDataFrame([("amt",), ("tot",), ("oth",)], "column string")
    placed, members = sc.rule_column_groups(rules, entities, mapping, columns)
    assert placed.count() == 50 and {(r.grp, r.column) for r in members.collect()} == {("rule/0", "amt"), ("rule/1", "tot"), ("*", "amt"), ("*", "tot"), ("*", "oth")}
    got = {(r.rule_id, r.column) for r in sc.rule_columns(rules, entities, mapping, columns).collect()}
    assert got == {(0, "amt"), (1, "tot")} | {(i, c) for i in range(2, 50) for c in ("amt", "tot", "oth")}
    tables = spark.createDataFrame([("a",), ("b",)], "table_name string")
    given = spark.createDataFrame([(0, "new"), (0, "new")], "rule_id int, table_name string")
    stored = spark.createDataFrame([(0, "a"), (1, "b"), (1, "ghost"), (2, "ghost")], "rule_id int, table_name string")
    placed, members = tb.involved_groups(rules, given, stored, tables)
    assert placed.count() == 50 and members.count() == 4
    got = sorted((r.rule_id, r.table_name) for r in tb.involved_tables(rules.filter("rule_id < 4"), given, stored, tables).collect())
    assert got == [(0, "new"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b")]
