import random

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import questions as qs
from gaugeline.functions import replies as rp
from gaugeline.functions import similarity as sm
from gaugeline.functions import text as tx


def one(spark, column, value, schema="string"):
    return spark.createDataFrame([(value,)], f"v {schema}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value, want", [
    ("Account Number Not Empty", "account_number_not_empty"), ("Perf. Date <= Period-End!", "perf_date_period_end"), ("", "dq_rule"), (None, "dq_rule"),
    ("  __x__ ", "x"), ("!!!", "dq_rule"),
])
def test_slug(spark, value, want):
    assert one(spark, tx.slug, value) == want
    assert one(spark, tx.check_name, value) == "dq_" + want


def test_names(spark):
    assert one(spark, tx.normalized_name, "Acct_Number.No#2") == "acct number no2"
    assert one(spark, tx.sanitized_name, "a. b..c") == "a_b_c"
    assert one(spark, tx.variable_name, "My Sheet-1") == "My_Sheet_1"
    assert one(spark, tx.without_id_assignments, "a = 1\n  id_column = 'x'\nid_column = y\nb") == "a = 1\nid_column = y\nb"
    assert one(spark, tx.words, " a\t b\n") == ["a", "b"]


def test_numbers_and_times(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "v double")
    assert [r.r for r in df.select(tx.json_safe_number(F.col("v")).alias("r")).collect()] == [None, None, None, 1.5, None]
    assert one(spark, tx.to_number, "12.5") == 12.5 and one(spark, tx.to_number, "12a") is None
    assert str(one(spark, tx.run_time, "02 Jan 2025 15:04:05")) == "2025-01-02 15:04:05"
    assert one(spark, tx.run_time, "yesterday") is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def token_set(a, b):
    a, b = set(a.split()), set(b.split())
    if not a or not b:
        return 0.0
    shared, left, right = a & b, a - b, b - a
    if shared and (not left or not right):
        return 1.0
    join = lambda s: " ".join(sorted(s))
    texts = [join(shared), (join(shared) + " " + join(left)).strip(), (join(shared) + " " + join(right)).strip()]
    pairs = [(texts[1], texts[2])] + ([(texts[0], texts[1]), (texts[0], texts[2])] if shared else [])
    return max(2 * lcs(x, y) / (len(x) + len(y)) for x, y in pairs)


def test_token_set_similarity_against_brute_force(spark):
    rng = random.Random(5)
    words = ["account", "acct", "number", "no", "date", "perf", "balance", "closing", "x", "total inflow", ""]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for _ in range(300)]
    long = "".join(rng.choice("abc") for _ in range(90))
    pairs += [(long, long[::-1]), (long + " z", "z " + long[:80]), ("kitten", "sitting")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    key = lambda c: sm.token_key(F.col(c))
    got = {r.i: r.s for r in rows.select("i", sm.name_similarity(key("a"), key("b")).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(token_set(a, b)), (a, b)


def test_common_subsequence_of_long_texts():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (0, 1, 30, 62, 63, 70, 100)]
    assert all(sm.common_subsequence(a, b) == lcs(a, b) for a in texts for b in texts)


def test_vector_measures(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(sm.cosine(F.col("a"), F.col("b")).alias("c"), sm.squared_l2(F.col("a"), F.col("b")).alias("d")).collect()
    assert [round(r.c, 6) for r in got] == [0.96, 0.0, 0.0]
    assert got[0].d == 2.0
    units = df.select(sm.unit(F.col("a")).alias("u")).collect()
    assert [[round(x, 6) for x in r.u] if r.u else r.u for r in units] == [[0.6, 0.8], [0.0, 0.0], None]


@pytest.mark.parametrize("reply, check, params", [
    ('```json\n{"check_type": "range", "parameters": {"min_value": 0}}\n```', "range", '{"min_value":0}'),
    ('Sure: {"check_type": "regex", "parameters": {}} ok', "regex", "{}"), ("{broken", "not_null", "{}"), ("", "not_null", "{}"), (None, "not_null", "{}"),
    ('{"other": 1}', None, None),
])
def test_replies(spark, reply, check, params):
    assert one(spark, rp.check_type_or_default, reply) == check
    assert one(spark, rp.parameters_or_default, reply) == params


def test_reply_arrays(spark):
    assert one(spark, rp.expanded_ranges, "a [0 for _ in range(3)] b [1.5 for _ in range(2)]") == "a [0, 0, 0] b [1.5, 1.5]"
    assert one(spark, lambda c: rp.outer_array(c), 'x ```json [0 for _ in range(2)] ``` y') == "[0, 0]"
    assert one(spark, lambda c: F.to_json(rp.parsed_array(c)), "text [1, 2] more") == "[1,2]"
    assert one(spark, lambda c: rp.parsed_array(c).isNull(), "text [1, 2 more") is True


@pytest.mark.parametrize("text, number", [
    ("what does Rule 3 do", 3), ("rule #12?", 12), ("rule no. 4", 4), ("rule number 5", 5), ("the Third rule please", 3), ("rules 3", None), ("no rule here", None),
    ("second rule and rule 9", 9),
])
def test_rule_numbers(spark, text, number):
    assert one(spark, qs.rule_number, text) == number


@pytest.mark.parametrize("text, history, want", [
    ("it failed why exactly then", True, "yes"), ("show me", True, "yes"), ("show me", False, "no"), ("Why?", True, "yes"), ("give me code for rule 1", True, "no"),
    ("which rules ran before the third of march", True, "undecided"), (" ".join(["word"] * 16), True, "no"), ("please say the same about all of the rules of before", True, "yes"),
])
def test_follow_up(spark, text, history, want):
    assert one(spark, lambda c: qs.follow_up(c, F.lit(history)), text) == want


def test_intent_override(spark):
    assert one(spark, lambda c: qs.settled_intent(F.lit("schema_query"), c), "List the tables") == "schema_data_query"
    assert one(spark, lambda c: qs.settled_intent(F.lit("schema_query"), c), "how many tables") == "schema_query"
    assert one(spark, lambda c: qs.settled_intent(F.lit("rule_query"), c), "list rules") == "rule_query"
