import pytest
from pyspark.sql import functions as F

from gaugeline import session
from gaugeline.operators import ranking as rk
from gaugeline.operators.skew import spread_join, spread_rows


@pytest.fixture(scope="module")
def sides(spark):
    hot = spark.range(0, 6000).select(F.lit(7).alias("k"), F.col("id").alias("a"))
    cold = spark.range(0, 6000).select((F.col("id") % 3000 + 100).cast("int").alias("k"), F.col("id").alias("a"))
    nulls = spark.range(0, 50).select(F.lit(None).cast("int").alias("k"), F.col("id").alias("a"))
    left = hot.unionByName(cold).unionByName(nulls)
    right = spark.createDataFrame([(7, "x"), (7, "y"), (150, "z"), (9999, "w"), (None, "n")], "k int, b string")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(sides, how):
    left, right = sides
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    got = sorted(map(key, spread_join(left, right, ["k"], how).collect()))
    want = sorted(map(key, left.join(right, ["k"], how).collect()))
    assert got == want


PAIRS = [
    ("int", "bigint", "7"), ("bigint", "int", "7"), ("date", "timestamp", "'2024-03-01'"), ("decimal(10,2)", "double", "7.5"), ("string", "bigint", "'7'"),
]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("left_type,right_type,value", PAIRS)
def test_hot_keys_of_mixed_types_meet(spark, left_type, right_type, value, how):
    left = spark.range(1000).selectExpr("id AS a", f"cast({value} AS {left_type}) AS k", "id % 3 AS b")
    right = spark.range(1).selectExpr(f"cast({value} AS {right_type}) AS k", "'x' AS c")
    got = spread_join(left, right, ["k"], how)
    assert got.columns == (["a", "k", "b"] if how in ("left_semi", "left_anti") else ["a", "k", "b", "c"])
    rows = got.collect()
    assert len(rows) == (0 if how == "left_anti" else 1000)
    assert how not in ("inner", "left") or all(r.c == "x" for r in rows)


def test_ids_of_another_type_and_lists_of_any_length(spark):
    from gaugeline.operators.evaluate import orphans
    from gaugeline.operators.tables import rows_with_ids

    df = spark.range(1000).selectExpr("id AS x", "cast(7 AS int) AS k")
    for n in (50, 150):
        kept = rows_with_ids(df, "k", [*range(n), None])
        assert kept.columns == ["x", "k"] and kept.count() == 1000
    assert rows_with_ids(df, "k", []).count() == 0
    assert orphans(df, spark.range(10).withColumnRenamed("id", "p"), "k", "p").count() == 0


def test_spread_rows_keeps_rows(spark):
    df = spark.range(100)
    assert spread_rows(df).rdd.getNumPartitions() == 4
    assert spread_rows(df).count() == 100


def test_global_position_numbers_all_rows(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).alias("v"), (F.col("id") % 3).alias("g"))
    rows = rk.global_position(df, [F.col("g").desc(), "v"], name="n", start=0).collect()
    want = {(r["g"], r["v"]): i for i, r in enumerate(sorted(df.collect(), key=lambda r: (-r["g"], r["v"])))}
    assert {(r["g"], r["v"]): r["n"] for r in rows} == want


def test_competition_rank_shares_places(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 1.0), ("d", None), ("e", 0.5)], "n string, v double")
    got = {r["n"]: r["rank"] for r in rk.competition_rank(df, "v", ["n"]).collect()}
    assert got == {"a": 1, "c": 1, "b": 3, "e": 3, "d": 5}


def test_latest_and_first_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, t int, v string")
    assert {(r.k, r.v) for r in rk.latest_per_key(df, ["k"], ["t"]).collect()} == {("a", "y"), ("b", "w")}
    assert {(r.k, r.v) for r in rk.first_per_key(df, ["k"], ["t"]).collect()} == {("a", "x"), ("b", "w")}


def test_top_per_group_limits_inside_tasks(spark):
    df = spark.range(0, 1000).withColumn("g", F.col("id") % 2)
    top = rk.top_per_group(df, ["g"], [F.col("id").desc()], 3)
    assert sorted(r.id for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_bands_and_labels(spark):
    df = spark.createDataFrame([(0.9, 1), (0.7, 42), (0.4, 9999), (0.39, 10000)], "v double, n int")
    got = df.select(rk.pass_rate_band(F.col("v")).alias("p"), rk.score_band(F.col("v")).alias("s"), rk.run_label(F.col("n")).alias("r")).collect()
    assert [r.p for r in got] == ["good", "fair", "poor", "poor"]
    assert [r.s for r in got] == ["strong", "strong", "medium", "weak"]
    assert [r.r for r in got] == ["RUN-0001", "RUN-0042", "RUN-9999", "RUN-10000"]


def test_checkpoint_folder_is_taken_from_the_context(spark):
    first = session.ensure_checkpoint_dir(spark)
    assert session.ensure_checkpoint_dir(spark) == first
    df = session.settle(spark.range(10))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_places_in_groups_of_any_size(spark):
    rows = [("hot", k % 500, k) for k in range(3000)] + [("b", 2, 9001), ("b", 1, 9002), ("c", 7, 9003)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(7)
    got = {r.id: (r.g, r.place) for r in rk.position_in_group(df, ["g"], ["o", "id"]).collect()}
    want = {}
    for g in ("hot", "b", "c"):
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[i] = (g, n)
    assert got == want
    assert rk.position_in_group(df.limit(0), ["g"], ["o"]).collect() == []
