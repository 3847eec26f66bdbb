import pytest

from gaugeline.operators import matching as mt

FUZZY = {"llm": 0, "cosine": 0, "fuzzy": 100}


@pytest.fixture(scope="module")
def columns(spark):
    return spark.createDataFrame([("t", 1, "acct_number"), ("t", 2, "perf_date"), ("t", 3, "net_return"), ("t", 4, "net_return"), ("u", 1, "other")], "scope string, position int, column string")


def test_ranking_keeps_column_order_on_ties(spark, columns):
    entities = spark.createDataFrame([("t", "Net Return"), ("t", "Net Return"), ("t", "qqq"), ("t", ""), ("nowhere", "x")], "scope string, entity string")
    ranked = {r.entity: [(c.column, round(c.score, 3)) for c in r.ranked] for r in mt.ranked_candidates(entities, mt.pools(columns), None, FUZZY).collect()}
    assert set(ranked) == {"Net Return", "qqq"}
    assert ranked["Net Return"][0] == ("net_return", 1.0) and len(ranked["Net Return"]) == 3
    assert [c for c, _ in ranked["qqq"]] == ["acct_number", "perf_date", "net_return"]


def test_external_scores_sparse_and_dense(spark, columns):
    entities = spark.createDataFrame([("t", "thing")], "scope string, entity string")
    only_external = {"llm": 100, "cosine": 0, "fuzzy": 0}
    sparse = spark.createDataFrame([("t", "thing", 2, 0.9), ("t", "thing", 77, 0.99)], "scope string, entity string, index int, score double")
    best = mt.best_columns(mt.ranked_candidates(entities, mt.pools(columns), sparse, only_external)).first()
    assert (best.column, best.score) == ("net_return", 0.9)
    dense = mt.dense_scores(spark.createDataFrame([("t", "thing", [0.1, 0.8])], "scope string, entity string, scores array<double>"))
    best = mt.best_columns(mt.ranked_candidates(entities, mt.pools(columns), dense, only_external)).first()
    assert (best.column, best.score) == ("perf_date", 0.8)


def test_vectors_take_part(spark):
    columns = spark.createDataFrame([("t", 1, "aaa", [1.0, 0.0]), ("t", 2, "bbb", [0.0, 1.0])], "scope string, position int, column string, vector array<float>")
    entities = spark.createDataFrame([("t", "zzz", [0.0, 2.0])], "scope string, entity string, vector array<float>")
    best = mt.best_columns(mt.ranked_candidates(entities, mt.pools(columns), None)).first()
    assert best.column == "bbb" and best.score == pytest.approx(0.3)


def test_short_list(spark, columns):
    entities = spark.createDataFrame([("t", "net return")], "scope string, entity string")
    ranked = mt.ranked_candidates(entities, mt.pools(columns), None, FUZZY)
    allowed = spark.createDataFrame([("t", "perf_date"), ("t", "net_return")], "scope string, column string")
    assert [r.column for r in mt.short_list(ranked, allowed).orderBy("rank").collect()] == ["net_return", "perf_date"]
    assert mt.short_list(ranked, None, 2).count() == 2


def test_two_hops_drop_what_has_no_second_hop(spark):
    first = spark.createDataFrame([("t", "e1", "s1", 1.0), ("t", "e2", "s2", 1.0)], "scope string, entity string, column string, score double")
    second = spark.createDataFrame([("t", "s1", "d1", 0.5)], "scope string, entity string, column string, score double")
    assert [(r.entity, r.schema_col, r.dataset_col) for r in mt.two_hops(first, second).collect()] == [("e1", "s1", "d1")]


def test_scoped_second_hop(spark):
    entities = spark.createDataFrame([(1, "perf date"), (2, "perf date"), (1, "net return")], "rule_id int, entity string")
    schema = spark.createDataFrame([(1, "performance_date"), (2, "net_return")], "position int, column string")
    declared = spark.createDataFrame([("net_return", "A"), ("performance_date", "missing")], "column string, table_name string")
    dataset = spark.createDataFrame([("A", 1, "netret"), ("A", 2, "perf_dt"), ("B", 1, "date_of_performance")], "scope string, position int, column string")
    own = spark.createDataFrame([(1, "B"), (2, "A")], "rule_id int, table_name string")
    got = sorted((r.rule_id, r.entity, r.table_name, r.dataset_col) for r in mt.resolve_scoped(entities, schema, declared, dataset, own, FUZZY).collect())
    assert got == [(1, "net return", "A", "netret"), (1, "perf date", "B", "date_of_performance"), (2, "perf date", "A", "perf_dt")]


def test_edits_and_fills(spark):
    edits = mt.zip_edits(spark.createDataFrame([(["a", "b", "c"], ["x", "y"])], "entities array<string>, columns array<string>"))
    current = spark.createDataFrame([("a", "old"), ("z", "keep")], "entity string, column string")
    assert {r.entity: r.column for r in mt.override_mapping(current, edits).collect()} == {"a": "x", "b": "y", "z": "keep"}
    mapped = spark.createDataFrame([("s1", "d1")], "schema_col string, dataset_col string")
    wanted = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "schema_col string")
    matches = spark.createDataFrame([("s2", "d2")], "schema_col string, dataset_col string")
    assert {r.schema_col: r.dataset_col for r in mt.fill_unmapped(wanted, mapped, matches).collect()} == {"s1": "d1", "s2": "d2", "s3": "s3"}
    s2d = spark.createDataFrame([("s1", "d"), ("s2", None), ("s3", "")], "schema_col string, dataset_col string")
    assert [r.column for r in mt.choosable_columns(s2d, None).collect()] == ["s1"]
    asked = spark.createDataFrame([("a",), ("b",)], "entity string")
    found = spark.createDataFrame([("a", "c1")], "entity string, column string")
    assert {r.entity: r.column for r in mt.suggested_columns(asked, found).collect()} == {"a": "c1", "b": ""}


def test_entities_are_the_longest_phrases_in_the_texts_wording(spark):
    texts = spark.createDataFrame([(1, "Performance Date must be before Period End Date"), (2, "the Net_Return, the net"), (3, "")], "id int, t string")
    columns = spark.createDataFrame([(1, "period_end_date"), (2, "end_date"), (3, "performance_date"), (4, "net_return"), (5, "the")], "position int, column string")
    got = sorted((r.id, r.start, r.phrase, r.column) for r in mt.extract_entities(texts, "id", "t", columns).collect())
    assert got == [(1, 1, "Performance Date", "performance_date"), (1, 6, "Period End Date", "period_end_date"), (2, 1, "the", "the"), (2, 2, "Net_Return,", "net_return"), (2, 3, "the", "the"), (2, 4, "net", "net_return")]
    loose = {(r.id, r.column) for r in mt.extract_entities(texts, "id", "t", columns.filter("position = 3"), threshold=0.9).collect()}
    assert (1, "performance_date") in loose
    balance = spark.createDataFrame([(1, "closing_balance")], "position int, column string")
    said = spark.createDataFrame([(1, "check balance value")], "id int, t string")
    both = [[(r.phrase, r.column, r.score) for r in mt.extract_entities(said, "id", "t", balance, threshold=t).collect()] for t in (0.99, 1.0)]
    assert both == [[("balance", "closing_balance", 1.0)]] * 2


def test_rules_search_the_columns_of_their_tables(spark):
    columns = spark.createDataFrame(
        [("t1", 1, "acct_number"), ("t1", 2, "balance"), ("t2", 3, "amount"), ("t2", 4, "balance"), ("t3", 5, "perf_date")], "table_name string, position int, column string"
    )
    entities = spark.createDataFrame(
        [(1, "balance"), (1, "perf date"), (2, "amount"), (3, "perf date"), (4, "amount"), (4, "amount"), (5, "balance"), (5, ""), (5, None)], "rule_id int, entity string"
    )
    # 1: two tables; 2: the same two in another order; 3: an unknown table; 4: none; 5: a known and an unknown one.
    given = spark.createDataFrame([(1, "t1"), (1, "t2"), (2, "t2"), (2, "t1"), (3, "ghost"), (5, "t2"), (5, "ghost"), (1, "t1")], "rule_id int, table_name string")
    scopes = {r.rule_id: r.scope for r in mt.rule_scopes(entities, given, columns).collect()}
    assert scopes == {1: '["t1","t2"]', 2: '["t1","t2"]', 3: "*", 4: "*", 5: '["t2"]'}
    pool = {r.scope: [c.column for c in r.pool] for r in mt.pools(mt.scope_columns(mt.rule_scopes(entities, given, columns), columns)).collect()}
    assert pool == {'["t1","t2"]': ["acct_number", "balance", "amount"], "*": ["acct_number", "balance", "amount", "perf_date"], '["t2"]': ["amount", "balance"]}
    got = sorted((r.rule_id, r.entity, r.column, r.score == 1) for r in mt.resolve_for_rules(entities, given, columns, None, FUZZY).collect())
    assert [g[:2] for g in got] == [(1, "balance"), (1, "perf date"), (2, "amount"), (3, "perf date"), (4, "amount"), (5, "balance")]
    assert [g[2] for g in got if g[3]] == ["balance", "amount", "perf_date", "amount", "balance"]
    assert mt.resolve_for_rules(entities.limit(0), given, columns, None, FUZZY).collect() == []


def test_table_names_that_look_like_lists_are_kept_apart(spark):
    columns = spark.createDataFrame([('a","b', 1, "x"), ("a", 2, "y"), ("b", 3, "z"), ("*", 4, "w")], "table_name string, position int, column string")
    given = spark.createDataFrame([(1, 'a","b'), (2, "a"), (2, "b"), (3, "*")], "rule_id int, table_name string")
    scopes = {r.rule_id: r.scope for r in mt.rule_scopes(given, given, columns).collect()}
    assert len(set(scopes.values())) == 3 and mt.ALL_TABLES not in scopes.values()


def test_scoped_second_hop_falls_back_to_all_tables(spark):
    entities = spark.createDataFrame([(1, "balance"), (2, "amount"), (3, "amount")], "rule_id int, entity string")
    schema = spark.createDataFrame([(1, "balance"), (2, "amount")], "position int, column string")
    declared = spark.createDataFrame([], "column string, table_name string")
    dataset = spark.createDataFrame([("t1", 1, "balance_eur"), ("t2", 2, "amount_eur")], "scope string, position int, column string")
    own = spark.createDataFrame([(1, "t1"), (2, "ghost")], "rule_id int, table_name string")
    got = sorted(tuple(r) for r in mt.resolve_scoped(entities, schema, declared, dataset, own, FUZZY).collect())
    assert got == [(1, "balance", "balance", "t1", "balance_eur"), (2, "amount", "amount", None, "amount_eur"), (3, "amount", "amount", None, "amount_eur")]


def test_entities_are_scored_once_per_table_not_once_per_set_of_tables(spark, monkeypatch):
    from itertools import combinations

    names = [f"t{i}" for i in range(8)]
    # One name in many tables, equal names in several tables, and names that are equally near.
    rows = [(t, 10 * i, "net_return") for i, t in enumerate(names[::-1])] + [(t, 100 + i, f"col_{i % 3}") for i, t in enumerate(names)] + [("t2", 3, "aa"), ("t5", 3, "ab"), ("*", 1, "zz")]
    columns = spark.createDataFrame(rows, "table_name string, position int, column string")
    sets = [c for n in (1, 2, 3) for c in combinations(names, n)]
    given = spark.createDataFrame([(r, t) for r, s in enumerate(sets) for t in s] + [(500, "*"), (501, "ghost"), (None, "t1")], "rule_id int, table_name string")
    said = ["net return", "col", "a", "xyz", "col_2"]
    entities = spark.createDataFrame([(r, e) for r in [*range(len(sets)), 500, 501, 502, None] for e in said] + [(1, "col"), (2, ""), (3, None)], "rule_id int, entity string")
    # By scope, as where external scores come in.
    scopes = mt.rule_scopes(entities, given, columns)
    placed = entities.join(scopes.select("rule_id", "scope"), "rule_id")
    best = mt.best_columns(mt.ranked_candidates(placed.drop("rule_id"), mt.pools(mt.scope_columns(scopes, columns)), None, FUZZY))
    want = {tuple(r) for r in placed.distinct().join(best, ["scope", "entity"]).select("rule_id", "entity", "scope", "column", "score").collect()}
    scored = []
    monkeypatch.setattr(mt, "ranked_candidates", lambda e, *a, _own=mt.ranked_candidates: scored.append(e) or _own(e, *a))
    got = mt.resolve_for_rules(entities, given, columns, None, FUZZY).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) == len(said) * (len(sets) + 3)
    assert sum(df.select("scope", "entity").distinct().count() for df in scored) == len(said) * (len(names) + 2)
