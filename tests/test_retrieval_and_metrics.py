import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeline.plans import documents as dc
from gaugeline.plans import metrics as me
from gaugeline.plans import retrieval as rt

# ---- chunks ---------------------------------------------------------------------------


def test_chunks_of_known_texts():
    assert rt.split_text("", 10, 2) == []
    assert rt.split_text("short", 10, 2) == ["short"]
    assert rt.split_text("aaa\n\nbbb\n\nccc", 9, 0) == ["aaa\n\nbbb", "ccc"]
    assert rt.split_text("one two three four", 9, 4) == ["one two", "three", "four"]
    assert rt.split_text("a b c d e", 5, 2) == ["a b c", "c d", "d e"]
    assert rt.split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert rt.split_text("def a\n\nclass b" + "x" * 20, 10, 0, rt.CODE_SEPARATORS) == ["def a", "\nclass b" + "x" * 20]


def test_chunks_cover_the_text_and_keep_their_bounds():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bb", " ", "\n", "\n\n", "word "]) for _ in range(rng.randint(1, 400)))
        chunks = rt.split_text(text, 60, 10)
        assert all(0 < len(c) <= 60 for c in chunks)
        assert set("".join(text.split())) == set("".join("".join(chunks).split()))
        at = 0
        for c in chunks:
            found = text.find(c, max(0, at - 60))
            assert found >= 0
            at = found + len(c)


def test_chunk_jobs(spark):
    long = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame(
        [("r", "rule", long), ("s", "target_schema", long), ("c", "generated_code", "x\n" * 3000), ("e", "rule", "")], "doc_id string, type string, text string"
    )
    got = {}
    for r in rt.chunk_by_type(docs).collect():
        got.setdefault(r.doc_id, []).append(len(r.chunk))
    assert len(got["s"]) == 1 and len(got["r"]) > 2 and max(got["r"]) <= 600 and len(got["c"]) == 2 and max(got["c"]) <= 4000 and "e" not in got
    windows = rt.stride_windows(docs.filter("doc_id in ('r', 'e')"), "doc_id", "text").orderBy("chunk_no").collect()
    assert "".join([windows[0].chunk] + [w.chunk[80:] for w in windows[1:]]) == long


# ---- ranking --------------------------------------------------------------------------


def brute_bm25(docs, query):
    tokens = {i: t.split() for i, t in docs.items()}
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    terms = {t for ts in tokens.values() for t in ts}
    df = {t: sum(t in ts for ts in tokens.values()) for t in terms}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    scores = {}
    for i, ts in tokens.items():
        hit = [q for q in query.split() if q in ts]
        if hit:
            scores[i] = sum(idf[q] * ts.count(q) * 2.5 / (ts.count(q) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for q in hit)
    return scores


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(30)] + ["the"] * 30
    docs = {i: " ".join(rng.choices(vocabulary, k=rng.randint(1, 25))) for i in range(60)} | {99: "", 98: "  \n "}
    asked = {1: "t1 t2 the", 2: "t3 t3  t4", 3: "unseen", 4: ""}
    documents = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id int, question string")
    got = {(r.query_id, r.doc_id): r.score for r in rt.bm25_scores(documents, queries, "doc_id", "text", "query_id", "question").collect()}
    want = {(q, i): s for q, text in asked.items() for i, s in brute_bm25(docs, text).items()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    top = rt.bm25_topk(documents, queries, 3).filter("query_id = 1").orderBy("rank").collect()
    assert [r.doc_id for r in top] == [i for _, i in sorted((-round(s, 9), i) for (q, i), s in want.items() if q == 1)[:3]]


def test_types_are_filtered_before_anything_is_counted(spark):
    documents = spark.createDataFrame([(1, "a b", "rule"), (2, "a", "note"), (3, "a c c c", "rules_summary"), (4, "b b z", "note")], "doc_id int, text string, type string")
    asked = spark.createDataFrame([(7, "b", "rule_query"), (8, "a b", "general"), (9, "a", "code_query"), (10, "c", None)], "query_id int, question string, intent string")
    got = rt.intent_topk(documents, asked).collect()
    # No code documents occur: that intent reads all, like an unknown one.
    assert {(r.query_id, r.doc_id) for r in got} == {(7, 1), (8, 1), (8, 2), (8, 3), (8, 4), (9, 1), (9, 2), (9, 3), (10, 3)}
    readable = documents.filter("type in ('rule', 'rules_summary')")
    alone = rt.bm25_topk(readable, asked.filter("query_id = 7"), 6).collect()
    assert [tuple(r) for r in got if r.query_id == 7] == [tuple(r) for r in alone]


def test_names_are_found_wherever_they_stand(spark):
    rules = spark.createDataFrame([(1, "null check"), (2, "BalanceCheck"), (3, "ab"), (4, "Null Check"), (5, " ")], "rule_index int, rule_name string")
    asked = spark.createDataFrame([(1, 'Explain "null check" please'), (2, "explain BalanceCheck?"), (3, "xab"), (4, "nothing"), (5, ""), (6, "rule 9 null check")], "query_id int, question string")
    assert sorted(map(tuple, rt.named_rules(asked, rules).collect())) == [(1, 1), (2, 2), (3, 3), (6, 9)]


def test_vector_search_in_several_passes(spark, monkeypatch):
    rng = random.Random(2)
    vectors = [(i, [rng.random(), rng.random()]) for i in range(40)]
    docs = spark.createDataFrame(vectors, "doc_id int, v array<float>")
    queries = spark.createDataFrame([(100 + i, v) for i, v in vectors[:9]], "query_id int, vector array<float>")
    one = {tuple(r) for r in rt.vector_topk(docs, queries, 3, "doc_id", "v").collect()}
    monkeypatch.setattr(rt, "QUERIES_PER_PASS", 2)
    assert {tuple(r) for r in rt.vector_topk(docs, queries, 3, "doc_id", "v").collect()} == one
    assert len(one) == 27 and all((100 + i, i, 1, 0.0) in one for i in range(9))


def test_fusion_merges_equal_texts(spark):
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc_id string, rank int")
    second = spark.createDataFrame([(1, "a2", 1), (1, "c", 2)], "query_id int, doc_id string, rank int")
    texts = spark.createDataFrame([("a", "same"), ("a2", "same"), ("b", "x"), ("c", "y")], "doc_id string, text string")
    got = [(r.doc_id, r.rank, r.score) for r in rt.fuse([(first, 0.5), (second, 0.5)], texts).orderBy("rank").collect()]
    assert got == [("a", 1, round(1 / 61, 9)), ("b", 2, round(0.5 / 62, 9)), ("c", 3, round(0.5 / 62, 9))]
    assert rt.fuse([(first, 0.5), (second, 0.5)], None, keep=3).count() == 3


def test_intents_choose_types_and_depth(spark):
    asked = spark.createDataFrame([(1, "rule_query"), (2, "code_query"), (3, "general"), (4, "mapping_query")], "query_id int, intent string")
    docs = spark.createDataFrame([("a", "rule"), ("b", "execution_results")], "doc_id string, type string")
    got = sorted((sorted(i), t, k) for i, t, k in rt.intent_groups(docs, asked))
    assert got == [(["code_query"], None, 8), (["general"], None, 6), (["mapping_query"], ["rule"], 20), (["rule_query"], ["rule"], 6)]


def test_lookups_and_forced_documents(spark):
    rules = spark.createDataFrame([(1, "Null Check"), (2, "Net Return Range"), (3, "Cost $5\\x")], "rule_index int, rule_name string")
    docs = spark.createDataFrame([("d1", "rule", 2), ("d2", "generated_code", 2), ("d3", "generated_code_summary", None), ("d4", "entity_mappings_hop1", None)], "doc_id string, type string, rule_number int")
    asked = spark.createDataFrame([
        (1, "what does rule 2 do", "rule_query"), (2, "show the net return range please", "code_query"), (3, "rule 9", "rule_query"), (4, "every mapping", "mapping_query"),
        (5, "compare rule #3, the first rule and rule 77", "general"),
    ], "query_id int, question string, intent string")
    assert sorted((r.query_id, r.doc_id) for r in rt.direct_lookup(asked, rules, docs).collect()) == [(1, "d1"), (2, "d2")]
    assert sorted((r.query_id, r.doc_id) for r in rt.forced_documents(asked, docs).collect()) == [(2, "d3"), (4, "d4")]
    told = {r.query_id: r.resolved for r in rt.resolved_references(asked, rules).collect()}
    assert told[1] == "what does rule 2 (Net Return Range) do" and told[3] == "rule 9"
    assert told[5] == "compare rule 3 (Cost $5\\x), the rule 1 (Null Check) and rule 77"


def test_recent_turns_stay_in_their_conversation(spark):
    turns = spark.createDataFrame([(c, t, "user" if t % 2 else "bot", f"text {c} {t}") for c in (1, 2) for t in range(0, 12, 2)], "conv_id int, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.context for r in rt.recent_turns(turns, 2, 6).collect()}
    assert got[(1, 0)] == "" and got[(2, 0)] == "" and got[(1, 2)] == "BOT: text 1"
    assert got[(2, 10)] == "BOT: text 2\nBOT: text 2" and len(got) == 12


def test_context_and_sources(spark):
    ranked = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "c", 9)], "query_id int, doc_id string, rank int")
    docs = spark.createDataFrame([("a", "A" * 150, "r", None, "rule"), ("b", "B", "r", None, "rule"), ("c", "C", None, None, "note")], "doc_id string, text string, rule_name string, table_name string, type string")
    assert rt.pack_context(ranked, docs).first().context == "B\n\n---\n\n" + "A" * 150
    assert sorted((r.key, r.snippet) for r in rt.distinct_sources(ranked, docs).collect()) == [("note", "C…"), ("r", "B…")]


# ---- run and remediation logs ------------------------------------------------------------

T1, T2 = datetime(2025, 1, 1, 10), datetime(2025, 1, 2, 10)


@pytest.fixture(scope="module")
def runs(spark):
    rows = [("a", 8, 2, T1, None), ("a", 9, 1, T2, None), ("b", 0, 0, T1, "raised"), ("c", 5, 5, T2, None), ("d", 5, 5, T2, None)]
    return spark.createDataFrame(rows, "rule_name string, passed_count long, failed_count long, ts timestamp_ntz, error string")


def test_run_log_and_averages(spark, runs):
    row = me.average_pass_rate(runs).first()
    assert (row.rules_executed, row.avg_pass_rate) == (4, round((0.9 + 0 + 0.5 + 0.5) / 4, 4))
    rules = spark.createDataFrame([("b", 1), ("a", 2), ("never", 3)], "rule_name string, n int").withColumns({"category": F.lit("x"), "complexity": F.lit("y")})
    log = {r.rule_name: r for r in me.run_log(me.indexed_rules(rules, "n"), runs, spark.createDataFrame([("a", "range", "id")], "rule_name string, check_type string, id_column string")).collect()}
    assert set(log) == {"a", "b"} and log["a"].rule_index == 2 and log["a"].has_code and not log["b"].has_code and log["a"].failed_count == 1


def test_run_questions(runs):
    assert [(r.run_id, r.rule_name) for r in me.run_history(runs).orderBy("run_id").collect()] == [("RUN-0001", "a"), ("RUN-0002", "a"), ("RUN-0003", "c"), ("RUN-0004", "d")]
    assert me.most_recent_run(runs).first().rule_name == "a"
    assert me.runs_between(runs, after=F.lit(T1)).count() == 3 and me.runs_between(runs, before=F.lit(T2)).count() == 2
    assert me.runs_on(runs, F.lit("2025-01-02")).count() == 3
    latest = me.latest_runs(runs)
    extreme = me.extreme_rules(latest).first()
    assert (extreme.most_failures, extreme.failed_count, extreme.worst_rate, extreme.pass_rate) == ("c", 5, "b", 0.0)
    assert {r.rule_name: r["rank"] for r in me.ranked_rules(latest).collect()} == {"a": 1, "c": 2, "d": 2, "b": 4}
    assert me.failed_total(latest).first().total_failed == 11
    diff = me.rule_difference(latest, "c", "a").first()
    assert (diff.failed_difference, round(diff.rate_difference, 6), diff.n_rules) == (4, -0.4, 2)


def test_empty_logs(spark, runs):
    none = runs.filter("false")
    assert tuple(me.average_pass_rate(none).first()) == (0, 0.0)
    log = spark.createDataFrame([], "rule_name string, rows_affected long, n_ids long, ts timestamp")
    assert tuple(me.remediation_totals(log).first()) == (0, 0, 0)
    assert "No remediation" in dc.remediation_summary(log).first().text
    assert "No check" in dc.check_summary(spark.createDataFrame([], "rule_name string, check_type string")).first().text


# ---- documents ------------------------------------------------------------------------


def test_documents_of_a_small_session(spark, runs):
    rules = spark.createDataFrame([(1, 1, "First", "must hold", "validity", "simple"), (2, 2, "Second", "t", "validity", "simple")], "rule_id int, rule_index int, rule_name string, text string, category string, complexity string")
    entities = spark.createDataFrame([(1, 1, "Net"), (1, 2, "Gross"), (2, 1, "Lost")], "rule_id int, pos int, entity string")
    mapping = spark.createDataFrame([("Net", "net", 1), ("Gross", "gross", 2)], "entity string, schema_col string, map_pos int")
    hops = spark.createDataFrame([("net", "n1"), ("gross", "gross")], "schema_col string, dataset_col string")
    text = {r.rule_number: r.text for r in dc.rule_documents(rules, entities, mapping).collect()}
    assert "Entities: Net = net, Gross = gross" in text[1] and "not yet mapped" in text[2]
    maps = dc.mapping_documents(rules, entities, mapping, hops).collect()
    assert [r.text for r in maps] == ["Mappings of rule 1: First\nNet -> net -> n1\nGross -> gross"]
    kinds = {r.type: r.text for r in dc.mapping_summaries(rules, entities, mapping, hops).collect()}
    assert kinds["entity_mappings_hop2"].endswith("net -> n1") and "Rule 1 (First): Net -> net, Gross -> gross" in kinds["entity_mappings_hop1"]
    same = dc.mapping_summaries(rules, entities, mapping, hops.filter("dataset_col = schema_col")).filter("type = 'entity_mappings_hop2'").collect()
    assert len(same) == 1 and "nothing is renamed" in same[0].text
    assert "No mappings" in dc.mapping_documents(rules, entities, mapping.filter("false"), hops).first().text
    many = spark.range(1, 121).select(F.col("id").alias("rule_index"), F.col("id").cast("string").alias("rule_name"), F.lit("c").alias("category"))
    assert [len(r.text.split("\n")) for r in dc.rule_summaries(many).orderBy("batch").collect()] == [51, 51, 21]


# ---- bounds, statistics and vectors ---------------------------------------------------


def test_top_documents_by_bounds_are_those_of_full_scores(spark, monkeypatch):
    from gaugeline.plans import bm25

    rng = random.Random(5)
    rare = [f"r{i}" for i in range(60)]
    common = ["the", "of", "and", "to"]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(1, 20)) + rng.choices(rare, k=rng.randint(0, 4)))) for i in range(200)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(20)] + [(2000, ""), (2001, None)]
    asked = [(1, "the of and to"), (2, "r1 r2 the of"), (3, "r3"), (4, "r4 r4 r5 r6 and"), (5, "unseen the"), (6, ""), (7, "r7 r8 r9 r10 r11 the of and to")]
    documents = spark.createDataFrame(docs, "doc_id int, text string")
    queries = spark.createDataFrame(asked, "query_id int, question string")
    full = rt.bm25_scores(documents, queries, "doc_id", "text", "query_id", "question").collect()
    for k in (1, 3, 10):
        want = set()
        for q, _ in asked:
            own = sorted((-round(r.score, 9), r.doc_id) for r in full if r.query_id == q)
            want |= {(q, d, rank) for rank, (_, d) in enumerate(own[:k], 1)}
        for share in (0.0, 0.02, 0.2, 1.0):
            monkeypatch.setattr(bm25, "COMMON_SHARE", share)
            assert {(r.query_id, r.doc_id, r["rank"]) for r in rt.bm25_topk(documents, queries, k).collect()} == want, (k, share)


def test_common_words_bring_in_no_documents(spark, monkeypatch):
    """A question with rare words: no row for each of the documents that only share a stop word."""
    from gaugeline.plans import bm25

    docs = [(i, "the of and " + " ".join(f"w{i}_{j}" for j in range(3))) for i in range(300)] + [(500 + i, "needle pin thorn the of " + "x " * i) for i in range(5)]
    documents = spark.createDataFrame(docs, "doc_id int, text string")
    asked = bm25.asked_terms(spark.createDataFrame([(1, "needle pin thorn of the and")], "query_id int, question string"), "query_id", "question")
    asked = asked.withColumn("grp", F.lit(0)).withColumn("depth", F.lit(3))
    found = bm25.postings(documents, asked, "doc_id", "text").withColumn("grp", F.lit(0))
    weights = bm25.group_weights(bm25.corpus_statistics(documents, "text").withColumn("grp", F.lit(0)), asked)
    assert found.count() == 300 * 3 + 25
    summed = []
    own = bm25.summed
    monkeypatch.setattr(bm25, "summed", lambda *a: summed.append(own(*a)) or summed[-1])
    top = bm25.best_documents(found, weights, asked, 3, "doc_id", "query_id")
    assert [r.doc_id for r in top.orderBy("rank").collect()] == [500, 501, 502]
    assert [df.count() for df in summed] == [5, 0]


def test_negative_weights_are_scored_in_full(spark):
    """Every word is in most documents: the floor of the weights is below zero."""
    docs = [(i, "a b" + (" c" if i % 3 else "") + (" d" if i == 7 else "")) for i in range(12)]
    documents = spark.createDataFrame(docs, "doc_id int, text string")
    queries = spark.createDataFrame([(1, "a b c d"), (2, "c"), (3, "a a")], "query_id int, question string")
    full = rt.bm25_scores(documents, queries, "doc_id", "text", "query_id", "question").collect()
    assert min(r.score for r in full) < 0
    got = {(r.query_id, r.doc_id, r["rank"]) for r in rt.bm25_topk(documents, queries, 4).collect()}
    want = set()
    for q in (1, 2, 3):
        own = sorted((-round(r.score, 9), r.doc_id) for r in full if r.query_id == q)
        want |= {(q, d, rank) for rank, (_, d) in enumerate(own[:4], 1)}
    assert got == want


def test_intents_without_questions_or_documents(spark):
    documents = spark.createDataFrame([(1, "a b", "rule"), (2, "a", None)], "doc_id int, text string, type string")
    asked = spark.createDataFrame([(7, "b", "rule_query"), (8, "a", "general")], "query_id int, question string, intent string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id int, vector array<double>")
    question_vectors = spark.createDataFrame([(7, [1.0])], "query_id int, vector array<double>")
    for docs, questions in ((documents, asked.limit(0)), (documents.limit(0), asked), (documents.limit(0), asked.limit(0))):
        top = rt.intent_topk(docs, questions)
        assert top.columns == ["query_id", "doc_id", "score", "rank"] and top.collect() == []
        assert rt.intent_retrieval(docs, questions, vectors.limit(0), question_vectors).collect() == []
    assert {(r.query_id, r.doc_id) for r in rt.intent_topk(documents, asked).collect()} == {(7, 1), (8, 1), (8, 2)}
    assert {(r.query_id, r.doc_id) for r in rt.intent_retrieval(documents, asked, vectors, question_vectors).collect()} == {(7, 1), (8, 1), (8, 2)}


def test_types_are_read_twice_whatever_the_number_of_intents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rt, "postings", lambda *a, _own=rt.postings: seen.append("postings") or _own(*a))
    monkeypatch.setattr(rt, "corpus_statistics", lambda *a, _own=rt.corpus_statistics: seen.append("statistics") or _own(*a))
    documents = spark.createDataFrame([(i, f"a b w{i}", t) for i, t in enumerate(["rule", "entity_mappings", "target_schema", "generated_code", None])], "doc_id int, text string, type string")
    asked = spark.createDataFrame([(k, "a b", i) for k, i in enumerate(["rule_query", "mapping_query", "schema_query", "code_query", "general"])], "query_id int, question string, intent string")
    assert rt.intent_topk(documents, asked).count() == 1 + 2 + 1 + 1 + 5
    assert sorted(seen) == ["postings", "statistics"]


def test_vectors_of_unequal_lengths_have_no_distance(spark):
    docs = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, None), (6, []), (7, [float("inf"), 1.0]), (None, [1.0, 2.0]), (8, [4.0])],
        "doc_id int, v array<double>",
    )
    queries = spark.createDataFrame([(100 + i, [0.0, float(i)]) for i in range(20)] + [(200, [3.0]), (201, None), (202, [None]), (203, [])], "query_id int, vector array<double>")
    got = sorted((r.query_id, r.doc_id, r["rank"]) for r in rt.vector_topk(docs.coalesce(1), queries, 2, "doc_id", "v").collect())
    assert got == [(100 + i, 1, 1) for i in range(20)] + [(200, 2, 2), (200, 8, 1)]
    assert rt.vector_topk(docs, queries.limit(0), 2, "doc_id", "v").collect() == []
    assert rt.vector_topk(docs.limit(0), queries, 2, "doc_id", "v").collect() == []


def test_equal_vectors_send_k_rows_per_question_and_task():
    import numpy as np
    import pyarrow as pa

    from gaugeline.operators import nearest_rows as nr

    class Shared:
        value = (pa.array(np.arange(20)), nr.by_length(pa.array([[0.0, 0.0]] * 20)))

    ids = np.random.default_rng(1).permutation(20_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 10_000]), pa.array([[1.0, 1.0]] * 10_000)], ["d", "v"]) for a in (0, 10_000)]
    rows = list(nr.nearest_of(Shared, 5, "l2")(iter(batches)))
    assert sum(b.num_rows for b in rows) == 100
    assert {(q, d) for b in rows for q, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)} == {(q, d) for q in range(20) for d in range(5)}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_tiles_against_brute_force(spark, monkeypatch, metric):
    from gaugeline.operators import nearest_rows as nr

    rng = random.Random(9)
    monkeypatch.setattr(nr, "TILE_ROWS", 7)
    monkeypatch.setattr(nr, "TILE_QUESTIONS", 3)
    vectors = [(f"d{rng.randrange(10**6)}ß" if i % 3 else f"Z{i}", [float(rng.randrange(4)) for _ in range(3)]) for i in range(80)]
    docs = spark.createDataFrame(vectors, "doc_id string, v array<double>")
    asked = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(10)]
    got = {(r.query_id, r["rank"]): (r.doc_id, r.distance) for r in rt.vector_topk(docs, spark.createDataFrame(asked, "query_id int, vector array<double>"), 6, "doc_id", "v", metric=metric).collect()}

    def distance(a, b):
        if metric == "l2":
            return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return -sum(x * y for x, y in zip(a, b, strict=True)) / norms if norms else 0.0

    for q, v in asked:
        want = sorted((round(distance(w, v), 9), i.encode()) for i, w in vectors)[:6]
        assert [(got[q, r][1], got[q, r][0].encode()) for r in range(1, 7)] == [(pytest.approx(x, abs=1e-9), i) for x, i in want]


# ---- contexts -------------------------------------------------------------------------


def context_of(spark, documents, questions, ranked, looked_up=()):
    docs = spark.createDataFrame(documents, "doc_id string, type string, text string")
    asked = spark.createDataFrame(questions, "query_id int, intent string, question string")
    ranks = spark.createDataFrame(ranked, "query_id int, doc_id string, rank int")
    found = spark.createDataFrame(list(looked_up), "query_id int, doc_id string")
    placed = rt.context_documents(asked, docs, ranks, found)
    rows = {}
    for r in sorted(placed.collect(), key=lambda r: (r.query_id, r.place)):
        rows.setdefault(r.query_id, []).append(r.doc_id)
    return rows, {r.query_id: r.context for r in rt.context_answers(asked, docs, placed).collect()}


DOCS = [
    ("r1", "rule", "one"), ("r2", "rule", "two"), ("r3", "rule", "two"), ("c1", "generated_code", "code one"), ("c2", "generated_code", "code two"),
    ("generated_code_summary//1", "generated_code_summary", "summary of code"), ("entity_mappings_hop2//1", "entity_mappings_hop2", "hop two"),
    *[(f"entity_mappings_summary//{k}", "entity_mappings_summary", f"part {k}") for k in (1, 2, 10)], ("entity_mappings_hop1//1", "entity_mappings_hop1", "part 1"),
]


def test_one_source_answers_a_question(spark):
    questions = [(1, "mapping_query", "show all mappings"), (2, "mapping_query", "mapping of x"), (3, "rule_query", "rule 1"), (4, "general", "?"), (5, "general", "none"), (6, "mapping_query", None)]
    ranked = [(q, d, k) for q in (1, 2, 3, 4) for k, d in enumerate(["r2", "r3", "r1"], 1)]
    rows, texts = context_of(spark, DOCS, questions, ranked, [(1, "r1"), (3, "r1"), (3, "r1")])
    # Forced before looked up before ranked; equal texts once; parts in the order of their numbers.
    assert rows[1] == ["entity_mappings_summary//1", "entity_mappings_summary//2", "entity_mappings_summary//10", "entity_mappings_hop2//1"]
    assert rows[2] == ["r2", "r1"] and rows[3] == ["r1"] and rows[4] == ["r2", "r1"] and 5 not in rows
    assert texts[4] == "two\n\n---\n\none" and texts[5] == texts[6] == rt.NO_DOCUMENTS


def test_code_questions_get_the_summary(spark):
    questions = [(1, "code_query", "code"), (2, "code_query", "code"), (3, "code_query", "code")]
    ranked = [(1, "r1", 1), (1, "c2", 2), (1, "c1", 3), (2, "r1", 1), (2, "r2", 2)]
    rows, _ = context_of(spark, DOCS, questions, ranked)
    assert rows == {1: ["c2", "c1", "generated_code_summary//1"], 2: ["generated_code_summary//1", "r1", "r2"], 3: ["generated_code_summary//1"]}
    rows, _ = context_of(spark, DOCS, questions, ranked, [(1, "c1")])
    assert rows[1] == ["c1", "generated_code_summary//1"]


def test_without_code_nothing_is_looked_at(spark):
    documents = [("generated_code_summary//1", "generated_code_summary", "No PySpark code has been generated yet."), ("r1", "rule", "one")]
    rows, texts = context_of(spark, documents, [(1, "code_query", "code"), (2, "general", "x")], [(1, "r1", 1), (2, "r1", 1)])
    assert rows == {2: ["r1"]} and texts == {1: rt.NO_CODE_ANSWER, 2: "one"}


def test_no_more_than_five_documents(spark):
    documents = [(f"d{k}", "rule", f"text {k}") for k in range(9)] + [("generated_code_summary//1", "generated_code_summary", "s")]
    rows, _ = context_of(spark, documents, [(1, "general", "x"), (2, "code_query", "x")], [(q, f"d{k}", k + 1) for q in (1, 2) for k in range(9)])
    assert rows[1] == [f"d{k}" for k in range(5)] and rows[2] == ["generated_code_summary//1", "d0", "d1", "d2", "d3"]
    assert context_of(spark, [], [], [])[0] == {}


def test_own_summary_says_that_there_is_no_code(spark):
    summary = dc.check_summary(spark.createDataFrame([], "rule_name string, check_type string"))
    asked = spark.createDataFrame([(1, "code_query", "code")], "query_id int, intent string, question string")
    assert [tuple(r) for r in rt.without_code(asked, summary).collect()] == [(1, rt.NO_CODE_ANSWER)]


def test_chunks_are_ranked_as_documents(spark):
    documents = spark.createDataFrame([(1, "a b c d"), (2, "x y z w"), (3, "a a x q"), (4, "")], "doc_id int, text string")
    chunks = rt.chunk_documents(documents, "doc_id", "text", 4, 0)
    held = {(r.doc_id, r.chunk_no): r.chunk for r in chunks.collect()}
    asked = spark.createDataFrame([(1, "a x"), (2, "q"), (3, "none"), (4, "d d")], "query_id int, question string")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.chunk_no, r.score) for r in rt.rank_chunks(chunks, asked, 3).collect()}
    for q, text in ((1, "a x"), (2, "q"), (4, "d d")):
        scores = brute_bm25(held, text)
        want = sorted((-round(s, 9), key) for key, s in scores.items())[:3]
        assert [got[q, k] for k in range(1, len(want) + 1)] == [(*key, pytest.approx(-s, abs=1e-9)) for s, key in want]
    assert not [k for k in got if k[0] == 3]
    best = rt.best_chunk_documents(rt.rank_chunks(chunks, asked, 3), 2).collect()
    assert all(len({r.doc_id for r in best if r.query_id == q}) == sum(r.query_id == q for r in best) <= 2 for q in (1, 2, 4))
