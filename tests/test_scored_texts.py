import random

from pyspark.sql import functions as F

from gaugeline.operators import scored_texts as st
from gaugeline.plans import bm25
from gaugeline.plans import retrieval as rt

ASKED = [(1, "the of w1 w1", "rule_query"), (2, "the w2", "mapping_query"), (3, "of the w3", "general"), (4, "unseen", "general"), (5, "", "rule_query")]


def test_a_task_sends_the_best_of_each_question_only(spark, monkeypatch):
    """Nearly all documents share a word with each question: no row of a question and a document is shuffled for them."""
    documents = spark.createDataFrame([(i, f"the of w{i % 5}" + " x" * (i % 9), "rule") for i in range(600)], "doc_id int, text string, type string").repartition(3)
    asked = spark.createDataFrame(ASKED[:3], "query_id int, question string, intent string")
    ranked = []
    for module in (rt, bm25):
        monkeypatch.setattr(module, "top_per_group", lambda df, *a, _own=module.top_per_group: ranked.append(df) or _own(df, *a))
    assert rt.intent_topk(documents, asked).count() == 6 + 20 + 6
    assert max(df.count() for df in ranked) <= 3 * 3 * 20


def test_ranks_are_those_of_full_scores(spark, monkeypatch):
    """Repeated and missing ids, equal texts, missing texts and types; in one pass and in several, in small tiles."""
    rng = random.Random(4)
    words = ["the", "of", "w1", "w2", "w3", "x", "y"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)]
    rows = [(i if i % 10 else None, texts[i % 50], rng.choice(["rule", "entity_mappings", "note", None])) for i in range(60)]
    rows += [rows[7], rows[7], (7, texts[7], "note"), (8, texts[9], rows[8][2]), (300, None, "rule"), (301, "the\tof\x0bw1 w2\x1cw3", "rule")]
    documents = spark.createDataFrame(rows, "doc_id int, text string, type string").repartition(3)
    asked = spark.createDataFrame(ASKED, "query_id int, question string, intent string")
    types = {"rule_query": ["rule"], "mapping_query": ["rule", "entity_mappings"]}
    want = set()
    for q, question, intent in ASKED:
        own = documents.filter(F.col("type").isin(types[intent])) if intent in types else documents
        one = spark.createDataFrame([(q, question)], "query_id int, question string")
        # Rows of one id add up, those of equal type and length before they are weighted; a missing id comes first.
        found = bm25.bm25_scores(own, one, "doc_id", "text", "query_id", "question", ["type"]).groupBy("doc_id").agg(F.sum("score").alias("score")).collect()
        best = sorted((-round(r.score, 9), r.doc_id is not None, r.doc_id or 0) for r in found)[: 20 if intent == "mapping_query" else 6]
        want |= {(q, d if there else None, n, round(-s, 6)) for n, (s, there, d) in enumerate(best, 1)}
    assert len(want) == 6 + 20 + 6
    for tile, limit, per_pass in ((2, 5, 4096), (50, 200, 1)):
        for name, value in (("TILE_DOCUMENTS", tile), ("WORDS", limit), ("PRODUCTS", limit), ("WAITING", limit)):
            monkeypatch.setattr(st, name, value)
        monkeypatch.setattr(rt, "QUERIES_PER_PASS", per_pass)
        assert {(r.query_id, r.doc_id, r["rank"], round(r.score, 6)) for r in rt.intent_topk(documents, asked).collect()} == want


def test_equal_scores_keep_the_smaller_id():
    import numpy as np
    import pyarrow as pa

    rows = pa.table({"q": [1, 1], "depth": pa.array([4, 4], pa.int32()), "grp": [0, 0], "term": ["a", "b"], "times": [1, 2], "idf": [1.0, 0.5], "mean_length": [3.0, 3.0]})

    class Shared:
        value = st.Pack(rows, {"k": [0]}, 1.5, 0.75)

    ids = np.random.default_rng(1).permutation(5000)
    texts = pa.RecordBatch.from_arrays([pa.array([f"d{i:04}" for i in ids]), pa.array(["k" if i else "other" for i in ids]), pa.array(["a b c"] * 5000)], ["d", "kind", "text"])

    class Terms:
        value = Shared.value.terms

    found = list(st.best_of(Shared, 4)(st.lists_of(Terms)(iter([texts]))))
    assert [d for b in found for d in b.column(2).to_pylist()] == ["d0001", "d0002", "d0003", "d0004"]


def test_texts_are_hashed_before_they_are_shuffled(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc_id string, rank int")
    spark.createDataFrame([("a", "same"), ("b", "same")], "doc_id string, text string").write.parquet(f"{tmp_path}/texts")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fused = rt.fuse([(first, 1.0)], spark.read.parquet(f"{tmp_path}/texts"))
        plan = fused._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.index("SortMergeJoin") < plan.index("sha2(")
        assert [(r.doc_id, r["rank"]) for r in fused.collect()] == [("a", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
