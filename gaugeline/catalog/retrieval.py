"""Queries over questions, replies, chunks and ranked documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog import derived as d
from gaugeline.catalog.registry import query, table
from gaugeline.functions import questions as qs
from gaugeline.functions import replies as rp
from gaugeline.functions import text as tx
from gaugeline.operators.ranking import global_position
from gaugeline.plans import documents as dc
from gaugeline.plans import metrics as me
from gaugeline.plans import retrieval as rt

# ---- questions --------------------------------------------------------------------------

# Conversations with the openings that users of the engine write.
QUESTIONS_SQL = """qst AS (SELECT conv_id, turn, role, CASE turn WHEN 1 THEN 'Show rule #' || conv_id || ': ' || text WHEN 2 THEN 'And what about ' || text
 WHEN 3 THEN 'Compare the THIRD rule with rule no. ' || conv_id || ' and ' || text WHEN 4 THEN 'Give me code for rule ' || conv_id WHEN 5 THEN 'Why?'
 WHEN 6 THEN 'Does every mapping of the dataset have a type?' ELSE text END AS question FROM conversations)"""


def _questions(spark, folder):
    turn, text, conv = F.col("turn"), F.col("text"), F.col("conv_id").cast("string")
    question = (
        F.when(turn == 1, F.concat(F.lit("Show rule #"), conv, F.lit(": "), text))
        .when(turn == 2, F.concat(F.lit("And what about "), text))
        .when(turn == 3, F.concat(F.lit("Compare the THIRD rule with rule no. "), conv, F.lit(" and "), text))
        .when(turn == 4, F.concat(F.lit("Give me code for rule "), conv))
        .when(turn == 5, F.lit("Why?"))
        .when(turn == 6, F.lit("Does every mapping of the dataset have a type?"))
        .otherwise(text)
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", question.alias("question"))


def _any(expr: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{p}')" for p in phrases) + ")"


RULE_RE = r"(?i)\brule\s+(?:#\s*|no\.?\s*|number\s*)?(\d+)\b"
ORD_RE = r"(?i)\b(" + "|".join(qs.ORDINALS) + r")\s+rule\b"
ORD_LIST = "[" + ", ".join(f"'{o}'" for o in qs.ORDINALS) + "]"


@query("rule_refs", f"""WITH {QUESTIONS_SQL} SELECT conv_id, turn, CASE WHEN regexp_extract(question, '{RULE_RE}', 1) <> '' THEN CAST(regexp_extract(question, '{RULE_RE}', 1) AS BIGINT)
 WHEN regexp_extract(question, '{ORD_RE}', 1) <> '' THEN CAST(list_position({ORD_LIST}, lower(regexp_extract(question, '{ORD_RE}', 1))) AS BIGINT) END AS rule_number FROM qst""")
def rule_refs(spark, folder):
    return _questions(spark, folder).select("conv_id", "turn", qs.rule_number(F.col("question")).cast("bigint").alias("rule_number"))


Q = r"lower(regexp_replace(question, '^\s+|\s+$', '', 'g'))"
N_WORDS = rf"len(list_filter(string_split_regex({Q}, '\s+'), lambda t: t <> ''))"


@query("turn_flags", f"""WITH {QUESTIONS_SQL} SELECT conv_id, turn, CASE WHEN turn = 0 OR {_any(Q, qs.CODE_REQUESTS)} THEN 'no'
 WHEN {' OR '.join(f"starts_with({Q}, '{p}')" for p in qs.FOLLOW_UP_STARTS)} OR {N_WORDS} <= 4 OR {Q} IN ({', '.join(f"'{w}'" for w in qs.FOLLOW_UP_WHOLE)}) OR {_any(Q, qs.FOLLOW_UP_PHRASES)} THEN 'yes'
 WHEN {N_WORDS} <= 15 THEN 'undecided' ELSE 'no' END AS follow_up, {_any('lower(question)', qs.ENUMERATION_WORDS)} AS enumerates, {_any('lower(question)', qs.ALL_MAPPING_WORDS)} AS all_mappings,
 CASE WHEN {_any('lower(question)', qs.ENUMERATION_WORDS)} THEN 'schema_data_query' ELSE 'schema_query' END AS intent FROM qst""")
def turn_flags(spark, folder):
    question = F.col("question")
    return _questions(spark, folder).select(
        "conv_id", "turn", qs.follow_up(question, F.col("turn") > 0).alias("follow_up"), qs.asks_enumeration(question).alias("enumerates"),
        qs.asks_all_mappings(question).alias("all_mappings"), qs.settled_intent(F.lit("schema_query"), question).alias("intent"),
    )


@query("rule_refs_resolved", f"""WITH {QUESTIONS_SQL}, nam AS (SELECT p_partkey AS n, p_name FROM part), r AS (SELECT conv_id, turn, question, p_name FROM qst LEFT JOIN nam ON n = conv_id)
SELECT conv_id, turn, CASE WHEN turn IN (1, 3, 4) THEN replace(CASE WHEN p_name IS NULL THEN question ELSE regexp_replace(question, '(?i)\\brule\\s+(#|no\\. )?' || conv_id || '\\b', 'rule ' || conv_id || ' (' || p_name || ')') END,
 'THIRD rule', 'rule 3 (' || (SELECT p_name FROM nam WHERE n = 3) || ')') ELSE question END AS resolved FROM r""")
def rule_refs_resolved(spark, folder):
    rules = table(spark, folder, "part").select(F.col("p_partkey").alias("rule_index"), F.col("p_name").alias("rule_name"))
    asked = _questions(spark, folder).withColumn("query_id", F.concat_ws("/", "conv_id", "turn"))
    return rt.resolved_references(asked, rules).select("conv_id", "turn", "resolved")


def _context_sql(n: int, cut: int) -> str:
    return f"""SELECT conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY prev), '') AS context FROM (
 SELECT a.conv_id, a.turn, b.turn AS prev, upper(b.role) || ': ' || substr(b.text, 1, {cut}) AS line FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) a
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) b ON a.conv_id = b.conv_id AND b.p < a.p AND b.p >= a.p - {n}) GROUP BY conv_id, turn"""


@query("turn_context", _context_sql(4, 150))
def turn_context(spark, folder):
    return rt.recent_turns(table(spark, folder, "conversations"), 4, 150)


@query("turn_context_long", _context_sql(6, 300))
def turn_context_long(spark, folder):
    return rt.recent_turns(table(spark, folder, "conversations"), 6, 300)


# ---- replies ----------------------------------------------------------------------------


def _replies(spark, folder):
    """Replies that hold the order in the shapes a model writes: fenced, in prose, broken, or empty."""
    body = F.to_json(F.struct(F.lit("range").alias("check_type"), F.struct(F.col("o_totalprice").alias("max_value")).alias("parameters")))
    priority = F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(priority == "2-HIGH", F.concat(F.lit("Here it is: "), body, F.lit(" - done")))
        .when(priority == "3-MEDIUM", F.concat(F.lit("{broken "), body))
        .when(priority == "5-LOW", F.lit('{"note": "no check"}'))
        .otherwise("")
    )
    return table(spark, folder, "orders").select("o_orderkey", text.alias("reply"), F.col("o_custkey"))


@query("reply_parse", """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'range' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'not_null' END AS check_type,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice END AS max_value FROM orders""")
def reply_parse(spark, folder):
    return _replies(spark, folder).select(
        "o_orderkey", rp.check_type_or_default(F.col("reply")).alias("check_type"),
        F.get_json_object(rp.parameters_or_default(F.col("reply")), "$.max_value").cast("double").alias("max_value"),
    )


@query("reply_array", """SELECT o_orderkey, CAST(list_aggregate(list_transform(range(3 + len(o_orderstatus)), lambda i: 0.5), 'sum') + o_custkey AS DOUBLE) AS total FROM orders""")
def reply_array(spark, folder):
    """A list comprehension in a reply is written out before it is parsed."""
    text = F.concat(F.lit("scores: [0.5 for _ in range(3)] and [0.5 for _ in range(1)] and ["), F.col("o_custkey").cast("string"), F.lit("] end"))
    fixed = rp.expanded_ranges(F.concat(F.lit("```json\n"), text, F.lit("```")))
    numbers = F.transform(F.regexp_extract_all(fixed, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda t: t.cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b)
    return table(spark, folder, "orders").select("o_orderkey", total.alias("total"))


@query("reply_parsed_array", "SELECT o_orderkey, CAST(4 AS BIGINT) AS n_values, CAST(o_custkey AS BIGINT) AS last_value FROM orders")
def reply_parsed_array(spark, folder):
    text = F.concat(F.lit("```json\n[0, 0, 1, "), F.col("o_custkey").cast("string"), F.lit("]\n```"))
    values = F.try_variant_get(rp.parsed_array(text), "$", "array<bigint>")
    return table(spark, folder, "orders").select("o_orderkey", F.size(values).cast("bigint").alias("n_values"), F.element_at(values, -1).alias("last_value"))


@query("strip_id_lines", r"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^\s*The')), chr(10)) AS kept FROM documents""")
def strip_id_lines(spark, folder):
    """Lines that start with "The" are turned into id assignments and dropped by X6."""
    coded = F.regexp_replace("text", r"(?m)^[ \t]*The", "  id_column = 'x' # ")
    return table(spark, folder, "documents").select("doc_id", tx.without_id_assignments(coded).alias("kept"))


# ---- chunks -----------------------------------------------------------------------------


@query("doc_windows", """SELECT doc_id, i + 1 AS chunk_no, substr(text, CAST(i * 520 + 1 AS BIGINT), 600) AS chunk FROM (
 SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 80) / 520), 1) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def doc_windows(spark, folder):
    return rt.stride_windows(table(spark, folder, "documents"), "doc_id", "text")


def _chunks_sql(size: int, overlap: int) -> str:
    """Chunks of every text in SQL: pieces level by level, then from chunk to chunk along the ends of the pieces of a run.

    ``path`` orders what a text falls into: runs of short pieces at even, long pieces at odd numbers.
    """
    separators = ("chr(10) || chr(10)", "chr(10)", "' '")
    at = " ".join(f"WHEN s <= {k} AND contains(t, {sep}) THEN {k}" for k, sep in enumerate(separators))
    split = " ".join(f"WHEN {k} THEN list_transform(string_split(t, {sep}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {sep} || x END)" for k, sep in enumerate(separators))
    levels = ["n0 AS (SELECT r, path, t, CASE {at} ELSE 3 END AS s FROM (SELECT r, CAST([] AS BIGINT[]) AS path, coalesce(text, '') AS t, 0 AS s FROM doc))"]
    for k in range(3):
        levels.append(f"""l{k} AS (SELECT r, path, s, list_filter(CASE s {split} END, lambda x: x <> '') AS ps FROM n{k} WHERE s < 3),
 e{k} AS (SELECT r, path, s, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM l{k}),
 p{k} AS (SELECT *, sum(CAST(length(piece) >= {size} AS INT)) OVER (PARTITION BY r, path ORDER BY k) AS longs, length(piece) >= {size} AS long FROM e{k}),
 n{k + 1} AS (SELECT r, path, t, CASE {{at}} ELSE 3 END AS s FROM (SELECT r, list_append(path, CAST(2 * longs - 1 AS BIGINT)) AS path, piece AS t, s + 1 AS s FROM p{k} WHERE long))""")
    runs = " UNION ALL ".join(
        f"""SELECT r, list_append(path, CAST(2 * longs AS BIGINT)) AS path, string_agg(piece, '' ORDER BY k) AS t, list_prepend(0, list(upto ORDER BY k)) AS c
 FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY r, path, longs ORDER BY k) AS upto FROM p{k} WHERE NOT long) GROUP BY r, path, longs"""
        for k in range(3)
    )
    letters = " UNION ALL ".join(f"SELECT r, path, t, range(0, length(t) + 1) AS c FROM n{k} WHERE s = 3 AND t <> ''" for k in range(4))
    blank = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    # c holds the offsets between pieces, f and e the places in c where a chunk begins and ends.
    return f"""WITH RECURSIVE doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents), {", ".join(levels).replace("{at}", at)},
 runs AS MATERIALIZED (SELECT row_number() OVER () AS run, * FROM ({runs} UNION ALL {letters})),
 walk AS (SELECT run, c, CAST(1 AS BIGINT) AS f, CAST(len(list_filter(c, lambda x: x <= {size})) AS BIGINT) AS e FROM runs
  UNION ALL SELECT run, c, g, CAST(len(list_filter(c, lambda x: x <= c[g] + {size})) AS BIGINT) FROM (
   SELECT run, c, least(e, 1 + len(list_filter(c, lambda x: x < greatest(c[e] - {overlap}, c[e + 1] - {size})))) AS g FROM walk WHERE e < len(c))),
 cut AS (SELECT r, path, f, regexp_replace(regexp_replace(substr(t, CAST(w.c[f] + 1 AS BIGINT), CAST(w.c[e] - w.c[f] AS BIGINT)), '^{blank}', ''), '{blank}$', '') AS chunk FROM walk w JOIN runs USING (run))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY r ORDER BY path, f) AS INTEGER) AS chunk_no, chunk FROM cut JOIN doc USING (r) WHERE chunk <> ''"""


@query("doc_chunks", _chunks_sql(rt.CHUNK_SIZE, rt.CHUNK_OVERLAP))
def doc_chunks(spark, folder):
    return rt.chunk_documents(table(spark, folder, "documents"), "doc_id", "text")


# ---- ranking ----------------------------------------------------------------------------

TOKENS = r"list_filter(string_split_regex({0}, '\s+'), lambda t: t <> '')"
BM25_SQL = f"""doc AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
 n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM doc), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM doc) GROUP BY 1),
 raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, n), idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
 tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM doc) GROUP BY 1, 2, 3),
 qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
 sco AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term), n GROUP BY 1, 2),
 b25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sco)"""


def _benchmark(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM b25 WHERE rank <= 6")
def bm25_topk(spark, folder):
    top = rt.bm25_topk(table(spark, folder, "documents"), _benchmark(spark, folder), 6)
    return top.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("bm25_terms", f"""WITH doc AS (SELECT {TOKENS.format('text')} AS t FROM documents), n AS (SELECT count(*) AS n FROM doc), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM doc) GROUP BY 1),
 raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, n) SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END, 6) AS idf FROM raw""")
def bm25_terms(spark, folder):
    statistics = rt.corpus_statistics(table(spark, folder, "documents"), "text")
    return rt.term_weights(statistics).withColumn("idf", F.round("idf", 6))


# Windows of the documents ranked as documents of their own.
CHUNK_SQL = f"""WITH win AS (SELECT doc_id, i + 1 AS chunk_no, substr(text, CAST(i * 520 + 1 AS BIGINT), 600) AS chunk FROM (
 SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 80) / 520), 1) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)),
 doc AS (SELECT doc_id, chunk_no, {TOKENS.format('chunk')} AS t FROM win),
 n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM doc), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM doc) GROUP BY 1),
 raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, n),
 qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
 idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw WHERE term IN (SELECT term FROM qt)),
 tf AS (SELECT doc_id, chunk_no, l, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, len(t) AS l, unnest(t) AS term FROM doc) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3, 4),
 sco AS (SELECT query_id, doc_id, chunk_no, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 9) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term), n GROUP BY 1, 2, 3),
 chk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM sco QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) <= 12)"""


@query("chunk_topk", CHUNK_SQL + " SELECT query_id, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM chk")
def chunk_topk(spark, folder):
    chunks = rt.stride_windows(table(spark, folder, "documents"), "doc_id", "text")
    top = rt.rank_chunks(chunks, _benchmark(spark, folder), 12)
    return top.select("query_id", "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "rank", F.round("score", 6).alias("score"))


@query("chunk_documents_topk", CHUNK_SQL + """ SELECT query_id, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(place AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place
 FROM (SELECT * FROM chk QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) = 1)) WHERE place <= 5""")
def chunk_documents_topk(spark, folder):
    chunks = rt.stride_windows(table(spark, folder, "documents"), "doc_id", "text")
    top = rt.best_chunk_documents(rt.rank_chunks(chunks, _benchmark(spark, folder), 12), 5)
    return top.select("query_id", "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "rank", F.round("score", 6).alias("score"))


VECTOR_SQL = """dis AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_sum(list_transform(range(1, 65), lambda i: (CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)))) AS q
 FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) q JOIN embeddings v ON v.vec_id IN (SELECT doc_id FROM documents)),
 vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(q, 9), doc_id) AS rank FROM dis)"""


def _vector_ranking(spark, folder, k):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    documents = vectors.join(table(spark, folder, "documents").select("doc_id"), "doc_id")
    asked = vectors.withColumnRenamed("doc_id", "query_id").join(_benchmark(spark, folder).select("query_id"), "query_id")
    return rt.vector_topk(documents, asked, k, "doc_id", "vector")


HYBRID_SQL = f"""WITH {BM25_SQL}, {VECTOR_SQL}, rks AS (SELECT query_id, doc_id, rank, 0 AS place FROM b25 WHERE rank <= 6 UNION ALL SELECT query_id, doc_id, rank, 1 FROM vec WHERE rank <= 6),
 mrg AS (SELECT query_id, text, sum(0.5 / (rank + 60)) AS score, min((place, rank, doc_id)) AS first, arg_min(doc_id, (place, rank, doc_id)) AS doc_id FROM rks JOIN documents USING (doc_id) GROUP BY 1, 2),
 fus AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first) AS rank FROM mrg)"""


def _hybrid(spark, folder):
    documents = table(spark, folder, "documents")
    by_words = rt.bm25_topk(documents, _benchmark(spark, folder), 6)
    by_vector = _vector_ranking(spark, folder, 6)
    return rt.fuse([(by_words, 0.5), (by_vector, 0.5)], documents.select("doc_id", "text"))


@query("hybrid_rrf", HYBRID_SQL + " SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM fus WHERE rank <= 5")
def hybrid_rrf(spark, folder):
    return _hybrid(spark, folder).withColumn("score", F.round("score", 6))


@query("context_pack", HYBRID_SQL + " SELECT query_id, sha256(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_hash FROM fus JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1")
def context_pack(spark, folder):
    packed = rt.pack_context(_hybrid(spark, folder), table(spark, folder, "documents"))
    return packed.select("query_id", F.sha2("context", 256).alias("context_hash"))


@query("context_sources", HYBRID_SQL + """ SELECT query_id, key, CAST(rank AS INTEGER) AS rank, snippet FROM (SELECT query_id, coalesce(nullif(source, 'src0'), lang) AS key, rank, substr(text, 1, 100) || '…' AS snippet,
 row_number() OVER (PARTITION BY query_id, coalesce(nullif(source, 'src0'), lang) ORDER BY rank) AS n FROM fus JOIN documents USING (doc_id) WHERE rank <= 5) WHERE n = 1""")
def context_sources(spark, folder):
    documents = table(spark, folder, "documents").select(
        "doc_id", "text", F.nullif("source", F.lit("src0")).alias("rule_name"), F.lit(None).cast("string").alias("table_name"), F.col("lang").alias("type")
    )
    return rt.distinct_sources(_hybrid(spark, folder), documents).select("query_id", "key", "rank", "snippet")


# Documents by type, and questions of four kinds: code, all mappings, a rule by its number, and others.
CONTEXT_SQL = f"""{HYBRID_SQL}, ask AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'code_query' WHEN 1 THEN 'mapping_query' WHEN 2 THEN 'rule_query' ELSE 'general' END AS intent,
 CASE item_id % 4 WHEN 1 THEN 'Show all mappings: ' || text WHEN 2 THEN 'Explain rule #' || item_id ELSE text END AS question FROM benchmark),
 typ AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS n, CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'rule' WHEN lang IN ('en', 'fr') THEN 'generated_code' WHEN lang = 'de' THEN 'entity_mappings' ELSE 'execution_results' END AS type, text FROM documents
  UNION ALL SELECT 'entity_mappings_hop1//' || row_number() OVER (ORDER BY source), NULL, 'entity_mappings_hop1', 'Mappings of ' || lang || ' ' || source FROM (SELECT source, min(lang) AS lang FROM documents GROUP BY 1)
  UNION ALL SELECT 'entity_mappings_summary//' || row_number() OVER (ORDER BY lang), NULL, 'entity_mappings_summary', 'Mappings of ' || lang || ' src0' FROM (SELECT DISTINCT lang FROM documents)
  UNION ALL SELECT 'generated_code_summary//' || (1 + k), NULL, 'generated_code_summary', 'Code of part ' || (1 + k) || ': ' || n FROM (SELECT doc_id % 2 AS k, count(*) AS n FROM documents GROUP BY 1)),
 src AS (SELECT query_id, doc_id, 0 AS stage, (CASE type WHEN 'entity_mappings_summary' THEN 1 WHEN 'entity_mappings_hop1' THEN 2 ELSE 3 END, length(doc_id), doc_id) AS o, 'forced' AS source FROM ask, typ
   WHERE intent = 'mapping_query' AND type IN ('entity_mappings_summary', 'entity_mappings_hop1', 'entity_mappings_hop2')
  UNION ALL SELECT query_id, doc_id, 1, (0, length(doc_id), doc_id), 'looked up' FROM ask JOIN typ ON n = query_id WHERE intent = 'rule_query' AND type = 'rule'
  UNION ALL SELECT query_id, CAST(doc_id AS VARCHAR), 2, (rank, length(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)), 'ranked' FROM fus WHERE rank <= 5),
 cho AS (SELECT query_id, doc_id, o, source FROM src QUALIFY stage = min(stage) OVER (PARTITION BY query_id)
  UNION ALL SELECT query_id, doc_id, (0, length(doc_id), doc_id), 'summary' FROM ask, typ WHERE intent = 'code_query' AND type = 'generated_code_summary'),
 pla AS (SELECT query_id, doc_id, o, source, type, text, intent = 'code_query' AS is_code, coalesce(bool_or(intent = 'code_query' AND type = 'generated_code') OVER (PARTITION BY query_id), false) AS has_code FROM cho JOIN typ USING (doc_id) JOIN ask USING (query_id)),
 grp AS (SELECT *, CASE WHEN has_code THEN CASE type WHEN 'generated_code' THEN 1 WHEN 'generated_code_summary' THEN 2 END WHEN is_code AND type = 'generated_code_summary' THEN 0 ELSE 1 END AS g FROM pla),
 one AS (SELECT * FROM grp WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY g, o, source) = 1),
 fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g, o, doc_id) AS place FROM one)"""


def _context(spark, folder):
    documents, asked = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    kind, number, lang, even = F.col("item_id") % 4, F.col("item_id").cast("string"), F.col("lang"), F.col("doc_id") % 2 == 0
    questions = asked.select(
        F.col("item_id").alias("query_id"), F.when(kind == 0, "code_query").when(kind == 1, "mapping_query").when(kind == 2, "rule_query").otherwise("general").alias("intent"),
        F.when(kind == 1, F.concat(F.lit("Show all mappings: "), "text")).when(kind == 2, F.concat(F.lit("Explain rule #"), number)).otherwise(F.col("text")).alias("question"),
    )
    doc_type = F.when((lang == "en") & even, "rule").when(lang.isin("en", "fr"), "generated_code").when(lang == "de", "entity_mappings").otherwise("execution_results")
    own = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("rule_number"), doc_type.alias("type"), "text")

    def summary(groups, name, order, text):
        place = global_position(groups, [order]).withColumn("doc_id", F.concat(F.lit(f"{name}//"), F.col("position").cast("string")))
        return place.select("doc_id", F.lit(None).cast("bigint").alias("rule_number"), F.lit(name).alias("type"), text.alias("text"))

    sources = documents.groupBy("source").agg(F.min("lang").alias("lang"))
    halves = documents.groupBy((F.col("doc_id") % 2 + 1).alias("k")).agg(F.count("*").alias("n"))
    every = own.unionByName(summary(sources, "entity_mappings_hop1", "source", F.concat(F.lit("Mappings of "), "lang", F.lit(" "), "source")))
    every = every.unionByName(summary(documents.select("lang").distinct(), "entity_mappings_summary", "lang", F.concat(F.lit("Mappings of "), "lang", F.lit(" src0"))))
    code = F.concat(F.lit("Code of part "), F.col("k").cast("string"), F.lit(": "), F.col("n").cast("string"))
    every = every.unionByName(summary(halves, "generated_code_summary", "k", code))
    ranked = _hybrid(spark, folder).select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "rank")
    rules = documents.select(F.col("doc_id").alias("rule_index"), F.lit("").alias("rule_name"))
    looked_up = rt.direct_lookup(questions, rules, every)
    return questions, every, rt.context_documents(questions, every, ranked, looked_up)


@query("context_documents", CONTEXT_SQL + " SELECT query_id, CAST(place AS INTEGER) AS place, doc_id, type, source FROM fin WHERE place <= 5")
def context_documents(spark, folder):
    return _context(spark, folder)[2]


@query("context_answers", CONTEXT_SQL + """ SELECT query_id, sha256(coalesce(c, 'No relevant documents found.')) AS context_hash FROM ask
 LEFT JOIN (SELECT query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS c FROM fin WHERE place <= 5 GROUP BY 1) USING (query_id)""")
def context_answers(spark, folder):
    questions, every, placed = _context(spark, folder)
    return rt.context_answers(questions, every, placed).select("query_id", F.sha2("context", 256).alias("context_hash"))


TYPE_SQL = "CASE lang WHEN 'en' THEN 'rule' WHEN 'fr' THEN 'execution_results' WHEN 'de' THEN 'entity_mappings' ELSE 'generated_code' END"
INTENT_SQL = "CASE WHEN length(text) < 150 THEN 'rule_query' WHEN length(text) < 200 THEN 'mapping_query' WHEN length(text) < 250 THEN 'schema_query' ELSE 'general' END"


# BM25 within the documents of each intent: their own frequencies and mean length.
INTENT_BM25_SQL = f"""ask AS (SELECT item_id AS query_id, {INTENT_SQL} AS intent, text FROM benchmark), tok AS (SELECT doc_id, {TYPE_SQL} AS type, {TOKENS.format('text')} AS t FROM documents),
 own AS (SELECT intent, doc_id, t FROM (SELECT DISTINCT intent FROM ask) JOIN tok ON intent IN ('schema_query', 'general') OR (intent = 'rule_query' AND type = 'rule') OR (intent = 'mapping_query' AND type IN ('rule', 'entity_mappings'))),
 n AS (SELECT intent, count(*) AS n, avg(len(t)) AS a FROM own GROUP BY 1), df AS (SELECT intent, term, count(*) AS df FROM (SELECT intent, unnest(list_distinct(t)) AS term FROM own) GROUP BY 1, 2),
 raw AS (SELECT intent, term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df JOIN n USING (intent)), flo AS (SELECT intent, 0.25 * avg(r) AS f FROM raw GROUP BY 1),
 qt AS (SELECT query_id, intent, term, count(*) AS times FROM (SELECT query_id, intent, unnest({TOKENS.format('text')}) AS term FROM ask) GROUP BY 1, 2, 3),
 idf AS (SELECT intent, term, CASE WHEN r < 0 THEN f ELSE r END AS idf FROM raw JOIN flo USING (intent) WHERE term IN (SELECT term FROM qt)),
 tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
 sco AS (SELECT query_id, qt.intent, tf.doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM qt JOIN tf USING (term) JOIN (SELECT intent, doc_id FROM own) o ON o.intent = qt.intent AND o.doc_id = tf.doc_id
  JOIN idf ON idf.intent = qt.intent AND idf.term = qt.term JOIN n ON n.intent = qt.intent GROUP BY 1, 2, 3),
 b25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sco),
 top AS (SELECT * FROM b25 WHERE rank <= CASE intent WHEN 'mapping_query' THEN 20 WHEN 'schema_query' THEN 10 ELSE 6 END)"""


def _intents(spark, folder):
    lang, size = F.col("lang"), F.length("text")
    kind = F.when(lang == "en", "rule").when(lang == "fr", "execution_results").when(lang == "de", "entity_mappings").otherwise("generated_code")
    intent = F.when(size < 150, "rule_query").when(size < 200, "mapping_query").when(size < 250, "schema_query").otherwise("general")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), intent.alias("intent"))
    return table(spark, folder, "documents").withColumn("type", kind), asked


@query("filtered_topk", f"WITH {INTENT_BM25_SQL} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM top")
def filtered_topk(spark, folder):
    documents, asked = _intents(spark, folder)
    return rt.intent_topk(documents, asked).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("intent_chain", f"""WITH {INTENT_BM25_SQL}, vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 dis AS (SELECT query_id, ask.intent, d.vec_id AS doc_id, round(list_sum(list_transform(range(1, 65), lambda i: (d.v[i] - q.v[i]) * (d.v[i] - q.v[i]))), 9) AS q
  FROM ask JOIN vec q ON q.vec_id = query_id JOIN (SELECT DISTINCT intent, doc_id FROM own) o ON o.intent = ask.intent JOIN vec d ON d.vec_id = o.doc_id),
 near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY q, doc_id) AS rank FROM dis),
 rks AS (SELECT query_id, doc_id, rank, 0 AS place FROM top UNION ALL SELECT query_id, doc_id, rank, 1 FROM near WHERE rank <= CASE intent WHEN 'mapping_query' THEN 20 WHEN 'schema_query' THEN 10 ELSE 6 END),
 mrg AS (SELECT query_id, text, sum(0.5 / (rank + 60)) AS score, min((place, rank, doc_id)) AS first, arg_min(doc_id, (place, rank, doc_id)) AS doc_id FROM rks JOIN documents USING (doc_id) GROUP BY 1, 2),
 fus AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first) AS rank FROM mrg)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM fus WHERE rank <= 5""")
def intent_chain(spark, folder):
    documents, asked = _intents(spark, folder)
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    found = rt.intent_retrieval(documents, asked, vectors, vectors.withColumnRenamed("doc_id", "query_id"))
    return found.withColumn("score", F.round("score", 6))


# ---- documents of the engine's own metadata ---------------------------------------------


def _run_log(spark, folder):
    rules = me.indexed_rules(d.run_rules(spark, folder), "first_seen")
    return rules, me.run_log(rules, d.runs(spark, folder), d.compiled(spark, folder))


@query("doc_executions", d.with_(d.RUNS_SQL, d.LATEST_SQL, d.RUN_RULES_SQL) + """
SELECT 'execution_results/' || rule_index || '/1' AS doc_id, rule_index AS rule_number, 'Execution of rule ' || rule_index || ': ' || lat.rule_name || chr(10) || 'Passed: ' || passed_count || chr(10) || 'Failed: ' || failed_count || chr(10) || 'Pass rate: ' || round(pass_rate, 4) AS text
FROM lat JOIN rru ON lat.rule_name = rru.rule_name""")
def doc_executions(spark, folder):
    documents = dc.execution_documents(_run_log(spark, folder)[1])
    return documents.select("doc_id", "rule_number", "text")


DOC_RULES = d.with_(d.SCHEMA_SQL, d.MAPPING_SQL, d.S2D_SQL, d.RULES_SQL, d.ENTITIES_SQL, """
idx AS (SELECT *, row_number() OVER (ORDER BY rule_id) AS rule_index FROM rul), one AS (SELECT rule_id, entity, min(pos) AS pos FROM ent GROUP BY 1, 2)""")


def _rules(spark, folder):
    return me.indexed_rules(d.rules(spark, folder), "rule_id")


@query("doc_rules", DOC_RULES + """, prs AS (SELECT rule_id, string_agg(entity || ' = ' || coalesce(schema_col, 'not yet mapped'), ', ' ORDER BY pos, entity) AS body FROM one LEFT JOIN map USING (entity) GROUP BY 1)
SELECT 'rule/' || rule_index || '/1' AS doc_id, rule_name, rule_index AS rule_number, 'Rule ' || rule_index || ': ' || rule_name || chr(10) || 'Business rule: ' || text || chr(10) || 'Category: ' || category || chr(10) ||
 'Complexity: ' || complexity || chr(10) || 'Entities: ' || coalesce(body, '') AS text FROM idx LEFT JOIN prs USING (rule_id)""")
def doc_rules(spark, folder):
    documents = dc.rule_documents(_rules(spark, folder), d.entities(spark, folder), d.mapping(spark, folder))
    return documents.select("doc_id", "rule_name", "rule_number", "text")


@query("doc_mappings", DOC_RULES + """, hop AS (SELECT rule_id, one.pos, entity, schema_col, dataset_col, coalesce(dataset_col <> schema_col, false) AS ren FROM one JOIN map USING (entity) LEFT JOIN s2d USING (schema_col)),
prs AS (SELECT rule_id, string_agg(entity || ' -> ' || schema_col || CASE WHEN ren THEN ' -> ' || dataset_col ELSE '' END, chr(10) ORDER BY pos, entity) AS body, count(*) FILTER (WHERE ren) AS n FROM hop GROUP BY 1)
SELECT 'entity_mappings/' || rule_index || '/1' AS doc_id, rule_index AS rule_number, 'Mappings of rule ' || rule_index || ': ' || rule_name || chr(10) || body || CASE WHEN n = 0 THEN chr(10) || 'Schema and dataset columns have the same names' ELSE '' END AS text
FROM idx JOIN prs USING (rule_id)""")
def doc_mappings(spark, folder):
    documents = dc.mapping_documents(_rules(spark, folder), d.entities(spark, folder), d.mapping(spark, folder), d.schema_to_dataset(spark, folder))
    return documents.select("doc_id", "rule_number", "text")


@query("doc_rule_summaries", d.with_(d.RULES_SQL) + """
SELECT 'rules_summary//' || b AS doc_id, 'Rules in order, part ' || b || ':' || chr(10) || string_agg(i || '. ' || rule_name || ' [' || category || ']', chr(10) ORDER BY i) AS text
FROM (SELECT *, row_number() OVER (ORDER BY rule_id) AS i, (row_number() OVER (ORDER BY rule_id) - 1) // 50 + 1 AS b FROM rul) GROUP BY b""")
def doc_rule_summaries(spark, folder):
    return dc.rule_summaries(_rules(spark, folder)).select("doc_id", "text")


@query("doc_tables", d.with_(d.COLUMNS_SQL) + """
SELECT 'dataset_columns/' || table_name || '/1' AS doc_id, table_name, 'Columns of table ' || table_name || ': ' || string_agg(column_name, ', ' ORDER BY position) AS text FROM cat GROUP BY table_name""")
def doc_tables(spark, folder):
    return dc.raw_column_documents(d.columns(spark, folder)).select("doc_id", "table_name", "text")


@query("doc_schema", d.with_(d.SCHEMA_SQL) + """
SELECT 'target_schema//' || b AS doc_id, b AS batch, 'Target schema columns, part ' || b || ':' || chr(10) || string_agg('- ' || name || ' [type: ' || coalesce(type, 'string') || ', category: ' || coalesce(category, 'other') || '] [table: ' || table_name || ']', chr(10) ORDER BY n) AS text
FROM (SELECT *, row_number() OVER (ORDER BY position) AS n, (row_number() OVER (ORDER BY position) - 1) // 15 + 1 AS b FROM fld) GROUP BY b""")
def doc_schema(spark, folder):
    return dc.schema_documents(d.target_schema(spark, folder)).select("doc_id", "batch", "text")


def _all_documents(spark, folder):
    rules, log = _run_log(spark, folder)
    target, mapping, s2d = d.target_schema(spark, folder), d.mapping(spark, folder), d.schema_to_dataset(spark, folder)
    from gaugeline.operators.schema import column_types

    failing = d.runs(spark, folder).filter("failed_count > 0").select("rule_name", F.col("failed_count").alias("rows_affected"), F.least("failed_count", F.lit(100)).alias("n_ids"), "ts")
    history = me.remediation_history(failing).join(rules.select("rule_name", "rule_index"), "rule_name", "left")
    order_rules = _rules(spark, folder)
    entities = d.entities(spark, folder)
    own = [
        dc.table_documents(d.columns(spark, folder), column_types(mapping, s2d, target)), dc.raw_column_documents(d.columns(spark, folder)),
        dc.overview_document(d.columns(spark, folder), target), dc.schema_documents(target), dc.type_documents(column_types(mapping, s2d, target)),
        dc.rule_documents(order_rules, entities, mapping), dc.rule_summaries(order_rules), dc.execution_documents(log),
        dc.remediation_documents(history), dc.remediation_summary(history), dc.mapping_documents(order_rules, entities, mapping, s2d),
        dc.mapping_summaries(order_rules, entities, mapping, s2d), dc.check_documents(rules, d.compiled(spark, folder)), dc.check_summary(d.compiled(spark, folder)),
    ]
    documents = own[0]
    for part in own[1:]:
        documents = documents.unionByName(part)
    return documents


@query("doc_type_counts", d.with_(d.SCHEMA_SQL, d.MAPPING_SQL, d.S2D_SQL, d.COLUMNS_SQL, d.RULES_SQL, d.ENTITIES_SQL, d.RUNS_SQL, d.LATEST_SQL, d.RUN_RULES_SQL, d.COMPILED_SQL, """
idx AS (SELECT rule_id, row_number() OVER (ORDER BY rule_id) AS i FROM rul), mpd AS (SELECT DISTINCT i FROM ent JOIN map USING (entity) JOIN idx USING (rule_id)),
typ AS (SELECT DISTINCT dataset_col AS c FROM s2d JOIN fld ON name = schema_col WHERE dataset_col <> schema_col UNION SELECT dataset_col FROM s2d JOIN map USING (schema_col) WHERE dataset_col IS NOT NULL UNION SELECT schema_col FROM map)""") + """
SELECT type, CAST(n AS BIGINT) AS n_documents FROM (SELECT 'table_schema' AS type, count(DISTINCT table_name) AS n FROM cat UNION ALL SELECT 'dataset_columns', count(DISTINCT table_name) FROM cat
 UNION ALL SELECT 'dataset_overview', 1 UNION ALL SELECT 'target_schema', ceil(count(*) / 15) FROM fld UNION ALL SELECT 'dataset_col_types', ceil(count(*) / 50) FROM typ UNION ALL SELECT 'rule', count(*) FROM rul
 UNION ALL SELECT 'rules_summary', ceil(count(*) / 50) FROM rul UNION ALL SELECT 'execution_results', count(*) FROM lat UNION ALL SELECT 'remediation_results', count(*) FROM run WHERE failed_count > 0
 UNION ALL SELECT 'remediation_summary', 1 UNION ALL SELECT 'entity_mappings', count(*) FROM mpd UNION ALL SELECT 'entity_mappings_summary', count(DISTINCT (i - 1) // 50) FROM mpd
 UNION ALL SELECT 'entity_mappings_hop1', count(DISTINCT (i - 1) // 50) FROM mpd UNION ALL SELECT 'entity_mappings_hop2', ceil(count(*) / 50) FROM s2d WHERE dataset_col <> schema_col
 UNION ALL SELECT 'generated_code', count(*) FROM cmp UNION ALL SELECT 'generated_code_summary', 1)""")
def doc_type_counts(spark, folder):
    return _all_documents(spark, folder).groupBy("type").agg(F.count("*").alias("n_documents"))


ASKED_SQL = """ask AS (SELECT event_id AS query_id, CASE WHEN event_type = 'click' THEN 'Show the results of rule #' || (user_id + 1) ELSE 'What is the pass rate of "' || event_type || ' of user ' || user_id || '"?' END AS question,
 CASE WHEN event_type = 'view' THEN 'code_query' WHEN event_type = 'error' THEN 'general' ELSE 'execution_query' END AS intent, user_id, event_type FROM events)"""


def _asked(spark, folder):
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    by_number = F.concat(F.lit("Show the results of rule #"), (F.col("user_id") + 1).cast("string"))
    by_name = F.concat(F.lit('What is the pass rate of "'), kind, F.lit(" of user "), user, F.lit('"?'))
    intent = F.when(kind == "view", "code_query").when(kind == "error", "general").otherwise("execution_query")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("query_id"), F.when(kind == "click", by_number).otherwise(by_name).alias("question"), intent.alias("intent")
    )


@query("direct_lookup", d.with_(d.RUNS_SQL, d.LATEST_SQL, d.RUN_RULES_SQL, d.COMPILED_SQL, ASKED_SQL, """
num AS (SELECT query_id, intent, CASE WHEN event_type = 'click' THEN user_id + 1 ELSE (SELECT min(rule_index) FROM rru WHERE contains(lower(question), lower(rule_name))) END AS rule_number FROM ask)""") + """
SELECT query_id, rule_number, 'execution_results' AS type, 'execution_results/' || rule_number || '/1' AS doc_id FROM num WHERE intent = 'execution_query' AND rule_number IN (SELECT rule_index FROM lat JOIN rru ON lat.rule_name = rru.rule_name)
UNION ALL SELECT query_id, rule_number, 'generated_code', 'generated_code/' || rule_number || '/1' FROM num WHERE intent = 'code_query' AND rule_number IN (SELECT rule_index FROM cmp JOIN rru ON cmp.rule_name = rru.rule_name)""")
def direct_lookup(spark, folder):
    rules, log = _run_log(spark, folder)
    documents = dc.execution_documents(log).unionByName(dc.check_documents(rules, d.compiled(spark, folder)))
    return rt.direct_lookup(_asked(spark, folder), rules, documents)


@query("forced_docs", f"""WITH {QUESTIONS_SQL}, {d.SCHEMA_SQL}, {d.S2D_SQL}, {d.COMPILED_SQL}, q AS (SELECT conv_id || '/' || turn AS query_id, turn, lower(question) AS t FROM qst)
SELECT query_id, 'generated_code_summary' AS type, 'generated_code_summary//1' AS doc_id FROM q WHERE turn = 4
UNION ALL SELECT query_id, 'entity_mappings_hop2', 'entity_mappings_hop2//' || b FROM q, (SELECT unnest(range(1, CAST(ceil(count(*) / 50) AS BIGINT) + 1)) AS b FROM s2d WHERE dataset_col <> schema_col) WHERE turn <> 4 AND {_any('t', qs.ALL_MAPPING_WORDS)}""")
def forced_docs(spark, folder):
    intent = F.when(F.col("turn") == 4, "code_query").otherwise("mapping_query")
    asked = _questions(spark, folder).select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), "question", intent.alias("intent"))
    s2d = d.schema_to_dataset(spark, folder)
    none = d.entities(spark, folder).filter(F.lit(False))
    summaries = dc.mapping_summaries(_rules(spark, folder), none, d.mapping(spark, folder), s2d)
    return rt.forced_documents(asked, summaries.unionByName(dc.check_summary(d.compiled(spark, folder))))
