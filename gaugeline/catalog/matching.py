"""Queries over name matching and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog import derived as d
from gaugeline.catalog.registry import query, table
from gaugeline.functions.similarity import name_similarity, token_key
from gaugeline.functions.text import normalized_name
from gaugeline.operators import matching as mt
from gaugeline.operators.ranking import score_band
from gaugeline.operators.skew import spread_rows
from gaugeline.plans import retrieval as rt


def _norm(expr: str) -> str:
    return f"regexp_replace(translate(lower({expr}), '_.', '  '), '[^a-z0-9 ]', '', 'g')"


def _tokens(expr: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex({expr}, ' +'), lambda t: t <> '')))"


def similarity_sql(source: str, name: str) -> str:
    """CTEs that add ``sim`` for the columns a and b of ``source``; the result is ``name``."""
    return f"""{name}_1 AS (SELECT DISTINCT a, b, {_tokens(_norm('a'))} AS ta, {_tokens(_norm('b'))} AS tb FROM {source}),
{name}_2 AS (SELECT a, b, ta, tb, list_filter(ta, lambda t: list_contains(tb, t)) AS sh, list_filter(ta, lambda t: NOT list_contains(tb, t)) AS oa,
 list_filter(tb, lambda t: NOT list_contains(ta, t)) AS ob FROM {name}_1),
{name}_3 AS (SELECT *, array_to_string(oa, ' ') AS ra, array_to_string(ob, ' ') AS rb, length(array_to_string(sh, ' ')) AS sl FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN length(ra) <= length(rb) THEN ra ELSE rb END AS s, CASE WHEN length(ra) <= length(rb) THEN rb ELSE ra END AS l,
 CASE WHEN sl > 0 THEN 1 ELSE 0 END AS g FROM {name}_3),
{name}_5 AS (SELECT *, ((1::BIGINT << length(s)) - 1)::BIGINT AS ones, list_transform(string_split(l, ''), lambda c: coalesce(list_sum(list_transform(range(length(s)),
 lambda i: CASE WHEN substr(s, i + 1, 1) = c THEN (1::BIGINT << i) ELSE 0::BIGINT END)), 0)::BIGINT) AS masks FROM {name}_4),
{name}_6 AS (SELECT *, CASE WHEN s = '' THEN 0 ELSE length(s) - bit_count(list_reduce(masks, lambda x, m: ((x + (x & m)) | (x - (x & m))) & ones, ones)) END AS lcs FROM {name}_5),
{name}_7 AS (SELECT *, sl + g + length(ra) AS fa, sl + g + length(rb) AS fb, length(ra) + length(rb) - 2 * lcs AS indel FROM {name}_6),
{name} AS (SELECT a, b, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 WHEN len(sh) > 0 AND (len(oa) = 0 OR len(ob) = 0) THEN 1.0
 WHEN len(sh) = 0 THEN 1 - indel / (fa + fb) ELSE greatest(1 - indel / (fa + fb), 1 - (g + length(ra)) / (sl + fa), 1 - (g + length(rb)) / (sl + fb)) END AS sim FROM {name}_7)"""


@query("token_set_score", "WITH prs AS (SELECT DISTINCT x.p_name AS a, upper(y.p_type) || '.' || replace(y.p_name, ' ', '_') AS b FROM lineitem JOIN part x ON l_partkey = x.p_partkey JOIN part y ON l_suppkey = y.p_partkey), "
       + similarity_sql("prs", "res") + " SELECT a, b, round(sim, 6) AS similarity FROM res")
def token_set_score(spark, folder):
    part = table(spark, folder, "part")
    x = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a"))
    y = part.select(F.col("p_partkey").alias("l_suppkey"), F.concat(F.upper("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("b"))
    pairs = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").join(x, "l_partkey").join(y, "l_suppkey").select("a", "b").distinct()
    pairs = spread_rows(pairs)
    similarity = name_similarity(token_key(normalized_name(F.col("a"))), token_key(normalized_name(F.col("b"))))
    return pairs.select("a", "b", F.round(similarity, 6).alias("similarity"))


# Entities of a brand: types and names of its parts; candidates: the brand's columns.
ENT_SQL = """ent AS (SELECT p_brand AS scope, lower(p_type) || ' ' || p_name AS entity, min(p_partkey) AS first_key FROM part GROUP BY 1, 2)"""
DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
WEIGHTED_SQL = "WITH " + ", ".join([
    d.COLUMNS_SQL, ENT_SQL,
    "pool AS (SELECT table_name AS scope, column_name AS col, position, row_number() OVER (PARTITION BY table_name ORDER BY position) - 1 AS idx, embedding AS cv FROM cat LEFT JOIN embeddings ON vec_id = position)",
    "sco AS (SELECT p_brand AS scope, lower(p_type) || ' ' || p_name AS entity, p_size // 5 AS idx, count(*) / (count(*) + 1) AS score FROM part GROUP BY 1, 2, 3)",
    "prs AS (SELECT e.scope, e.entity, p.col, p.position, p.idx, p.cv, v.embedding AS ev, e.entity AS a, p.col AS b FROM ent e JOIN pool p ON e.scope = p.scope LEFT JOIN embeddings v ON v.vec_id = e.first_key)",
    similarity_sql("prs", "sims"),
    f"""scored AS (SELECT prs.scope, prs.entity, col, position, 0.5 * coalesce(sco.score, 0) + 0.3 * coalesce({DOT.format('ev', 'cv')} / (sqrt({DOT.format('ev', 'ev')}) * sqrt({DOT.format('cv', 'cv')})), 0) + 0.2 * sim AS score
 FROM prs JOIN sims ON prs.a = sims.a AND prs.b = sims.b LEFT JOIN sco ON sco.scope = prs.scope AND sco.entity = prs.entity AND sco.idx = prs.idx)""",
    "rnk AS (SELECT *, row_number() OVER (PARTITION BY scope, entity ORDER BY score DESC, position) AS rank FROM scored)",
]) + " "


def _part_name(prefix=True):
    return F.concat(F.lower("p_type"), F.lit(" "), "p_name")


def _weighted(spark, folder):
    part = table(spark, folder, "part")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    entities = part.groupBy(F.col("p_brand").alias("scope"), _part_name().alias("entity")).agg(
        F.min("p_partkey").alias("position")
    ).join(vectors, "position", "left")
    columns = d.columns(spark, folder).select(F.col("table_name").alias("scope"), F.col("column_name").alias("column"), "position").join(vectors, "position", "left")
    scores = part.groupBy(F.col("p_brand").alias("scope"), _part_name().alias("entity"), F.floor(F.col("p_size") / 5).alias("index")).agg(
        (F.count("*") / (F.count("*") + 1)).alias("score")
    )
    return mt.ranked_candidates(entities, mt.pools(columns), scores)


@query("weighted_match", WEIGHTED_SQL + """
SELECT scope, entity, col AS "column", round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'strong' WHEN score >= 0.4 THEN 'medium' ELSE 'weak' END AS band FROM rnk WHERE rank = 1""")
def weighted_match(spark, folder):
    best = mt.best_columns(_weighted(spark, folder))
    return best.select("scope", "entity", "column", F.round("score", 6).alias("score"), score_band(F.col("score")).alias("band"))


@query("weighted_short_list", WEIGHTED_SQL + """
SELECT scope, entity, CAST(n AS INTEGER) AS rank, col AS "column", round(score, 6) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY scope, entity ORDER BY rank) AS n FROM rnk
 WHERE (scope, col) IN (SELECT p_brand, replace(p_name, ' ', '_') FROM part WHERE p_size < 40)) WHERE n <= 3""")
def weighted_short_list(spark, folder):
    allowed = table(spark, folder, "part").filter("p_size < 40").select(F.col("p_brand").alias("scope"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("column"))
    return mt.short_list(_weighted(spark, folder), allowed).withColumn("score", F.round("score", 6))


FUZZY = {"llm": 0, "cosine": 0, "fuzzy": 100}


def _best_sql(source: str, pool: str, name: str) -> str:
    """CTE ``name`` (scope, entity, col, sim): the best column of the entity's scope."""
    return (
        f"{name}_p AS (SELECT DISTINCT e.scope, e.entity, p.col, p.position, e.entity AS a, p.col AS b FROM {source} e JOIN {pool} p ON e.scope = p.scope), "
        + similarity_sql(f"{name}_p", f"{name}_s")
        + f", {name} AS (SELECT scope, entity, col, sim FROM {name}_p p JOIN {name}_s s ON p.a = s.a AND p.b = s.b "
        "QUALIFY row_number() OVER (PARTITION BY scope, entity ORDER BY sim DESC, position) = 1)"
    )


SCHEMA_POOL = "spool AS (SELECT 'all' AS scope, coalesce(category, 'other') || '.' || name AS col, position FROM fld)"


def _schema_pool(spark, folder):
    return d.target_schema(spark, folder).select(
        F.concat(F.coalesce("category", F.lit("other")), F.lit("."), "name").alias("column"), "position", "table_name", "category"
    )


@query("single_hop", "WITH " + ", ".join([
    d.SCHEMA_SQL, SCHEMA_POOL, "ent AS (SELECT DISTINCT 'all' AS scope, p_name || ' ' || lower(p_type) AS entity FROM part)",
    _best_sql("ent", "spool", "best"),
]) + " SELECT entity, col AS \"column\", round(sim, 6) AS score FROM best")
def single_hop(spark, folder):
    entities = table(spark, folder, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("entity")).distinct()
    found = mt.resolve(entities, _schema_pool(spark, folder), None, FUZZY)
    return found.select("entity", "column", F.round("score", 6).alias("score"))


@query("two_hop", "WITH " + ", ".join([
    d.SCHEMA_SQL, SCHEMA_POOL, "ent AS (SELECT DISTINCT 'all' AS scope, p_name || ' ' || lower(p_type) AS entity FROM part)",
    "dpool AS (SELECT 'all' AS scope, 'ds_' || name AS col, -position AS position FROM fld WHERE type IS NOT NULL)",
    _best_sql("ent", "spool", "hop"), "nxt AS (SELECT DISTINCT scope, col AS entity FROM hop)", _best_sql("nxt", "dpool", "hop2"),
]) + " SELECT hop.entity, hop.col AS schema_col, hop2.col AS dataset_col FROM hop JOIN hop2 ON hop.col = hop2.entity")
def two_hop(spark, folder):
    entities = table(spark, folder, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("entity")).distinct()
    dataset = d.target_schema(spark, folder).filter(F.col("type").isNotNull()).select(
        F.concat(F.lit("ds_"), "name").alias("column"), (-F.col("position")).alias("position")
    )
    return mt.resolve_two_hop(entities, _schema_pool(spark, folder), dataset, FUZZY).select("entity", "schema_col", "dataset_col")


@query("two_hop_scoped", "WITH " + ", ".join([
    d.SCHEMA_SQL, SCHEMA_POOL, d.COLUMNS_SQL, d.ENTITIES_SQL, d.RULE_TABLES_SQL,
    "e1 AS (SELECT DISTINCT 'all' AS scope, entity FROM ent)", _best_sql("e1", "spool", "hop"),
    "own AS (SELECT rule_id, min(table_name) AS table_name FROM rtb GROUP BY 1)",
    "dec AS (SELECT coalesce(category, 'other') || '.' || name AS col, table_name FROM fld WHERE category IN ('small', 'large', 'economy'))",
    "plc AS (SELECT DISTINCT ent.rule_id, ent.entity, hop.col, coalesce(dec.table_name, own.table_name) AS scope FROM ent JOIN hop ON hop.entity = ent.entity LEFT JOIN dec ON dec.col = hop.col LEFT JOIN own ON own.rule_id = ent.rule_id)",
    "n2 AS (SELECT DISTINCT scope, col AS entity FROM plc)", "tpool AS (SELECT table_name AS scope, column_name AS col, position FROM cat)",
    _best_sql("n2", "tpool", "hop2"),
]) + " SELECT rule_id, plc.entity, plc.col AS schema_col, plc.scope AS table_name, hop2.col AS dataset_col FROM plc JOIN hop2 ON hop2.scope = plc.scope AND hop2.entity = plc.col")
def two_hop_scoped(spark, folder):
    schema = _schema_pool(spark, folder)
    declared = schema.filter(F.col("category").isin("small", "large", "economy")).select("column", "table_name")
    entities = d.entities(spark, folder).select("rule_id", "entity")
    own = d.rule_tables(spark, folder).groupBy("rule_id").agg(F.min("table_name").alias("table_name"))
    dataset = d.columns(spark, folder).select(F.col("table_name").alias("scope"), F.col("column_name").alias("column"), "position")
    found = mt.resolve_scoped(entities, schema.drop("table_name", "category"), declared, dataset, own, FUZZY)
    return found.select("rule_id", "entity", "schema_col", "table_name", "dataset_col")


# Rules of orders: every seventh names a table that does not exist, every seventh none.
SCOPES_SQL = ", ".join([
    d.COLUMNS_SQL, d.ENTITIES_SQL, d.RULE_TABLES_SQL,
    "giv AS (SELECT rule_id, CASE WHEN rule_id % 7 = 0 THEN 'ghost' ELSE table_name END AS table_name FROM rtb WHERE rule_id % 7 <> 1)",
    """sco AS (SELECT r.rule_id, CASE WHEN count(table_name) = 0 THEN '*' ELSE '["' || string_agg(DISTINCT table_name, '","' ORDER BY table_name) || '"]' END AS scope
 FROM (SELECT DISTINCT rule_id FROM ent) r LEFT JOIN (SELECT rule_id, table_name FROM giv WHERE table_name IN (SELECT table_name FROM cat)) g ON g.rule_id = r.rule_id GROUP BY 1)""",
    """stb AS (SELECT DISTINCT scope, table_name FROM sco JOIN giv USING (rule_id) WHERE scope <> '*' UNION SELECT '*', table_name FROM cat),
 rpl AS (SELECT scope, column_name AS col, min(position) AS position FROM stb JOIN cat USING (table_name) GROUP BY 1, 2)""",
])


def _rule_tables(spark, folder):
    name = F.when(F.col("rule_id") % 7 == 0, "ghost").otherwise(F.col("table_name"))
    return d.rule_tables(spark, folder).filter("rule_id % 7 <> 1").select("rule_id", name.alias("table_name"))


def _positions(spark, folder):
    return d.columns(spark, folder).select("table_name", F.col("column_name").alias("column"), "position")


@query("rule_pools", "WITH " + SCOPES_SQL + """
SELECT scope, count(*) AS n_rules, min(n) AS n_columns, min(best) AS first_column FROM sco JOIN (SELECT scope, count(*) AS n, arg_min(col, position) AS best FROM rpl GROUP BY 1) USING (scope) GROUP BY 1""")
def rule_pools(spark, folder):
    columns = _positions(spark, folder)
    scopes = mt.rule_scopes(d.entities(spark, folder), _rule_tables(spark, folder), columns)
    pool = mt.pools(mt.scope_columns(scopes, columns)).select("scope", F.size("pool").cast("bigint").alias("n_columns"), F.get("pool", F.lit(0))["column"].alias("first_column"))
    return scopes.groupBy("scope").agg(F.count("*").alias("n_rules")).join(pool, "scope")


@query("rule_pool_match", "WITH " + SCOPES_SQL + ", e1 AS (SELECT DISTINCT scope, entity FROM ent JOIN sco USING (rule_id)), " + _best_sql("e1", "rpl", "hop") + """
SELECT DISTINCT rule_id, entity, sco.scope, col AS "column", round(sim, 6) AS score FROM ent JOIN sco USING (rule_id) JOIN hop USING (scope, entity)""")
def rule_pool_match(spark, folder):
    entities = d.entities(spark, folder).select("rule_id", "entity")
    found = mt.resolve_for_rules(entities, _rule_tables(spark, folder), _positions(spark, folder), None, FUZZY)
    return found.withColumn("score", F.round("score", 6))


@query("suggested_columns", "WITH " + ", ".join([
    d.SCHEMA_SQL, d.ENTITIES_SQL, d.COLUMNS_SQL,
    "tpool AS (SELECT 'all' AS scope, name AS col, position FROM fld WHERE type IS NOT NULL)",
    "e1 AS (SELECT DISTINCT 'all' AS scope, entity FROM ent)", _best_sql("e1", "tpool", "hop"),
]) + " SELECT rule_id, pos, ent.entity, coalesce(hop.col, '') AS \"column\" FROM ent LEFT JOIN hop ON hop.entity = ent.entity")
def suggested_columns(spark, folder):
    entities = d.entities(spark, folder)
    pool = d.target_schema(spark, folder).filter(F.col("type").isNotNull()).select(F.col("name").alias("column"), "position")
    return mt.suggested_columns(entities, mt.resolve(entities.select("entity"), pool, None, FUZZY)).select("rule_id", "pos", "entity", "column")


@query("entity_extract", "WITH " + ", ".join([d.RULES_SQL, d.COLUMNS_SQL,
    "tok AS (SELECT rule_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS t FROM rul)",
    "grm AS (SELECT rule_id, CAST(i AS INTEGER) AS start, n AS n_words, array_to_string(t[i:i + n - 1], ' ') AS phrase FROM tok, (SELECT unnest([1, 2, 3, 4]) AS n) g, (SELECT unnest(range(1, 30)) AS i) s WHERE i + n - 1 <= len(t))",
    f"key AS (SELECT {_tokens(_norm('column_name'))} AS tc, min(position) AS position, arg_min(column_name, position) AS col FROM cat GROUP BY 1)",
    f"phr AS (SELECT DISTINCT phrase, {_tokens(_norm('phrase'))} AS tk FROM grm)",
    "bst AS (SELECT phrase, arg_min(col, position) AS col FROM phr, key WHERE len(tk) > 0 AND len(tc) > 0 AND list_has_all(tc, tk) GROUP BY phrase)",
    "lst AS (SELECT rule_id, list([{'start': start, 'n_words': n_words, 'phrase': phrase, 'col': col}] ORDER BY n_words DESC, start) AS hits FROM grm JOIN bst USING (phrase) GROUP BY 1)",
    """fre AS (SELECT rule_id, unnest(list_reduce(hits, lambda acc, h: CASE WHEN len(list_filter(acc, lambda k: k.start < h[1].start + h[1].n_words AND h[1].start < k.start + k.n_words)) > 0
 THEN acc ELSE list_concat(acc, h) END)) AS h FROM lst)"""]) + """
 SELECT rule_id, h.start AS start, h.n_words AS n_words, h.phrase AS phrase, h.col AS "column" FROM fre""")
def entity_extract(spark, folder):
    columns = d.columns(spark, folder).select(F.col("column_name").alias("column"), "position")
    found = mt.extract_entities(d.rules(spark, folder), "rule_id", "text", columns)
    return found.select("rule_id", "start", "n_words", "phrase", "column")


CENTROID_SQL = """cen AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1)"""


@query("cosine_topk", f"""WITH {CENTROID_SQL}, s AS (SELECT label AS query_id, vec_id, {DOT.format('v', 'embedding')} / (sqrt({DOT.format('v', 'v')}) * sqrt({DOT.format('embedding', 'embedding')})) AS c FROM cen JOIN (SELECT vec_id, embedding FROM embeddings) ON true)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(c, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    centers = rt.mean_vectors(vectors, "label", "embedding").withColumnRenamed("label", "query_id")
    top = rt.vector_topk(vectors, centers, 10, "vec_id", "embedding", metric="cosine")
    return top.select("query_id", "vec_id", "rank", F.round(-F.col("distance"), 6).alias("similarity"))


@query("vector_topk", f"""WITH {CENTROID_SQL}, s AS (SELECT label AS query_id, vec_id, list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - v[i]) * (CAST(embedding[i] AS DOUBLE) - v[i]))) AS q FROM cen JOIN (SELECT vec_id, embedding FROM embeddings) ON true)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(q, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(q, 9), vec_id) AS rank FROM s) WHERE rank <= 6""")
def vector_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    centers = rt.mean_vectors(vectors, "label", "embedding").withColumnRenamed("label", "query_id")
    return rt.vector_topk(vectors, centers, 6, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))
