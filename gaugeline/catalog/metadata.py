"""Queries over schema metadata, rules, runs and remediation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog import derived as d
from gaugeline.catalog.registry import query, table
from gaugeline.functions import text as tx
from gaugeline.operators import matching as mt
from gaugeline.operators import schema as sc
from gaugeline.operators import tables as tb
from gaugeline.operators.ranking import first_per_key, pass_rate_band
from gaugeline.plans import metrics as me
from gaugeline.plans import rules as ru

# ---- names ------------------------------------------------------------------------------


@query("name_slug", r"""
SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-zA-Z0-9_]+', '_', 'g'), '_'), ''), 'dq_rule') AS slug,
 'dq_' || coalesce(nullif(trim(regexp_replace(lower(url), '[^a-zA-Z0-9_]+', '_', 'g'), '_'), ''), 'dq_rule') AS check_name FROM pages""")
def name_slug(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"), tx.check_name(F.col("url")).alias("check_name"))


@query("name_normalise", r"""
SELECT doc_id, regexp_replace(translate(lower(text), '_.', '  '), '[^a-z0-9 ]', '', 'g') AS normalized FROM documents""")
def name_normalise(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.normalized_name(F.col("text")).alias("normalized"))


@query("name_sanitize", r"""
SELECT doc_id, regexp_replace(text, '[.\s]+', '_', 'g') AS safe, regexp_replace(source || ' ' || lang, '[^a-zA-Z0-9_]', '_', 'g') AS variable FROM documents""")
def name_sanitize(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", tx.sanitized_name(F.col("text")).alias("safe"), tx.variable_name(F.concat_ws(" ", "source", "lang")).alias("variable")
    )


@query("json_safe", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round(l_discount / l_tax, 6) END AS ratio,
 strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS shipped,
 TRY_CAST(CASE WHEN l_returnflag = 'N' THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS DOUBLE) AS quantity FROM lineitem""")
def json_safe(spark, folder):
    # 0 / 0 is NaN and x / 0 infinite, as in a file written by a numeric library.
    discount, tax = F.col("l_discount"), F.col("l_tax")
    ratio = F.when(tax != 0, discount / tax).when(discount == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    words = F.when(F.col("l_returnflag") == "N", "n/a").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(tx.json_safe_number(ratio), 6).alias("ratio"),
        tx.json_safe_time(F.col("l_shipdate")).alias("shipped"), tx.to_number(words).alias("quantity"),
    )


@query("run_time_parse", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'""")
def run_time_parse(spark, folder):
    written = F.when(F.col("event_type") == "error", "no time").otherwise(F.date_format("ts", tx.RUN_TIME_FORMAT))
    events = table(spark, folder, "events").select("event_id", written.alias("text"))
    return events.select("event_id", F.date_format(tx.run_time(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


# ---- schema -----------------------------------------------------------------------------


@query("schema_infer_checks", d.with_(d.SCHEMA_SQL) + """
SELECT name, unnest(list_filter(['not_null', CASE WHEN type IN ('int', 'double') THEN 'range' END, CASE WHEN coalesce(type, 'string') = 'string' THEN 'length' END,
 CASE WHEN coalesce(type, 'string') = 'string' THEN 'regex' END, CASE WHEN type = 'date' THEN 'comparison' END,
 CASE WHEN contains(name, 'id') THEN 'uniqueness' END], lambda x: x IS NOT NULL)) AS check_type FROM fld""")
def schema_infer_checks(spark, folder):
    fields = sc.parse_fields(d.target_schema(spark, folder))
    return sc.with_inferred_checks(fields).select("name", "check_type")


@query("schema_fields", d.with_(d.SCHEMA_SQL) + "SELECT name, coalesce(type, 'string') AS type, coalesce(category, 'general') AS category FROM fld")
def schema_fields(spark, folder):
    return sc.parse_fields(d.target_schema(spark, folder)).select("name", "type", "category")


@query("schema_suggest", d.with_(d.COLUMNS_SQL) + "SELECT column_name AS name, 'string' AS type, table_name AS category FROM cat")
def schema_suggest(spark, folder):
    return sc.suggested_schema(d.columns(spark, folder), single_table=False)


@query("schema_by_type", d.with_(d.SCHEMA_SQL) + "SELECT type, CAST(count(*) AS BIGINT) AS n_columns FROM fld WHERE type IS NOT NULL GROUP BY type")
def schema_by_type(spark, folder):
    return sc.counts_by(d.target_schema(spark, folder), "type")


@query("schema_by_category", d.with_(d.SCHEMA_SQL) + "SELECT category, CAST(count(*) AS BIGINT) AS n_columns FROM fld WHERE category IS NOT NULL GROUP BY category")
def schema_by_category(spark, folder):
    return sc.counts_by(d.target_schema(spark, folder), "category")


@query("schema_of_type", d.with_(d.SCHEMA_SQL) + "SELECT name, category, table_name FROM fld WHERE lower(type) = 'string' AND category <> 'general'")
def schema_of_type(spark, folder):
    """Q10: schema columns of one type outside one category."""
    fields = d.target_schema(spark, folder)
    return fields.filter((F.lower("type") == "string") & (F.col("category") != "general")).select("name", "category", "table_name")


@query("schema_reference", d.with_(d.SCHEMA_SQL) + """
SELECT table_name, category, line_no, line FROM (
 SELECT table_name, coalesce(category, 'other') AS category, CAST(row_number() OVER (PARTITION BY table_name, category ORDER BY position) AS INTEGER) AS line_no,
  '  - ' || name || '  [type: ' || coalesce(type, 'string') || ']' AS line FROM fld
 UNION ALL SELECT DISTINCT table_name, coalesce(category, 'other'), 0, '## Category: ' || upper(coalesce(category, 'other')) FROM fld)""")
def schema_reference(spark, folder):
    return sc.reference_lines(d.target_schema(spark, folder), multi_table=True)


@query("schema_batches", d.with_(d.SCHEMA_SQL) + """
SELECT (n - 1) // 15 + 1 AS batch, min(n) AS first_column, max(n) AS last_column, string_agg(name, ', ' ORDER BY n) AS names
FROM (SELECT name, row_number() OVER (ORDER BY position) AS n FROM fld) GROUP BY 1""")
def schema_batches(spark, folder):
    from gaugeline.operators.ranking import global_position

    numbered = global_position(d.target_schema(spark, folder).select("name", "position"), ["position"], name="n")
    return sc.batches(numbered, "n", "name", sc.SCHEMA_BATCH)


@query("schema_table_lines", d.with_(d.COLUMNS_SQL) + """
SELECT table_name, (n - 1) // 20 AS line_no, '[' || table_name || ']: ' || string_agg(column_name, ', ' ORDER BY n) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY position) AS n FROM cat) GROUP BY table_name, (n - 1) // 20""")
def schema_table_lines(spark, folder):
    return sc.table_lines(d.columns(spark, folder))


@query("table_column_counts", d.with_(d.COLUMNS_SQL) + "SELECT table_name, CAST(count(*) AS BIGINT) AS column_count FROM cat GROUP BY table_name")
def table_column_counts(spark, folder):
    return me.table_columns(d.columns(spark, folder))


TYPES_SQL = d.with_(d.SCHEMA_SQL, d.MAPPING_SQL, d.S2D_SQL, """typ AS (
 SELECT col AS "column", type, category, schema_col FROM (
  SELECT dataset_col AS col, type, category, schema_col, 1 AS src, -pos AS o FROM s2d JOIN fld ON name = schema_col WHERE dataset_col <> schema_col
  UNION ALL SELECT dataset_col, type, category, s2d.schema_col, 2, map_pos FROM s2d JOIN fld ON name = schema_col JOIN map ON map.schema_col = s2d.schema_col WHERE dataset_col IS NOT NULL
  UNION ALL SELECT schema_col, type, category, schema_col, 3, map_pos FROM map JOIN fld ON name = schema_col)
 QUALIFY row_number() OVER (PARTITION BY col ORDER BY src, o) = 1)""")


@query("column_type_map", TYPES_SQL + "SELECT * FROM typ")
def column_type_map(spark, folder):
    return sc.column_types(d.mapping(spark, folder), d.schema_to_dataset(spark, folder), d.target_schema(spark, folder))


@query("column_inferred_type", TYPES_SQL + """
SELECT cols."column", coalesce(typ.type, fld.type) AS type,
 CASE WHEN typ.type IS NOT NULL THEN 'mapped' WHEN fld.type IS NOT NULL THEN 'schema' ELSE 'unmapped' END AS source
FROM (SELECT DISTINCT 'ds_' || replace(p_name, ' ', '_') AS "column" FROM part UNION SELECT DISTINCT replace(p_name, ' ', '_') FROM part) cols
LEFT JOIN typ ON typ."column" = cols."column" LEFT JOIN fld ON fld.name = cols."column" """)
def column_inferred_type(spark, folder):
    types = column_type_map(spark, folder)
    names = d.target_schema(spark, folder).select(F.explode(F.array(F.concat(F.lit("ds_"), "name"), "name")).alias("column")).distinct()
    return sc.inferred_type(names, types, d.target_schema(spark, folder))


@query("mapping_lookup", d.with_(d.SCHEMA_SQL, d.MAPPING_SQL, d.S2D_SQL) + """
SELECT entity, map.schema_col, coalesce(dataset_col, map.schema_col) AS dataset_col FROM map LEFT JOIN s2d ON map.schema_col = s2d.schema_col""")
def mapping_lookup(spark, folder):
    """Q13: entity to schema column to dataset column, the schema column standing in where unmapped."""
    s2d = d.schema_to_dataset(spark, folder).select("schema_col", "dataset_col")
    return d.mapping(spark, folder).join(s2d, "schema_col", "left").select("entity", "schema_col", F.coalesce("dataset_col", "schema_col").alias("dataset_col"))


@query("choosable_columns", d.with_(d.SCHEMA_SQL, d.S2D_SQL, d.COLUMNS_SQL) + """
SELECT 'schema' AS source, schema_col AS "column" FROM s2d WHERE dataset_col IS NOT NULL
UNION ALL SELECT 'dataset', * FROM (SELECT DISTINCT column_name FROM cat)""")
def choosable_columns(spark, folder):
    with_schema = mt.choosable_columns(d.schema_to_dataset(spark, folder), None)
    without = mt.choosable_columns(None, d.columns(spark, folder).select(F.col("column_name").alias("column")))
    return with_schema.select(F.lit("schema").alias("source"), "column").unionByName(without.select(F.lit("dataset").alias("source"), "column"))


# ---- rules, tables and mappings -----------------------------------------------------------


@query("rule_columns_fallback", d.with_(d.SCHEMA_SQL, d.MAPPING_SQL, d.RULES_SQL, d.ENTITIES_SQL, """
m1 AS (SELECT rule_id, schema_col, pos FROM ent JOIN map USING (entity)),
m2 AS (SELECT rule_id, schema_col, map_pos AS pos FROM rul, map WHERE rule_id NOT IN (SELECT rule_id FROM m1)
 AND (contains(lower(text), entity) OR contains(lower(text), schema_col))),
m3 AS (SELECT rule_id, schema_col, map_pos AS pos FROM rul, map WHERE rule_id NOT IN (SELECT rule_id FROM m1) AND rule_id NOT IN (SELECT rule_id FROM m2)),
used AS (SELECT name FROM fld WHERE category IS NOT NULL)""") + """
SELECT rule_id, schema_col AS "column", CAST(min(pos) AS BIGINT) AS pos FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)
WHERE schema_col IN (SELECT name FROM used) GROUP BY 1, 2""")
def rule_columns_fallback(spark, folder):
    mapping = d.mapping(spark, folder).withColumnRenamed("schema_col", "column")
    available = d.target_schema(spark, folder).filter(F.col("category").isNotNull()).select(F.col("name").alias("column"))
    return sc.rule_columns(d.rules(spark, folder).select("rule_id", "text"), d.entities(spark, folder), mapping, available)


@query("join_keys", d.with_(d.COLUMNS_SQL) + """
SELECT a.table_name AS left_table, b.table_name AS right_table, string_agg(a.column_name, ',' ORDER BY a.column_name) AS shared
FROM cat a JOIN cat b ON a.column_name = b.column_name AND a.table_name < b.table_name GROUP BY 1, 2""")
def join_keys(spark, folder):
    return tb.join_keys(d.columns(spark, folder)).withColumn("shared", F.array_join("shared", ","))


@query("touched_tables", d.with_(d.SCHEMA_SQL, d.MAPPING_SQL, d.S2D_SQL, d.COLUMNS_SQL, d.ENTITIES_SQL, """
ftb AS (SELECT column_name, arg_min(table_name, table_pos) AS table_name FROM cat GROUP BY 1),
need AS (SELECT DISTINCT rule_id, schema_col FROM ent JOIN map USING (entity))""") + """
SELECT rule_id, need.schema_col, coalesce(a.table_name, b.table_name) AS table_name FROM need LEFT JOIN s2d USING (schema_col)
LEFT JOIN ftb a ON a.column_name = coalesce(dataset_col, need.schema_col) LEFT JOIN ftb b ON b.column_name = need.schema_col""")
def touched_tables(spark, folder):
    needed = d.entities(spark, folder).join(d.mapping(spark, folder), "entity").select("rule_id", "schema_col").distinct()
    return tb.tables_of_columns(needed, d.columns(spark, folder), d.schema_to_dataset(spark, folder).select("schema_col", "dataset_col"))


@query("touched_by_prefix", d.with_(d.RULES_SQL, """nam AS (
 SELECT l_orderkey AS rule_id, CASE WHEN l_returnflag = 'A' THEN p_brand || '.' || p_name WHEN l_returnflag = 'N' THEN 'Rep.' || p_name ELSE p_name END AS mapped
 FROM lineitem JOIN part ON l_partkey = p_partkey), ok AS (SELECT DISTINCT rule_id, split_part(mapped, '.', 1) AS table_name FROM nam
 WHERE contains(mapped, '.') AND split_part(mapped, '.', 1) IN (SELECT p_brand FROM part))""") + """
SELECT * FROM ok UNION ALL SELECT DISTINCT rule_id, (SELECT arg_min(p_brand, p_partkey) FROM part) FROM nam WHERE rule_id NOT IN (SELECT rule_id FROM ok)""")
def touched_by_prefix(spark, folder):
    part = table(spark, folder, "part")
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    flag = F.col("l_returnflag")
    mapped = F.when(flag == "A", F.concat_ws(".", "p_brand", "p_name")).when(flag == "N", F.concat(F.lit("Rep."), "p_name")).otherwise(F.col("p_name"))
    names = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("rule_id"), mapped.alias("mapped"))
    first = part.agg(F.min_by("p_brand", "p_partkey")).scalar()
    return tb.tables_of_qualified(names, part.select(F.col("p_brand").alias("table_name")), first)


INVOLVED_SQL = d.with_(d.RULES_SQL, d.RULE_TABLES_SQL, """
giv AS (SELECT rule_id, table_name FROM rtb WHERE rule_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')),
sto AS (SELECT rule_id, table_name FROM rtb WHERE table_name IN (SELECT p_brand FROM part WHERE p_brand <> 'Brand#13') AND rule_id NOT IN (SELECT rule_id FROM giv)),
inv AS (SELECT * FROM giv UNION ALL SELECT * FROM sto UNION ALL
 SELECT rule_id, t FROM rul, (SELECT DISTINCT p_brand AS t FROM part WHERE p_brand <> 'Brand#13') WHERE rule_id NOT IN (SELECT rule_id FROM giv) AND rule_id NOT IN (SELECT rule_id FROM sto))""")


def _involved(spark, folder):
    pairs = d.rule_tables(spark, folder)
    urgent = table(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("rule_id"))
    given = pairs.join(urgent, "rule_id", "left_semi")
    # Every brand but one is a table that still exists.
    known = table(spark, folder, "part").filter("p_brand <> 'Brand#13'").select(F.col("p_brand").alias("table_name"))
    return tb.involved_tables(d.rules(spark, folder), given, pairs, known)


@query("involved_tables", INVOLVED_SQL + "SELECT * FROM inv")
def involved_tables(spark, folder):
    return _involved(spark, folder)


@query("rules_by_table", INVOLVED_SQL + "SELECT lower(table_name) AS table_name, CAST(count(DISTINCT rule_name) AS BIGINT) AS n_rules FROM inv JOIN rul USING (rule_id) GROUP BY 1")
def rules_by_table(spark, folder):
    named = _involved(spark, folder).join(d.rules(spark, folder).select("rule_id", "rule_name"), "rule_id")
    return me.rules_per_table(named)


@query("rules_of_table", d.with_(d.RULES_SQL, d.RULE_TABLES_SQL) + "SELECT DISTINCT rule_name FROM rtb JOIN rul USING (rule_id) WHERE lower(table_name) = 'brand#3'")
def rules_of_table(spark, folder):
    named = d.rule_tables(spark, folder).join(d.rules(spark, folder).select("rule_id", "rule_name"), "rule_id")
    return me.rules_of_table(named, "BRAND#3")


@query("tables_of_rule", d.with_(d.RULES_SQL, d.RULE_TABLES_SQL) + """
SELECT DISTINCT table_name FROM rtb JOIN (SELECT *, row_number() OVER (ORDER BY rule_id) AS n FROM rul) USING (rule_id) WHERE n = 3""")
def tables_of_rule(spark, folder):
    rules = me.indexed_rules(d.rules(spark, folder).select("rule_id", "rule_name"), "rule_id")
    named = d.rule_tables(spark, folder).join(rules, "rule_id")
    return me.tables_of_rule(rules, named, 3)


@query("rules_by_category", d.with_(d.RULES_SQL) + """
SELECT category, n_rules, CAST(rank AS INTEGER) AS rank, rule_name FROM (
 SELECT category, rule_name, CAST(count(*) OVER (PARTITION BY category) AS BIGINT) AS n_rules, row_number() OVER (PARTITION BY category ORDER BY rule_id) AS rank FROM rul)""")
def rules_by_category(spark, folder):
    return me.rules_by_category(d.rules(spark, folder).withColumn("rule_index", F.col("rule_id")))


@query("rules_append", """
SELECT o_orderkey AS rule_id, o_orderstatus AS status, NULL AS segment FROM orders
UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer""")
def rules_append(spark, folder):
    existing = table(spark, folder, "orders").select(F.col("o_orderkey").alias("rule_id"), F.col("o_orderstatus").alias("status"))
    new = table(spark, folder, "customer").select(F.col("c_custkey").alias("rule_id"), F.col("c_mktsegment").alias("segment"))
    return ru.append_rules(existing, new)


@query("rules_upsert", """
SELECT arg_max(name, version) AS name, max(version) AS version, arg_max(body, version) AS body, slug FROM (
 SELECT p_name AS name, p_partkey AS version, p_type AS body, replace(p_name, ' ', '_') AS slug FROM part
 UNION ALL SELECT upper(p_name) || '!', 1000000000 + p_partkey, 'new ' || p_type, replace(p_name, ' ', '_') FROM part WHERE p_size > 48) GROUP BY slug""")
def rules_upsert(spark, folder):
    part = table(spark, folder, "part")
    registry = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("version"), F.col("p_type").alias("body"))
    changes = part.filter("p_size > 48").select(
        F.concat(F.upper("p_name"), F.lit("!")).alias("name"), (F.col("p_partkey") + 1000000000).alias("version"),
        F.concat(F.lit("new "), "p_type").alias("body"),
    )
    return ru.upsert_checks(registry, changes)


@query("rules_new_only", r"""
SELECT doc_id, text FROM documents WHERE trim(regexp_replace(lower(text), '\s+', ' ', 'g')) NOT IN
 (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) FROM documents WHERE lang = 'en')""")
def rules_new_only(spark, folder):
    documents = table(spark, folder, "documents")
    return ru.new_rules_only(documents.select("doc_id", "text"), documents.filter(F.col("lang") == "en"), "text")


@query("rule_classify", """
SELECT o_orderkey, CASE WHEN guarded THEN 'complex' WHEN n > 1 OR kind IN ('range', 'regex') THEN 'medium' ELSE 'simple' END AS complexity,
 CASE WHEN guarded THEN 'business_logic' WHEN kind = 'not_null' THEN 'completeness' WHEN kind = 'uniqueness' THEN 'accuracy'
  WHEN kind = 'comparison' AND n > 1 THEN 'consistency' ELSE 'validity' END AS category
FROM (SELECT o_orderkey, o_totalprice > 400000 AS guarded, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS n,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'not_null' WHEN '2-HIGH' THEN 'uniqueness' WHEN '3-MEDIUM' THEN 'comparison' WHEN '5-LOW' THEN 'range' ELSE 'length' END AS kind FROM orders)""")
def rule_classify(spark, folder):
    priority = F.col("o_orderpriority")
    kind = F.when(priority == "1-URGENT", "not_null").when(priority == "2-HIGH", "uniqueness").when(priority == "3-MEDIUM", "comparison").when(priority == "5-LOW", "range").otherwise("length")
    guard = F.when(F.col("o_totalprice") > 400000, F.lit('{"guard": {"check_type": "range"}}')).otherwise(F.lit("{}"))
    rows = table(spark, folder, "orders").select(
        "o_orderkey", kind.alias("check_type"), guard.alias("params"), F.lit(None).cast("string").alias("complexity"), F.lit(None).cast("string").alias("category"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("columns"),
    )
    return ru.with_classes(rows).select("o_orderkey", "complexity", "category")


@query("override_map", d.with_(d.SCHEMA_SQL, d.MAPPING_SQL) + """
SELECT coalesce(map.entity, e.entity) AS entity, coalesce(e.col, map.schema_col) AS "column" FROM map FULL JOIN
 (SELECT p_name AS entity, 'edited_' || min(p_partkey) AS col FROM part WHERE p_size > 47 GROUP BY 1) e ON map.entity = e.entity""")
def override_map(spark, folder):
    edited = table(spark, folder, "part").filter("p_size > 47").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    arrays = edited.select(F.array("p_name").alias("entities"), F.array(F.concat(F.lit("edited_"), F.col("k").cast("string")), F.lit("spare")).alias("columns"))
    current = d.mapping(spark, folder).select("entity", F.col("schema_col").alias("column"))
    return mt.override_mapping(current, mt.zip_edits(arrays))


@query("fill_unmapped", d.with_(d.SCHEMA_SQL, d.S2D_SQL) + """
SELECT schema_col, coalesce(dataset_col, CASE WHEN type = 'int' THEN 'col_' || name ELSE name END) AS dataset_col FROM s2d JOIN fld ON name = schema_col""")
def fill_unmapped(spark, folder):
    s2d = d.schema_to_dataset(spark, folder)
    mapped = s2d.filter(F.col("dataset_col").isNotNull())
    matches = d.target_schema(spark, folder).filter(F.col("type") == "int").select(
        F.col("name").alias("schema_col"), F.concat(F.lit("col_"), "name").alias("dataset_col")
    )
    return mt.fill_unmapped(s2d.select("schema_col"), mapped, matches)


# ---- runs and remediation logs --------------------------------------------------------------

RUNS = d.with_(d.RUNS_SQL, d.LATEST_SQL)
LOG = d.with_(d.RUNS_SQL, d.LATEST_SQL, d.RUN_RULES_SQL, d.COMPILED_SQL)
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def _ts(name="ts"):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")


@query("run_log", LOG + f"""
SELECT rule_index, lat.rule_name, category, complexity, passed_count, failed_count, round(pass_rate, 6) AS pass_rate, {TS} AS ts,
 check_type IS NOT NULL AS has_code, coalesce(check_type, '') AS check_type
FROM lat JOIN rru ON lat.rule_name = rru.rule_name LEFT JOIN cmp ON cmp.rule_name = lat.rule_name""")
def run_log(spark, folder):
    rules = me.indexed_rules(d.run_rules(spark, folder), "first_seen")
    log = me.run_log(rules, d.runs(spark, folder), d.compiled(spark, folder))
    return log.withColumn("ts", _ts()).withColumn("pass_rate", F.round("pass_rate", 6))


@query("run_latest", RUNS + f"SELECT rule_name, passed_count, failed_count, {TS} AS ts, round(pass_rate, 6) AS pass_rate, CASE WHEN pass_rate >= 0.9 THEN 'good' WHEN pass_rate >= 0.7 THEN 'fair' ELSE 'poor' END AS band FROM lat")
def run_latest(spark, folder):
    return me.latest_runs(d.runs(spark, folder)).select(
        "rule_name", "passed_count", "failed_count", _ts(), F.round("pass_rate", 6).alias("pass_rate"), pass_rate_band(F.col("pass_rate")).alias("band")
    )


@query("run_ids", RUNS + f"""SELECT 'RUN-' || CASE WHEN length(CAST(n AS VARCHAR)) < 4 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS run_id, rule_name, {TS} AS ts
FROM (SELECT *, row_number() OVER (ORDER BY ts, rule_name) AS n FROM run WHERE error IS NULL)""")
def run_ids(spark, folder):
    history = me.run_history(d.runs(spark, folder)).orderBy(F.col("run_number").desc())
    return history.select("run_id", "rule_name", _ts())


@query("run_average", RUNS + "SELECT CAST(count(*) AS BIGINT) AS rules_executed, round(avg(pass_rate), 4) AS avg_pass_rate FROM lat")
def run_average(spark, folder):
    return me.average_pass_rate(d.runs(spark, folder))


@query("run_filter", RUNS + f"""SELECT 'after' AS question, rule_name, {TS} AS ts FROM run WHERE ts > TIMESTAMP '2024-01-25 15:00:00'
UNION ALL SELECT 'before', rule_name, {TS} FROM run WHERE ts < TIMESTAMP '2024-01-02 15:00:00'
UNION ALL SELECT 'on', rule_name, {TS} FROM run WHERE CAST(ts AS DATE) = DATE '2024-01-15'""")
def run_filter(spark, folder):
    runs = d.runs(spark, folder)
    after = me.runs_between(runs, after=F.lit("2024-01-25 15:00:00").cast("timestamp_ntz"))
    before = me.runs_between(runs, before=F.lit("2024-01-02 15:00:00").cast("timestamp_ntz"))
    on = me.runs_on(runs, F.lit("2024-01-15"))
    parts = [df.select(F.lit(q).alias("question"), "rule_name", _ts()) for q, df in (("after", after), ("before", before), ("on", on))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("run_recent", RUNS + f"SELECT rule_name, {TS} AS ts FROM run ORDER BY run.ts DESC, rule_name LIMIT 1")
def run_recent(spark, folder):
    return me.most_recent_run(d.runs(spark, folder)).select("rule_name", _ts())


@query("run_order", RUNS + "SELECT rule_name, row_number() OVER (ORDER BY ts, rule_name) AS place FROM lat")
def run_order(spark, folder):
    return me.execution_order(d.runs(spark, folder)).select("rule_name", "place")


@query("run_extremes", RUNS + """SELECT arg_min(rule_name, (-failed_count, rule_name)) AS most_failures, max(failed_count) AS failed_count,
 arg_min(rule_name, (pass_rate, rule_name)) AS worst_rate, min(pass_rate) AS pass_rate FROM lat""")
def run_extremes(spark, folder):
    return me.extreme_rules(me.latest_runs(d.runs(spark, folder)))


@query("run_rank", RUNS + "SELECT rule_name, round(pass_rate, 6) AS pass_rate, rank() OVER (ORDER BY pass_rate DESC) AS rank FROM lat")
def run_rank(spark, folder):
    ranked = me.ranked_rules(me.latest_runs(d.runs(spark, folder)).select("rule_name", "pass_rate"))
    return ranked.select("rule_name", F.round("pass_rate", 6).alias("pass_rate"), "rank")


@query("run_diff", RUNS + """SELECT CAST(a.failed_count - b.failed_count AS BIGINT) AS failed_difference, round(a.pass_rate - b.pass_rate, 6) AS rate_difference
FROM lat a, lat b WHERE a.rule_name = 'click of user 1' AND b.rule_name = 'view of user 1'""")
def run_diff(spark, folder):
    diff = me.rule_difference(me.latest_runs(d.runs(spark, folder)), "click of user 1", "view of user 1")
    return diff.select("failed_difference", F.round("rate_difference", 6).alias("rate_difference"))


@query("run_below", LOG + """SELECT lat.rule_name, category, complexity, failed_count, round(pass_rate, 6) AS pass_rate FROM lat JOIN rru ON lat.rule_name = rru.rule_name
WHERE pass_rate < 0.8 AND failed_count > 0 AND category = 'purchase' AND complexity = 'complex'""")
def run_below(spark, folder):
    """Q7: executed rules below a rate, with failures, in one category and complexity."""
    log = me.run_log(d.run_rules(spark, folder).withColumn("rule_index", F.col("first_seen")), d.runs(spark, folder), d.compiled(spark, folder))
    chosen = log.filter((F.col("pass_rate") < 0.8) & (F.col("failed_count") > 0) & (F.col("category") == "purchase") & (F.col("complexity") == "complex"))
    return chosen.select("rule_name", "category", "complexity", "failed_count", F.round("pass_rate", 6).alias("pass_rate"))


@query("run_failed_total", RUNS + "SELECT CAST(sum(failed_count) AS BIGINT) AS total_failed FROM lat")
def run_failed_total(spark, folder):
    return me.failed_total(me.latest_runs(d.runs(spark, folder)))


@query("rule_compiled", LOG + "SELECT rru.rule_name, check_type IS NOT NULL AS has_code, coalesce(check_type, '') AS check_type, coalesce(id_column, '') AS id_column FROM rru LEFT JOIN cmp ON rru.rule_name = cmp.rule_name")
def rule_compiled(spark, folder):
    return me.compiled_status(d.run_rules(spark, folder), d.compiled(spark, folder))


def _remediations(spark, folder):
    """Each failing run was repaired: its failed rows are the rows affected."""
    return d.runs(spark, folder).filter("failed_count > 0").select(
        "rule_name", F.col("failed_count").alias("rows_affected"), F.least(F.col("failed_count"), F.lit(100)).alias("n_ids"), "ts"
    )


@query("remediation_totals", d.with_(d.RUNS_SQL) + """SELECT CAST(count(*) AS BIGINT) AS total_actions, CAST(sum(failed_count) AS BIGINT) AS total_rows_fixed,
 CAST(sum(least(failed_count, 100)) AS BIGINT) AS total_ids FROM run WHERE failed_count > 0""")
def remediation_totals(spark, folder):
    return me.remediation_totals(_remediations(spark, folder))


@query("remediation_history", d.with_(d.RUNS_SQL) + f"""SELECT row_number() OVER (ORDER BY run.ts, rule_name) AS action, rule_name, failed_count AS rows_affected, {TS} AS ts FROM run WHERE failed_count > 0""")
def remediation_history(spark, folder):
    return me.remediation_history(_remediations(spark, folder)).select("action", "rule_name", "rows_affected", _ts())


@query("dashboard", d.with_(d.RUNS_SQL, d.LATEST_SQL, d.RUN_RULES_SQL, d.COLUMNS_SQL, d.SCHEMA_SQL, d.MAPPING_SQL) + """
SELECT (SELECT count(DISTINCT table_name) FROM cat) AS total_tables, (SELECT count(*) FROM cat) AS total_columns, (SELECT count(*) FROM rru) AS total_rules,
 (SELECT count(*) FROM map) AS mapped_entities, (SELECT count(*) FROM lat) AS executed_rules, (SELECT round(avg(pass_rate), 4) FROM lat) AS avg_pass_rate""")
def dashboard(spark, folder):
    columns = d.columns(spark, folder)
    return me.dashboard(columns, columns, d.run_rules(spark, folder), d.mapping(spark, folder), d.runs(spark, folder))


@query("distinct_sources", """
SELECT key, lang, source, snippet FROM (SELECT coalesce(nullif(source, 'src0'), lang, 'text') AS key, lang, source, substr(text, 1, 100) || '…' AS snippet,
 row_number() OVER (PARTITION BY coalesce(nullif(source, 'src0'), lang, 'text') ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def distinct_sources(spark, folder):
    """The first document of each source key with a snippet."""
    documents = table(spark, folder, "documents").select(
        F.coalesce(F.nullif("source", F.lit("src0")), "lang", F.lit("text")).alias("key"), "doc_id", "lang", "source",
        F.concat(F.substring("text", 1, 100), F.lit("…")).alias("snippet"),
    )
    return first_per_key(documents, ["key"], ["doc_id"]).select("key", "lang", "source", "snippet")
