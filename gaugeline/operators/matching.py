"""Matching rule entities to columns by weighted name similarity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.similarity import dot, pool_similarities, token_key, unit
from gaugeline.functions.text import normalized_name, words
from gaugeline.operators.ranking import first_per_key, top_per_group
from gaugeline.operators.skew import spread_join, spread_rows
from gaugeline.session import settle

# Weights of the external, vector and name scores, in percent.
DEFAULT_WEIGHTS = {"llm": 50, "cosine": 30, "fuzzy": 20}
SHORT_LIST = 3
MAX_PHRASE_WORDS = 4
#: The scope of all tables; no set of tables is written so.
ALL_TABLES = "*"


def pools(columns: DataFrame) -> DataFrame:
    """The candidate columns of each scope packed into one array, in column order.

    ``columns`` has (position, column) and may have ``scope`` and ``vector``; without a scope
    there is one pool for all entities. The array is as long as a table is wide; the rows of
    the table itself never enter it.
    """
    scope = ["scope"] if "scope" in columns.columns else []
    vector = F.col("vector") if "vector" in columns.columns else F.lit(None).cast("array<float>")
    distinct = columns.groupBy(*scope, "column").agg(
        F.min("position").alias("position"), F.min_by(vector, "position").alias("vector")
    ).withColumn("vector", unit(F.col("vector")))
    key = token_key(normalized_name(F.col("column"))).alias("key")
    ordered = F.array_sort(F.collect_list(F.struct("position", "column", key, "vector")))
    return distinct.groupBy(*scope).agg(ordered.alias("pool"))


def score_maps(scores: DataFrame) -> DataFrame:
    """M3, sparse form: (scope, entity, index, score) rows to one map per entity; the last
    score of an index wins and a missing index counts 0."""
    one = scores.groupBy("scope", "entity", "index").agg(F.max("score").alias("score"))
    return one.groupBy("scope", "entity").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("index").cast("int"), F.col("score").cast("double")))).alias("scores")
    )


def dense_scores(rows: DataFrame) -> DataFrame:
    """M3, dense form: an array with one score per pool column, as (scope, entity, index, score) rows."""
    return rows.select("scope", "entity", F.posexplode("scores").alias("index", "score"))


def ranked_candidates(entities: DataFrame, pool: DataFrame, scores: DataFrame | None = None, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Each distinct (scope, entity) with all columns of its scope, best first.

    Scores are computed inside the row against the packed pool: no pair rows are made or
    shuffled. Equal scores keep column order.
    """
    if "scope" not in entities.columns:
        entities = entities.withColumn("scope", F.lit(""))
    has_vector = "vector" in entities.columns
    vector = F.first("vector", ignorenulls=True) if has_vector else F.first(F.lit(None).cast("array<float>"))
    distinct = entities.filter(F.coalesce(F.col("entity"), F.lit("")) != "").groupBy("scope", "entity").agg(vector.alias("vector"))
    named = spread_rows(distinct).withColumn("vector", unit(F.col("vector")))
    if scores is None:
        named = named.withColumn("scores", F.lit(None).cast("map<int,double>"))
    else:
        named = named.join(score_maps(scores), ["scope", "entity"], "left")
    keys = F.transform("pool", lambda c: c["key"])
    pooled = named.join(pool, "scope") if "scope" in pool.columns else named.withColumn("pool", pool.select("pool").scalar())
    compared = pooled.withColumn(
        "names", pool_similarities(token_key(normalized_name(F.col("entity"))), keys)
    )

    def candidate(column: Column, index: Column) -> Column:
        external = F.coalesce(F.try_element_at("scores", index.cast("int")), F.lit(0.0))
        near = F.coalesce(dot(F.col("vector"), column["vector"]), F.lit(0.0))
        score = (
            F.lit(weights["llm"] / 100) * external
            + F.lit(weights["cosine"] / 100) * near
            + F.lit(weights["fuzzy"] / 100) * F.get("names", index)
        )
        return F.struct((-score).alias("negative"), index.alias("place"), column["column"].alias("column"))

    ordered = F.transform(F.array_sort(F.transform("pool", candidate)), lambda s: F.struct(s["column"].alias("column"), (-s["negative"]).alias("score")))
    return compared.select("scope", "entity", ordered.alias("ranked"))


def best_columns(ranked: DataFrame) -> DataFrame:
    """(scope, entity, column, score) of the best candidate."""
    best = F.get("ranked", F.lit(0))
    return ranked.select("scope", "entity", best["column"].alias("column"), best["score"].alias("score")).filter(
        F.col("column").isNotNull()
    )


def short_list(ranked: DataFrame, allowed: DataFrame | None = None, k: int = SHORT_LIST) -> DataFrame:
    """The first k candidates of an entity that the allowed list (scope, column) holds."""
    rows = ranked.select("scope", "entity", F.posexplode("ranked").alias("place", "candidate")).select(
        "scope", "entity", "place", "candidate.column", "candidate.score"
    )
    once = first_per_key(rows, ["scope", "entity", "column"], ["place"])
    if allowed is not None:
        once = once.join(allowed.select("scope", "column").distinct(), ["scope", "column"], "left_semi")
    return top_per_group(once, ["scope", "entity"], [F.col("place")], k).select("scope", "entity", "rank", "column", "score")


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entity to schema column to dataset column; entities without a second hop are dropped.

    ``first`` has (scope, entity, column, score); ``second`` (scope, entity, column, score)
    where its entity is the schema column.
    """
    hop1 = first.select("scope", "entity", F.col("column").alias("schema_col"), F.col("score").alias("schema_score"))
    hop2 = second.select("scope", F.col("entity").alias("schema_col"), F.col("column").alias("dataset_col"), F.col("score").alias("dataset_score"))
    return hop1.join(hop2, ["scope", "schema_col"])


def resolve(entities: DataFrame, columns: DataFrame, scores: DataFrame | None = None, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """M5: entity to dataset column in one hop, within each scope."""
    return best_columns(ranked_candidates(entities, pools(columns), scores, weights))


def resolve_two_hop(entities: DataFrame, schema_columns: DataFrame, dataset_columns: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """M6: entity to schema column, then each schema column in use to a dataset column."""
    first = resolve(entities, schema_columns, None, weights)
    needed = first.select("scope", F.col("column").alias("entity")).distinct()
    second = resolve(needed, dataset_columns, None, weights)
    return two_hops(first, second)


def rule_scopes(rules: DataFrame, rule_tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(rule_id, scope, tables): the set of known tables a rule involves, as one key.

    ``rules`` has rule_id, ``rule_tables`` (rule_id, table_name), ``columns`` (table_name, ...). Rules of one set share a
    scope, whatever the order in which they name its tables. A rule none of whose tables is known, or that
    names none, has the scope of all tables.
    """
    sets = known_tables(rule_tables, columns)
    every = F.array().cast("array<string>")
    placed = rules.select("rule_id").distinct().join(sets, "rule_id", "left").withColumn("tables", F.coalesce("tables", every))
    return placed.select("rule_id", scope_name("tables").alias("scope"), "tables")


def known_tables(rule_tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(rule_id, tables): the set of tables of each rule that ``columns`` knows; rules without one have no row."""
    known = columns.select("table_name").distinct()
    named = rule_tables.select("rule_id", "table_name").join(known, "table_name", "left_semi")
    return named.groupBy("rule_id").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def scope_name(tables: str) -> Column:
    return F.when(F.size(tables) > 0, F.to_json(tables)).otherwise(ALL_TABLES)


def scope_columns(scopes: DataFrame, columns: DataFrame) -> DataFrame:
    """(scope, position, column, ...) of the scopes in use; the scope of all tables holds every column once.

    The pool of a set of tables is made once for all its rules, that of all tables once altogether.
    """
    used = scopes.select("scope", "tables").distinct()
    own = used.select("scope", F.explode("tables").alias("table_name")).join(columns, "table_name").drop("table_name")
    every = columns.drop("table_name").withColumn("scope", F.lit(ALL_TABLES)).select(own.columns)
    return own.unionByName(every)


def resolve_for_rules(
    entities: DataFrame, rule_tables: DataFrame, columns: DataFrame, scores: DataFrame | None = None, weights: Mapping[str, float] = DEFAULT_WEIGHTS,
) -> DataFrame:
    """M8: (rule_id, entity, scope, column, score): every entity of a rule against the columns of the rule's tables.

    ``entities`` has (rule_id, entity) and may have ``vector``; ``columns`` (table_name, position, column) in the
    order in which ties are settled. ``scores`` are those of ``score_maps`` with scopes as ``rule_scopes``
    writes them. No entity is lost: rules without a known table search all columns.

    A score of names alone does not depend on the scope: an entity is scored once per table it meets and the best of a rule's
    tables are compared in the rule's row, so the work on names grows with entities and tables, not with the sets of
    tables in use. External scores (by places in a scope's pool) and vectors (of a column's first table in the scope) are scored once per scope.
    """
    said = entities.filter(F.coalesce(F.col("entity"), F.lit("")) != "")
    if scores is None and not ("vector" in entities.columns and "vector" in columns.columns):
        return _resolve_by_table(said.select("rule_id", "entity"), rule_tables, columns.select("table_name", "position", "column"), weights)
    scopes = settle(rule_scopes(entities, rule_tables, columns))
    placed = said.join(scopes.select("rule_id", "scope"), "rule_id")
    best = best_columns(ranked_candidates(placed.drop("rule_id"), pools(scope_columns(scopes, columns)), scores, weights))
    return spread_join(placed.select("rule_id", "entity", "scope").distinct(), best, ["scope", "entity"]).select("rule_id", "entity", "scope", "column", "score")


def _resolve_by_table(entities: DataFrame, rule_tables: DataFrame, columns: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    sets = known_tables(rule_tables, columns)
    tables = F.coalesce("tables", F.array().cast("array<string>")).alias("tables")
    # Read for the pairs and for the result; one row per rule and entity.
    placed = settle(entities.filter(F.col("rule_id").isNotNull()).join(sets, "rule_id", "left").select("rule_id", "entity", tables).distinct())
    one = F.when(F.col("table_name").isNotNull(), F.array("table_name")).otherwise(F.array().cast("array<string>"))
    met = placed.select("entity", F.explode_outer("tables").alias("table_name")).distinct().withColumn("tables", one)
    pairs = settle(met.select("entity", "table_name", "tables", scope_name("tables").alias("scope")))
    own = scope_columns(pairs, columns)
    best = best_columns(ranked_candidates(pairs.select("scope", "entity"), pools(own), None, weights))
    first = own.groupBy("scope", "column").agg(F.min("position").alias("position"))
    found = best.join(first, ["scope", "column"]).join(pairs.select("scope", "entity", "table_name"), ["scope", "entity"]).withColumn(
        "best", F.struct((-F.col("score")).alias("negative"), "position", "column")
    )
    # One row per entity, as long as the catalogue has tables.
    of_entity = settle(found.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("table_name").isNotNull(), F.struct("table_name", "best")))).alias("by_table"),
        F.max(F.when(F.col("table_name").isNull(), F.col("best"))).alias("of_all"),
    ))
    chosen = F.when(F.size("tables") > 0, F.array_min(F.transform("tables", lambda t: F.try_element_at("by_table", t)))).otherwise(F.col("of_all"))
    # A generator reads the expression once; without a best column there is no row.
    first_best = F.inline(F.array_compact(F.array(chosen)))
    rows = spread_join(placed, of_entity, ["entity"]).select("rule_id", "entity", scope_name("tables").alias("scope"), first_best)
    return rows.select("rule_id", "entity", "scope", "column", (-F.col("negative")).alias("score"))


def resolve_scoped(entities: DataFrame, schema_columns: DataFrame, schema_tables: DataFrame, dataset_columns: DataFrame, rule_scope: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """M7: the second hop searches the table a schema column declares, else the rule's table, else all tables.

    ``entities`` has (rule_id, entity), ``schema_columns`` (position, column), ``schema_tables``
    (column, table_name), ``dataset_columns`` (scope = table, position, column) and
    ``rule_scope`` (rule_id, table_name). A table that does not exist counts as not given; found in all
    tables, an entity has no table name.
    """
    first = resolve(entities.select("entity"), schema_columns, None, weights).select("entity", "column")
    per_rule = entities.select("rule_id", "entity").distinct().join(first, "entity")
    known = dataset_columns.select(F.col("scope").alias("table_name")).distinct()
    declared = schema_tables.join(known, "table_name", "left_semi").select("column", F.col("table_name").alias("declared"))
    own = rule_scope.join(known, "table_name", "left_semi").select("rule_id", F.col("table_name").alias("own"))
    # Both the second hop and the result read these rows; scoring them once is enough.
    placed = settle(
        per_rule.join(declared, "column", "left").join(own, "rule_id", "left")
        .select("rule_id", "entity", "column", F.coalesce("declared", "own", F.lit(ALL_TABLES)).alias("scope"))
    )
    needed = placed.select("scope", F.col("column").alias("entity")).distinct()
    every = dataset_columns.withColumn("scope", F.lit(ALL_TABLES)).select(dataset_columns.columns)
    second = resolve(needed, dataset_columns.unionByName(every), None, weights).select(
        "scope", F.col("entity").alias("schema_col"), F.col("column").alias("dataset_col"),
    )
    found = placed.withColumnRenamed("column", "schema_col").join(second, ["scope", "schema_col"])
    table_name = F.when(F.col("scope") != ALL_TABLES, F.col("scope")).alias("table_name")
    return found.select("rule_id", "entity", "schema_col", table_name, "dataset_col")


def suggested_columns(rule_entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """M9: the column of each entity of a rule, "" where none was found."""
    best = resolved.select("entity", "column")
    return rule_entities.join(best, "entity", "left").withColumn("column", F.coalesce("column", F.lit("")))


def override_mapping(mapping: DataFrame, edits: DataFrame) -> DataFrame:
    """U4: user edits (entity, column) replace or extend the mapping; the new column wins."""
    new = edits.withColumnRenamed("column", "__new")
    return mapping.join(new, "entity", "full_outer").select("entity", F.coalesce("__new", "column").alias("column"))


def zip_edits(rows: DataFrame) -> DataFrame:
    """U4: (entities, columns) arrays to (entity, column) rows by position, up to the shorter one."""
    pairs = F.arrays_zip(F.col("entities").alias("entity"), F.col("columns").alias("column"))
    shorter = F.least(F.size("entities"), F.size("columns"))
    return rows.select(F.inline(F.slice(pairs, F.lit(1), shorter)))


def fill_unmapped(schema_columns: DataFrame, mapped: DataFrame, matches: DataFrame) -> DataFrame:
    """Schema columns without a dataset column take their match, else themselves."""
    missing = schema_columns.select("schema_col").distinct().join(mapped, "schema_col", "left_anti")
    found = matches.select("schema_col", F.col("dataset_col").alias("__match"))
    filled = missing.join(found, "schema_col", "left").select("schema_col", F.coalesce("__match", "schema_col").alias("dataset_col"))
    return mapped.select("schema_col", "dataset_col").unionByName(filled)


def choosable_columns(schema_to_dataset: DataFrame | None, columns: DataFrame) -> DataFrame:
    """Schema columns that have a dataset column, or all dataset columns without a schema."""
    if schema_to_dataset is None:
        return columns.select("column").distinct()
    return schema_to_dataset.filter(F.coalesce(F.col("dataset_col"), F.lit("")) != "").select(F.col("schema_col").alias("column")).distinct()


def phrases(texts: DataFrame, id_column: str, text: str, longest: int = MAX_PHRASE_WORDS) -> DataFrame:
    """All word sequences of 1 to ``longest`` words: (id, start, n_words, phrase, key).

    ``key`` is the sorted distinct tokens of the normalised phrase; every word is normalised
    once, whatever the number of phrases it is part of.
    """
    listed = texts.select(id_column, words(F.col(text)).alias("__w")).withColumn(
        "__t", F.transform("__w", lambda w: F.array_remove(F.split(normalized_name(w), " "), ""))
    )
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.size("__w") - F.col("__i")))
    starts = listed.select("*", F.posexplode_outer("__w").alias("__i", "__word")).filter(F.col("__i").isNotNull())
    spans = starts.select("*", F.explode_outer(lengths).alias("n_words"))
    first, count = F.col("__i") + 1, F.col("n_words")
    tokens = F.array_sort(F.array_distinct(F.flatten(F.slice("__t", first, count))))
    return spans.select(
        id_column, first.alias("start"), "n_words", F.array_join(F.slice("__w", first, count), " ").alias("phrase"), F.array_join(tokens, " ").alias("key")
    )


def extract_entities(texts: DataFrame, id_column: str, text: str, columns: DataFrame, threshold: float = 1.0, longest: int = MAX_PHRASE_WORDS) -> DataFrame:
    """Phrases of a text that name a column, kept in the text's own wording.

    A phrase whose tokens are all in a column's name scores 1: such pairs meet by an equi-join
    on single tokens and a count of the shared ones, at any threshold. Below 1 the other
    distinct phrases are scored against the packed pool as well. A phrase that holds a whole name
    and further words is none: its part that is the name counts. Of equal scores the first
    column counts. Of overlapping phrases the longest stays, then the earliest.
    """
    # Rule texts are few bytes but much work each: every word starts several phrases.
    spread = spread_rows(texts.select(id_column, text))
    found = phrases(spread, id_column, text, longest).filter(F.col("key") != "")
    best = contained_names(found.select("key").distinct(), columns).withColumn("score", F.lit(1.0))
    if threshold < 1.0:
        rest = found.select(F.col("phrase").alias("entity"), "key").join(best, "key", "left_anti").select("entity")
        scored = resolve(rest, columns.select("position", "column"), None, {"llm": 0, "cosine": 0, "fuzzy": 100}).filter(F.col("score") >= threshold)
        near = found.join(scored.select(F.col("entity").alias("phrase"), "column", "score"), "phrase").filter(
            F.size(F.array_except(F.split(token_key(normalized_name(F.col("column"))), " "), F.split("key", " "))) > 0
        )
        exact = found.join(best, "key")
        return _non_overlapping(exact.unionByName(near), id_column)
    return _non_overlapping(found.join(best, "key"), id_column)


def contained_names(keys: DataFrame, columns: DataFrame) -> DataFrame:
    """(key, column): the first column whose name tokens contain those of a key."""
    names = columns.select(token_key(normalized_name(F.col("column"))).alias("name"), "column", "position").filter(F.col("name") != "")
    first = names.groupBy("name").agg(F.min_by("column", "position").alias("column"), F.min("position").alias("position"))

    def tokens(df: DataFrame, key: str) -> DataFrame:
        parts = F.split(key, " ")
        return df.select("*", F.size(parts).alias(f"n_{key}"), F.explode(parts).alias("token"))

    shared = tokens(keys, "key").join(tokens(first, "name"), "token").groupBy("key", "name", "n_key", "n_name", "column", "position").agg(F.count("*").alias("n"))
    return shared.filter(F.col("n") == F.col("n_key")).groupBy("key").agg(F.min_by("column", "position").alias("column"))


def _non_overlapping(hits: DataFrame, id_column: str) -> DataFrame:
    """Of hits that share a word keep the longest, then the better, then the first.

    The hits of a text are folded inside one row, as the text itself is one row: the list
    is never longer than the text.
    """
    item = F.struct(
        (-F.col("n_words")).alias("shorter"), (-F.col("score")).alias("worse"), F.col("start").cast("int").alias("start"),
        F.col("n_words").cast("int").alias("n_words"), "phrase", "column", "score",
    )
    texts = hits.groupBy(id_column).agg(F.array_sort(F.collect_list(item)).alias("__hits"))

    def free(kept: Column, hit: Column) -> Column:
        return ~F.exists(kept, lambda k: (k["start"] < hit["start"] + hit["n_words"]) & (hit["start"] < k["start"] + k["n_words"]))

    kept = F.aggregate(
        F.col("__hits"), F.filter("__hits", lambda _: F.lit(False)),
        lambda acc, hit: F.when(free(acc, hit), F.concat(acc, F.array(hit))).otherwise(acc),
    )
    return texts.select(id_column, F.inline(kept)).select(id_column, "start", "n_words", "phrase", "column", "score")
