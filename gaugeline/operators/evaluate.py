"""Evaluation of rules: verdicts, counts, pass rates and failed ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators.predicates import (
    TABLE_CHECKS,
    RuleError,
    column,
    condition,
    planned_condition,
    validate,
    with_null_policy,
)
from gaugeline.operators.ranking import top_per_group
from gaugeline.operators.skew import spread_join
from gaugeline.plans.rules import Rule

FAILED_ID_LIMIT = 100
SAMPLE_ID_LIMIT = 25
# More rules than this share a scan as rows (rule, verdict) instead of columns of one aggregate,
# whose generated code would outgrow the JVM's method size.
RULES_AS_COLUMNS = 25

RESULT_SCHEMA = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("check_type", T.StringType()),
    T.StructField("passed_count", T.LongType()),
    T.StructField("failed_count", T.LongType()),
    T.StructField("unknown_count", T.LongType()),
    T.StructField("pass_rate", T.DoubleType()),
    T.StructField("message", T.StringType()),
    T.StructField("error", T.StringType()),
])


# ---- verdicts -----------------------------------------------------------------------


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, counted in part before the shuffle."""
    return df.groupBy(*[column(k).alias(k) for k in keys]).agg(F.count("*").alias("n_rows"))


def _key_is_known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [column(k).isNotNull() for k in keys])


def with_unique_verdict(df: DataFrame, keys: Sequence[str], name: str = "verdict") -> DataFrame:
    """F11 per row: true when no other row has the key, NULL when the key has a NULL."""
    repeated = (
        key_counts(df, keys).filter((F.col("n_rows") > 1) & _key_is_known(keys)).select(*keys, F.lit(True).alias("__repeats"))
    )
    flagged = spread_join(df, repeated, list(keys), "left")
    return flagged.withColumn(name, F.when(_key_is_known(keys), F.col("__repeats").isNull())).drop("__repeats")


def with_verdict(df: DataFrame, rule: Rule, null_policy: str = "fail", name: str = "verdict") -> DataFrame:
    """add the verdict of one rule to every row."""
    validate(df, rule)
    if rule.check_type == "uniqueness":
        flagged = with_unique_verdict(df, rule.columns, name)
        if rule.guard is not None:
            open_guard = ~F.coalesce(condition(rule.guard, df), F.lit(False))
            flagged = flagged.withColumn(name, open_guard | F.col(name))
    else:
        flagged = df.withColumn(name, condition(rule, df))
    return flagged.withColumn(name, with_null_policy(F.col(name), null_policy))


def split_rows(df: DataFrame, rule: Rule, null_policy: str = "fail") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passed, failed and undecided rows (the last is empty unless NULLs are ignored)."""
    flagged = with_verdict(df, rule, null_policy, "__verdict")
    passed = flagged.filter(F.col("__verdict")).drop("__verdict")
    failed = flagged.filter(~F.col("__verdict")).drop("__verdict")
    unknown = flagged.filter(F.col("__verdict").isNull()).drop("__verdict")
    return passed, failed, unknown


def failed_rows(df: DataFrame, rule: Rule, null_policy: str = "fail") -> DataFrame:
    return split_rows(df, rule, null_policy)[1]


# ---- counts -------------------------------------------------------------------------


def pass_rate(passed: Column, failed: Column) -> Column:
    """passed / total, 0 for an empty table."""
    total = passed + failed
    return F.when(total > 0, passed / total).otherwise(F.lit(0.0))


def _counts(verdict: Column, policy: str, weight: Column | None = None) -> list[Column]:
    """Passed, failed and unknown rows of one verdict, each weighing ``weight`` rows."""
    decided = with_null_policy(verdict, policy)

    def total(flag: Column) -> Column:
        if weight is None:
            return F.count_if(F.coalesce(flag, F.lit(False)))
        return F.coalesce(F.sum(F.when(flag, weight)), F.lit(0))

    return [total(decided).alias("p"), total(~decided).alias("f"), total(verdict.isNull()).alias("u")]


def _result_rows(counted: DataFrame) -> DataFrame:
    """Result rows of (rule_no, rule, check_type, p, f, u)."""
    empty = (F.col("p") + F.col("f") + F.col("u")) == 0
    return counted.select(
        "rule_no", "rule", "check_type", F.col("p").alias("passed_count"), F.col("f").alias("failed_count"), F.col("u").alias("unknown_count"),
        pass_rate(F.col("p"), F.col("f")).alias("pass_rate"),
        F.when(empty, F.lit("Empty DataFrame")).alias("message"),
        F.lit(None).cast("string").alias("error"),
    )


def _as_rows(one_row: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """The columns p0, f0, u0, p1, ... of one row as a row per rule."""
    structs = [
        F.struct(
            F.lit(n).alias("rule_no"), F.lit(r.name).alias("rule"), F.lit(r.check_type).alias("check_type"),
            F.col(f"p{i}").alias("p"), F.col(f"f{i}").alias("f"), F.col(f"u{i}").alias("u"),
        )
        for i, (n, r) in enumerate(rules)
    ]
    return _result_rows(one_row.select(F.inline(F.array(*structs))))


def _row_local_results(df: DataFrame, rules: Sequence[tuple[int, Rule]], verdicts: Mapping[int, Column], policy: str) -> DataFrame:
    if len(rules) <= RULES_AS_COLUMNS:
        measures = []
        for i, (n, _) in enumerate(rules):
            for prefix, count in zip("pfu", _counts(verdicts[n], policy), strict=True):
                measures.append(count.alias(f"{prefix}{i}"))
        return _as_rows(df.agg(*measures), rules)
    # One scan for any number of rules: a row becomes a row per rule, counted before the shuffle.
    # An empty table still has its rules: their names come from a frame of their own.
    cells = F.array(*[F.struct(F.lit(n).alias("rule_no"), verdicts[n].alias("verdict")) for n, _ in rules])
    long = df.select(F.inline(cells))
    counted = long.groupBy("rule_no").agg(*_counts(F.col("verdict"), policy))
    names = df.sparkSession.createDataFrame([(n, r.name, r.check_type) for n, r in rules], "rule_no int, rule string, check_type string")
    return _result_rows(names.join(counted, "rule_no", "left").fillna(0, ["p", "f", "u"]))


def _unique_results(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[int, Rule]], policy: str) -> DataFrame:
    """All unguarded uniqueness rules on one key: one shuffle of pre-counted keys."""
    verdict = F.when(_key_is_known(keys), F.col("n_rows") == 1)
    measures = []
    for i, _ in enumerate(rules):
        for prefix, count in zip("pfu", _counts(verdict, policy, F.col("n_rows")), strict=True):
            measures.append(count.alias(f"{prefix}{i}"))
    return _as_rows(key_counts(df, keys).agg(*measures), rules)


def _guarded_unique_result(df: DataFrame, number: int, rule: Rule, policy: str) -> DataFrame:
    flagged = with_verdict(df, rule, "ignore", "__verdict")
    measures = [c.alias(f"{p}0") for p, c in zip("pfu", _counts(F.col("__verdict"), policy), strict=True)]
    return _as_rows(flagged.agg(*measures), [(number, rule)])


def _sorted_out(df: DataFrame, rules: Sequence[Rule]):
    """Rules with their numbers: row-local ones with their conditions, uniqueness rules, and errors of what cannot be planned.

    Every condition is analysed alone first, so that a rule that fails does so by itself.
    """
    verdicts: dict[int, Column] = {}
    unique: list[tuple[int, Rule]] = []
    errors: list[tuple[int, Rule, str]] = []
    for number, rule in enumerate(rules):
        try:
            validate(df, rule)
            if rule.check_type not in TABLE_CHECKS:
                verdicts[number] = planned_condition(df, rule)
            else:
                if rule.guard is not None:
                    planned_condition(df, rule.guard)
                unique.append((number, rule))
        except RuleError as error:
            errors.append((number, rule, str(error)))
    return verdicts, unique, errors


def _numbered_results(df: DataFrame, rules: Sequence[Rule], null_policy: str, sorted_out) -> DataFrame:
    verdicts, unique, errors = sorted_out
    by_key: dict[tuple[str, ...], list[tuple[int, Rule]]] = {}
    for number, rule in unique:
        if rule.guard is None:
            by_key.setdefault(tuple(rule.columns), []).append((number, rule))
    parts = [_row_local_results(df, [(n, rules[n]) for n in verdicts], verdicts, null_policy)] if verdicts else []
    parts += [_unique_results(df, keys, group, null_policy) for keys, group in by_key.items()]
    parts += [_guarded_unique_result(df, n, rule, null_policy) for n, rule in unique if rule.guard is not None]
    rows = [(n, r.name, r.check_type, None, None, None, None, None, text) for n, r, text in errors]
    if rows or not parts:
        parts.append(df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("rule_no", T.IntegerType()), *RESULT_SCHEMA.fields])))
    return reduce(DataFrame.unionByName, parts)


def evaluate(df: DataFrame, rules: Sequence[Rule], null_policy: str = "fail") -> DataFrame:
    """One result row per rule.

    All row-local rules share one scan, however many they are; uniqueness rules on the same
    key share one shuffle of counted keys. A rule that cannot be planned becomes a row with an
    error, one per rule even under one name, and does not stop the others.
    """
    return _numbered_results(df, rules, null_policy, _sorted_out(df, rules)).drop("rule_no")


def evaluate_dataset(tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]], null_policy: str = "fail") -> DataFrame:
    """F18 over a dataset: the rules of each table, with the table's name."""
    parts = [
        evaluate(tables[name], table_rules, null_policy).select(F.lit(name).alias("table_name"), "*")
        for name, table_rules in rules.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- failed ids ---------------------------------------------------------------------


def result_id(df: DataFrame, id_column: str | None) -> str:
    """The given id column, or the first column when it is absent."""
    return id_column if id_column in df.columns else df.columns[0]


def _numbered_verdicts(df: DataFrame, rules: Sequence[Rule], id_column: str, null_policy: str, sorted_out) -> DataFrame | None:
    """(rule_no, rule, id, verdict): row-local rules unpivoted within each row, uniqueness rules by their counted keys."""
    verdicts, unique, _ = sorted_out
    parts = []
    if verdicts:
        cells = [
            F.struct(F.lit(n).alias("rule_no"), F.lit(rules[n].name).alias("rule"), with_null_policy(v, null_policy).alias("verdict"))
            for n, v in verdicts.items()
        ]
        parts.append(df.select(column(id_column).alias("id"), F.inline(F.array(*cells))).select("rule_no", "rule", "id", "verdict"))
    for n, rule in unique:
        flagged = with_verdict(df, rule, null_policy, "__verdict")
        parts.append(flagged.select(F.lit(n).alias("rule_no"), F.lit(rule.name).alias("rule"), column(id_column).alias("id"), F.col("__verdict").alias("verdict")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _require_id(df: DataFrame, id_column: str) -> None:
    if id_column not in df.columns:
        raise RuleError(f"ID column {id_column} not found in dataframe")


def rule_verdicts(df: DataFrame, rules: Sequence[Rule], id_column: str, null_policy: str = "fail") -> DataFrame:
    """(rule, id, verdict) of every rule that can be planned, uniqueness rules too."""
    _require_id(df, id_column)
    found = _numbered_verdicts(df, rules, id_column, null_policy, _sorted_out(df, rules))
    if found is None:
        return df.limit(0).select(F.lit("").alias("rule"), column(id_column).alias("id"), F.lit(True).alias("verdict"))
    return found.select("rule", "id", "verdict")


def failed_ids(df: DataFrame, rules: Sequence[Rule], id_column: str, null_policy: str = "fail", limit: int = FAILED_ID_LIMIT) -> DataFrame:
    """The ``limit`` smallest non-null failing ids of every rule, uniqueness rules too."""
    return _numbered_failed_ids(df, rules, id_column, null_policy, limit, _sorted_out(df, rules)).drop("rule_no")


def _numbered_failed_ids(df: DataFrame, rules: Sequence[Rule], id_column: str, null_policy: str, limit: int, sorted_out) -> DataFrame:
    _require_id(df, id_column)
    found = _numbered_verdicts(df, rules, id_column, null_policy, sorted_out)
    if found is None:
        found = df.limit(0).select(F.lit(0).alias("rule_no"), F.lit("").alias("rule"), column(id_column).alias("id"), F.lit(True).alias("verdict"))
    failing = found.filter(~F.col("verdict") & F.col("id").isNotNull())
    return top_per_group(failing.select("rule_no", "rule", "id"), ["rule_no"], [F.col("id")], limit)


def results_with_ids(df: DataFrame, rules: Sequence[Rule], id_column: str, null_policy: str = "fail") -> DataFrame:
    """Result rows with ``failed_ids`` (at most FAILED_ID_LIMIT each, in id order); rules with an error have an error row."""
    sorted_out = _sorted_out(df, rules)
    ids = (
        _numbered_failed_ids(df, rules, id_column, null_policy, FAILED_ID_LIMIT, sorted_out)
        .groupBy("rule_no")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("failed_ids"))
    )
    return _numbered_results(df, rules, null_policy, sorted_out).join(ids, "rule_no", "left").drop("rule_no")


def id_lists(df: DataFrame, rules: Sequence[Rule], id_column: str, chunk: Column, null_policy: str = "fail") -> DataFrame:
    """All passed and failed ids per rule, one row per chunk of ids.

    The lists are whole but never one row: ``chunk`` (a bounded slice of the id space)
    keeps every array small, whatever the number of rows.
    """
    verdicts = rule_verdicts(df, rules, id_column, null_policy).withColumn("chunk", chunk)
    return verdicts.groupBy("rule", "chunk").agg(
        F.array_sort(F.collect_list(F.when(F.col("verdict"), F.col("id")))).alias("passed_records"),
        F.array_sort(F.collect_list(F.when(~F.col("verdict"), F.col("id")))).alias("failed_records"),
    )


# ---- cross-table checks -------------------------------------------------------------


def referential_counts(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """child rows whose key has / lacks a parent row; NULL keys are unknown.

    Child rows are counted per key before the join, so a hot key is one row in it.
    """
    counted = key_counts(child, [child_key]).withColumnRenamed(child_key, "__key")
    known = parent.select(column(parent_key).alias("__key")).distinct().withColumn("__found", F.lit(True))
    joined = counted.join(known, "__key", "left")
    verdict = F.when(F.col("__key").isNotNull(), F.col("__found").isNotNull())
    counts = [c.alias(n) for n, c in zip(["passed_count", "failed_count", "unknown_count"], _counts(verdict, "ignore", F.col("n_rows")), strict=True)]
    return joined.agg(*counts).withColumn("pass_rate", pass_rate(F.col("passed_count"), F.col("failed_count")))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """child rows without a parent row."""
    known = parent.select(column(parent_key).alias(child_key)).distinct()
    return spread_join(child, known, [child_key], "left_anti")
