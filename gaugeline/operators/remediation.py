"""Targeted repair of failing rows, with an audit.

An action changes only targeted rows and never the id column. Targets are given as the
rule whose failing rows are meant (the condition is then evaluated in the row, without a
join), as a list of ids, or as a frame of ids.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators.evaluate import evaluate
from gaugeline.operators.predicates import TABLE_CHECKS, RuleError, column, condition, validate
from gaugeline.operators.ranking import first_per_key
from gaugeline.operators.tables import id_frame
from gaugeline.plans.rules import Rule

ACTIONS = ("fillna", "replace", "cast", "standardize", "deduplicate", "filter", "review")
# Ids an audit row names.
AUDIT_IDS = 100
PREVIEW_ROWS = 10
_TARGET = "__target"


class RemediationError(ValueError):
    """A repair that is not allowed or cannot be planned."""


@dataclass(frozen=True)
class Action:
    """One repair.

    ``where`` is SQL text for the invalid condition (replace, filter); ``params`` holds
    ``value`` (fillna, replace), ``to`` (cast), ``trim``/``case``/``pattern``/``replacement``
    (standardize) and ``keys`` (deduplicate).
    """

    action_type: str
    target_columns: tuple[str, ...] = ()
    where: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)
    rule_name: str = ""
    logic: str = ""


Targets = Rule | Sequence | DataFrame


def check_action(df: DataFrame, action: Action, id_column: str | None, targets: Targets | None) -> None:
    """Refuse a repair without targets or id, of the id itself, or of unknown columns."""
    if targets is None or (isinstance(targets, (list, tuple)) and not targets):
        raise RemediationError("No failed IDs provided. Remediation must target failed records only.")
    if not id_column or id_column not in df.columns:
        raise RemediationError("No ID column found. Evaluate the rule before remediation.")
    if action.action_type not in ACTIONS:
        raise RemediationError(f"Unknown action: {action.action_type}")
    if id_column in action.target_columns:
        raise RemediationError(f"The ID column {id_column} must not be changed")
    missing = [c for c in (*action.target_columns, *action.params.get("keys", ())) if c not in df.columns]
    if missing:
        raise RemediationError(f"Columns not present in dataframe: {missing}")
    if action.action_type in ("replace", "filter") and action.where is None:
        raise RemediationError(f"{action.action_type} needs the invalid condition")


def with_target_flag(df: DataFrame, id_column: str, targets: Targets) -> DataFrame:
    """Mark the targeted rows."""
    if isinstance(targets, Rule):
        if targets.check_type in TABLE_CHECKS:
            raise RuleError("Targets of a uniqueness rule are given as a frame of ids")
        validate(df, targets, id_column)
        return df.withColumn(_TARGET, ~F.coalesce(condition(targets, df), F.lit(False)))
    ids = id_frame(df, id_column, targets)
    flagged = df.join(ids.withColumn(_TARGET, F.lit(True)), id_column, "left")
    return flagged.select(*[column(c) for c in df.columns], F.coalesce(_TARGET, F.lit(False)).alias(_TARGET))


def _standardized(value: Column, params: Mapping[str, Any]) -> Column:
    if params.get("trim"):
        value = F.trim(value)
    if params.get("case") == "upper":
        value = F.upper(value)
    elif params.get("case") == "lower":
        value = F.lower(value)
    if params.get("pattern"):
        value = F.regexp_replace(value, params["pattern"], params.get("replacement", ""))
    return value


def _new_value(action: Action, name: str, dtype: T.DataType) -> Column:
    """The repaired value of one column in a targeted row; the column keeps its type."""
    value = column(name)
    if action.action_type == "fillna":
        return F.coalesce(value, F.lit(action.params["value"]).cast(dtype))
    if action.action_type == "replace":
        invalid = F.coalesce(F.expr(action.where), F.lit(False))
        return F.when(invalid, F.lit(action.params["value"]).cast(dtype)).otherwise(value)
    if action.action_type == "standardize":
        return _standardized(value, action.params)
    raise RemediationError(f"{action.action_type} does not change values")


def _cast_columns(flagged: DataFrame, action: Action) -> DataFrame:
    """Re-type whole columns; a targeted value that does not convert becomes NULL.

    A column has one type, so rows outside the target convert too and must do so without
    loss: Spark raises an error where one does not.
    """
    kind = action.params["to"]
    return flagged.withColumns({
        c: F.when(F.col(_TARGET), column(c).try_cast(kind)).otherwise(F.when(~F.col(_TARGET), column(c)).cast(kind))
        for c in action.target_columns
    })


def _repaired(flagged: DataFrame, action: Action, id_column: str) -> DataFrame:
    """The table after the action, the target flag still on it."""
    kind = action.action_type
    if kind == "review":
        return flagged
    if kind == "cast":
        return _cast_columns(flagged, action)
    if kind == "filter":
        return flagged.filter(~(F.col(_TARGET) & F.coalesce(F.expr(action.where), F.lit(False))))
    if kind == "deduplicate":
        keys = list(action.params.get("keys") or action.target_columns)
        kept = first_per_key(flagged.filter(F.col(_TARGET)), keys, [id_column])
        return flagged.filter(~F.col(_TARGET)).unionByName(kept)
    return flagged.withColumns({
        c: F.when(F.col(_TARGET), _new_value(action, c, flagged.schema[c].dataType)).otherwise(column(c))
        for c in action.target_columns
    })


def remediate(df: DataFrame, action: Action, id_column: str, targets: Targets) -> DataFrame:
    """The table with the action applied; ``review`` leaves it as it is."""
    check_action(df, action, id_column, targets)
    return _repaired(with_target_flag(df, id_column, targets), action, id_column).select(*[column(c) for c in df.columns])


def review_rows(df: DataFrame, id_column: str, targets: Targets) -> DataFrame:
    """The targeted rows, unchanged, for export."""
    return with_target_flag(df, id_column, targets).filter(F.col(_TARGET)).select(*[column(c) for c in df.columns])


def changes(df: DataFrame, action: Action, id_column: str, targets: Targets) -> DataFrame:
    """Rows in scope and rows really changed or removed, as one row.

    In-row actions compare old and new values within the row, in one pass; actions that
    remove rows compare row counts.
    """
    check_action(df, action, id_column, targets)
    flagged = with_target_flag(df, id_column, targets)
    scope = F.count_if(F.col(_TARGET)).alias("rows_in_scope")
    if action.action_type == "review":
        return flagged.agg(scope, F.lit(0).cast("bigint").alias("rows_affected"))
    if action.action_type in ("filter", "deduplicate"):
        before = flagged.agg(scope, F.count("*").alias("__before"))
        after = _repaired(flagged, action, id_column).agg(F.count("*")).scalar()
        return before.select("rows_in_scope", (F.col("__before") - after).alias("rows_affected"))
    old = {c: f"__old_{i}" for i, c in enumerate(action.target_columns)}
    kept = flagged.withColumns({name: column(c) for c, name in old.items()})
    repaired = _repaired(kept, action, id_column)
    differs = reduce(
        lambda a, b: a | b,
        [~F.equal_null(column(c).cast("string"), F.col(name).cast("string")) for c, name in old.items()],
    )
    return repaired.agg(scope, F.count_if(differs & F.col(_TARGET)).alias("rows_affected"))


def audit_row(df: DataFrame, action: Action, id_column: str, targets: Targets, when: Column, rule_index: int | None = None) -> DataFrame:
    """The remediation-log row of an action, in the form totals, history and documents read.

    ``n_ids`` counts the distinct ids of targeted rows, ``ids`` holds the AUDIT_IDS smallest as text.
    """
    targeted = with_target_flag(df, id_column, targets).filter(F.col(_TARGET)).select(column(id_column).alias("id")).distinct()
    first = targeted.orderBy("id").limit(AUDIT_IDS).agg(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string"))).scalar()
    return changes(df, action, id_column, targets).select(
        F.lit(rule_index).cast("bigint").alias("rule_index"), F.lit(action.rule_name).alias("rule_name"), F.lit(action.logic).alias("logic"),
        F.lit(action.action_type).alias("action_type"), "rows_in_scope", "rows_affected",
        targeted.agg(F.count("*")).scalar().alias("n_ids"), first.alias("ids"), when.alias("ts"),
    )


def preview_rows(df: DataFrame, action: Action, id_column: str, targets: Targets, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first targeted rows after the action."""
    check_action(df, action, id_column, targets)
    repaired = _repaired(with_target_flag(df, id_column, targets), action, id_column)
    return repaired.filter(F.col(_TARGET)).drop(_TARGET).orderBy(id_column).limit(n)


def recheck(df: DataFrame, action: Action, rule: Rule, id_column: str, targets: Targets, null_policy: str = "fail") -> DataFrame:
    """The rule's result before and after the action."""
    fixed = remediate(df, action, id_column, targets)
    before = evaluate(df, [rule], null_policy).select(F.lit("before").alias("stage"), "rule", "passed_count", "failed_count", "pass_rate")
    after = evaluate(fixed, [rule], null_policy).select(F.lit("after").alias("stage"), "rule", "passed_count", "failed_count", "pass_rate")
    return before.unionByName(after)


def remediate_tables(tables: Mapping[str, DataFrame], actions: Mapping[str, Action], failing: DataFrame, id_columns: Mapping[str, str]) -> dict[str, DataFrame]:
    """Repair each owning table by the ids its rows have among the failing joined rows.

    ``failing`` holds the joined rows that fail, with the id column of every table. Tables
    keep their own columns and rows; none is replaced by the joined frame.
    """
    repaired = dict(tables)
    for name, action in actions.items():
        id_column = id_columns[name]
        ids = failing.select(id_column).distinct()
        repaired[name] = remediate(tables[name], action, id_column, ids)
    return repaired
