"""Check builders: rule parameters to boolean Columns.

A builder returns a Column that is true where a row passes, false where it fails and
NULL where the check cannot tell. Row-local checks fuse into one pass over the table and
work on streaming frames as well.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.plans.rules import Rule

Params = Mapping[str, Any]
Builder = Callable[[Sequence[str], Params], Column]

# Patterns that rules may name instead of spelling out.
NAMED_PATTERNS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
}


class RuleError(ValueError):
    """A rule that cannot be planned on the given table."""


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def is_blank(value: Column) -> Column:
    """Spaces only (a tab is not blank); used by the not-null check."""
    return F.trim(value.cast("string")) == ""


def is_empty_text(value: Column) -> Column:
    """Empty without trimming; used by the profile of failed rows."""
    return value.cast("string") == ""


def not_null(fields: Sequence[str], params: Params) -> Column:
    present = reduce(and_, [column(f).isNotNull() for f in fields])
    if params.get("allow_blank", False):
        return present
    filled = reduce(and_, [F.coalesce(~is_blank(column(f)), F.lit(False)) for f in fields])
    return present & filled


def _typed(value: Column, params: Params) -> Column:
    kind = params.get("as")
    if kind == "number":
        return value.try_cast("double")
    if kind == "timestamp":
        return value.try_cast("timestamp")
    return value


def comparison(fields: Sequence[str], params: Params) -> Column:
    left = _typed(column(fields[0]), params)
    other_field, other_value = params.get("compare_to_field"), params.get("compare_to_value")
    if other_field:
        right = _typed(column(other_field), params)
    elif other_value is not None:
        right = _typed(F.lit(other_value), params)
    else:
        raise RuleError("Comparison target missing")
    operator = params.get("operator", "==")
    tolerance = params.get("tolerance")
    if operator == ">":
        return left > right
    if operator == ">=":
        return left >= right
    if operator == "<":
        return left < right
    if operator == "<=":
        return left <= right
    if operator == "!=":
        return left != right
    if tolerance is not None:
        return F.abs(left - right) <= F.lit(tolerance)
    return left == right


def value_range(fields: Sequence[str], params: Params) -> Column:
    value = _typed(column(fields[0]), params)
    low, high = params.get("min_value"), params.get("max_value")
    bounds = [value >= F.lit(low)] if low is not None else []
    bounds += [value <= F.lit(high)] if high is not None else []
    if not bounds:
        raise RuleError("Range needs min_value or max_value")
    return reduce(and_, bounds)


def allowed_values(fields: Sequence[str], params: Params) -> Column:
    values = params.get("values")
    if not values:
        raise RuleError("Allowed values missing")
    return _typed(column(fields[0]), params).isin(*values)


def regex(fields: Sequence[str], params: Params) -> Column:
    pattern = params.get("pattern")
    if not pattern:
        raise RuleError("Pattern missing")
    return column(fields[0]).cast("string").rlike(NAMED_PATTERNS.get(pattern, pattern))


def text_length(fields: Sequence[str], params: Params) -> Column:
    size = F.length(column(fields[0]).cast("string"))
    low, high = params.get("min_value"), params.get("max_value")
    bounds = [size >= low] if low is not None else []
    bounds += [size <= high] if high is not None else []
    if not bounds:
        raise RuleError("Length needs min_value or max_value")
    return reduce(and_, bounds)


def expression(fields: Sequence[str], params: Params) -> Column:
    """A condition the user wrote in SQL."""
    return F.expr(params["sql"])


CHECKS: dict[str, Builder] = {
    "not_null": not_null,
    "comparison": comparison,
    "range": value_range,
    "allowed_values": allowed_values,
    "regex": regex,
    "length": text_length,
    "expression": expression,
}

# Checks that need other rows of the table; evaluated by evaluate.py.
TABLE_CHECKS = frozenset({"uniqueness"})


def register_check(check_type: str, builder: Builder) -> None:
    """Add a user check; it returns a Column and so joins the shared pass."""
    CHECKS[check_type] = builder


def validate(df: DataFrame | None, rule: Rule, id_column: str | None = None) -> None:
    """refuse a rule the table cannot answer, before any job is planned."""
    if df is None:
        raise RuleError("Input DataFrame is None")
    if not df.columns:
        raise RuleError("DataFrame has no columns")
    if not rule.columns:
        raise RuleError("No fields supplied for the check")
    if rule.check_type not in CHECKS and rule.check_type not in TABLE_CHECKS:
        raise RuleError(f"Unknown check type: {rule.check_type}")
    if rule.guard is not None:
        if rule.guard.check_type in TABLE_CHECKS:
            raise RuleError(f"{rule.guard.check_type} is not a row-local check")
        validate(df, rule.guard)
    missing = [c for c in rule.required_columns() if c not in df.columns]
    if missing:
        raise RuleError(f"Columns not present in dataframe: {missing}")
    if id_column is not None and id_column not in df.columns:
        raise RuleError(f"ID column {id_column} not found in dataframe")


def condition(rule: Rule, df: DataFrame | None = None) -> Column:
    """The rule's condition; a guarded rule passes where its guard does not hold.

    With ``df`` a text column that meets a number is read as one: text that is no number is
    NULL there and does not end the job.
    """
    if rule.check_type in TABLE_CHECKS:
        raise RuleError(f"{rule.check_type} is not a row-local check")
    check = CHECKS[rule.check_type](rule.columns, rule.params if df is None else fitted_params(df, rule))
    if rule.guard is None:
        return check
    return ~F.coalesce(condition(rule.guard, df), F.lit(False)) | check


def fitted_params(df: DataFrame, rule: Rule) -> Params:
    """The rule's parameters, with ``as: number`` where a text column is compared with numbers."""
    if "as" in rule.params or rule.check_type not in ("comparison", "range", "allowed_values"):
        return rule.params
    types = dict(df.dtypes)
    kinds = {types.get(c) for c in (*rule.columns, rule.params.get("compare_to_field"))}
    values = [rule.params.get(k) for k in ("compare_to_value", "min_value", "max_value")] + list(rule.params.get("values") or [])
    numbers = any(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
    numeric = any(k is not None and (k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")) for k in kinds)
    return {**rule.params, "as": "number"} if "string" in kinds and (numbers or numeric) else rule.params


def planned_condition(df: DataFrame, rule: Rule) -> Column:
    """The condition after Spark has analysed it alone: what cannot be planned raises RuleError here, before it joins a pass."""
    check_patterns(df, rule)
    try:
        verdict = condition(rule, df)
        kind = df.select(verdict.alias("verdict")).schema[0].dataType.simpleString()
    except RuleError:
        raise
    except (PySparkException, KeyError, TypeError, ValueError) as error:
        raise RuleError(str(error).strip().splitlines()[0]) from error
    if kind not in ("boolean", "void"):
        raise RuleError(f"The condition is of type {kind}, not boolean")
    return verdict


def check_patterns(df: DataFrame, rule: Rule) -> None:
    """Refuse a pattern that the workers' regular expressions would not compile."""
    pattern = rule.params.get("pattern") if rule.check_type == "regex" else None
    if pattern:
        try:
            df.sparkSession._jvm.java.util.regex.Pattern.compile(NAMED_PATTERNS.get(pattern, pattern))
        except Exception as error:
            raise RuleError(f"Pattern does not compile: {pattern}") from error
    if rule.guard is not None:
        check_patterns(df, rule.guard)


def with_null_policy(verdict: Column, policy: str) -> Column:
    """Where the condition is NULL: ``fail`` it, ``pass`` it, or ``ignore`` the row (keep NULL)."""
    if policy == "fail":
        return F.coalesce(verdict, F.lit(False))
    if policy == "pass":
        return F.coalesce(verdict, F.lit(True))
    if policy == "ignore":
        return verdict
    raise RuleError(f"Unknown null policy: {policy}")
