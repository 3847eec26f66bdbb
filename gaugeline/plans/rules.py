"""Rule rows: the typed rule table and its registry of compiled checks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.text import slug
from gaugeline.operators.ranking import latest_per_key

CHECK_TYPES = ("not_null", "uniqueness", "length", "range", "allowed_values", "regex", "comparison")

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("business_rule", T.StringType()),
    T.StructField("complexity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("entities", T.ArrayType(T.StringType())),
    T.StructField("check_type", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("params", T.StringType()),
])


@dataclass(frozen=True)
class Rule:
    """One data-quality rule: a check type, its columns and its parameters.

    ``guard`` is another rule; where it does not hold, this rule passes.
    """

    name: str
    check_type: str
    columns: tuple[str, ...]
    params: Mapping[str, Any] = field(default_factory=dict)
    guard: Rule | None = None
    description: str = ""
    business_rule: str = ""
    complexity: str = "simple"
    category: str = "validity"
    entities: tuple[str, ...] = ()

    def required_columns(self) -> tuple[str, ...]:
        """Columns the check reads, in order."""
        names = list(self.columns)
        other = self.params.get("compare_to_field")
        if other:
            names.append(other)
        if self.guard:
            names.extend(self.guard.required_columns())
        return tuple(dict.fromkeys(names))

    def to_row(self, rule_id: int | None = None) -> tuple:
        params = dict(self.params)
        if self.guard:
            params["guard"] = {
                "check_type": self.guard.check_type,
                "columns": list(self.guard.columns),
                "params": dict(self.guard.params),
            }
        return (
            rule_id, self.name, self.description, self.business_rule, self.complexity, self.category,
            list(self.entities), self.check_type, list(self.columns), json.dumps(params),
        )


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([r.to_row(i + 1) for i, r in enumerate(rules)], RULE_SCHEMA)


def rules_from_frame(rows: DataFrame) -> list[Rule]:
    """Typed rules from a rule table. One row becomes one expression of the plan."""
    rules = []
    for row in rows.orderBy("id").toLocalIterator():
        params = json.loads(row["params"] or "{}")
        guard = params.pop("guard", None)
        rules.append(
            Rule(
                name=row["name"],
                check_type=row["check_type"] or "not_null",
                columns=tuple(row["columns"] or ()),
                params=params,
                guard=None if guard is None else Rule(
                    name=f"{row['name']} guard",
                    check_type=guard["check_type"],
                    columns=tuple(guard["columns"]),
                    params=guard.get("params", {}),
                ),
                description=row["description"] or "",
                business_rule=row["business_rule"] or "",
                complexity=row["complexity"] or "",
                category=row["category"] or "",
                entities=tuple(row["entities"] or ()),
            )
        )
    return rules


def when_guard(rule: Rule, guard: Rule) -> Rule:
    """the same rule, enforced only where ``guard`` holds."""
    return replace(rule, guard=guard)


def append_rules(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add rule rows; columns missing on either side become NULL."""
    return existing.unionByName(new, allowMissingColumns=True)


def upsert_checks(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace checks of the same slug, add the others; the highest version stays."""
    keyed = registry.unionByName(changes, allowMissingColumns=True).withColumn("slug", slug(F.col("name")))
    return latest_per_key(keyed, ["slug"], ["version"])


def classified(check_type: Column, n_columns: Column, guarded: Column) -> tuple[Column, Column]:
    """Complexity and category that follow from the shape of a rule.

    Returns (complexity, category): guarded rules are complex business logic, rules over
    several columns are medium consistency checks, null checks measure completeness,
    uniqueness checks accuracy, and all other single-column checks validity.
    """
    complexity = F.when(guarded, "complex").when((n_columns > 1) | check_type.isin("range", "regex"), "medium").otherwise("simple")
    category = (
        F.when(guarded, "business_logic")
        .when(check_type == "not_null", "completeness")
        .when(check_type == "uniqueness", "accuracy")
        .when((check_type == "comparison") & (n_columns > 1), "consistency")
        .otherwise("validity")
    )
    return complexity, category


def with_classes(rules: DataFrame) -> DataFrame:
    """X14/G2 on a rule table: fill complexity and category where they are not given."""
    guarded = F.get_json_object("params", "$.guard").isNotNull()
    compared = F.get_json_object("params", "$.compare_to_field").isNotNull()
    n_columns = F.size("columns") + F.when(compared, 1).otherwise(0)
    complexity, category = classified(F.col("check_type"), n_columns, guarded)
    return rules.withColumn("complexity", F.coalesce("complexity", complexity)).withColumn(
        "category", F.coalesce("category", category)
    )


def new_rules_only(candidates: DataFrame, existing: DataFrame, text: str = "business_rule") -> DataFrame:
    """Candidates whose normalised text no existing rule has."""
    key = F.regexp_replace(F.lower(F.trim(F.col(text))), r"\s+", " ")
    known = existing.select(key.alias("__text")).distinct()
    return candidates.withColumn("__text", key).join(known, "__text", "left_anti").drop("__text")
