"""Suggestions: repairs from failure patterns, new rules from schema and profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.schema import inferred_checks
from gaugeline.plans.rules import classified, new_rules_only

# Which repair answers which failure pattern, and how safe it is.
# (kind of pattern, action, confidence, risk, needs approval, reason)
PATTERN_ACTIONS = (
    (1, "fillna", "medium", "medium", True, "has null values"),
    (2, "fillna", "medium", "medium", True, "has blank values"),
    (2, "standardize", "high", "low", False, "has blank values"),
    (3, "replace", "low", "high", True, "has negative values"),
)


def repair_suggestions(patterns: DataFrame) -> DataFrame:
    """One suggestion per failure pattern and fitting action, and a review when there is no evidence.

    ``patterns`` is the output of ``failure_patterns`` (position, kind, pattern, count).
    """
    listed = F.array(*[
        F.struct(
            F.lit(kind).alias("for_kind"), F.lit(action).alias("action_type"), F.lit(confidence).alias("confidence"),
            F.lit(risk).alias("risk_level"), F.lit(approval).alias("requires_business_approval"), F.lit(reason).alias("reason"),
        )
        for kind, action, confidence, risk, approval, reason in PATTERN_ACTIONS
    ])
    fitting = F.filter(listed, lambda a: a["for_kind"] == F.col("kind"))
    target = F.regexp_replace("pattern", " is (null|blank|negative)$", "")
    rows = patterns.select("position", "count", target.alias("target_column"), F.inline(fitting))
    found = rows.select(
        "position", "target_column", "action_type", "confidence", "risk_level", "requires_business_approval",
        F.concat(F.lit("The failed evidence shows "), "target_column", F.lit(" "), "reason", F.lit(" in "), F.col("count").cast("string"), F.lit(" rows.")).alias("why"),
    )
    total = patterns.agg(F.count("*").alias("n"))
    review = total.filter("n = 0").select(
        F.lit(0).alias("position"), F.lit("").alias("target_column"), F.lit("review").alias("action_type"), F.lit("high").alias("confidence"),
        F.lit("low").alias("risk_level"), F.lit(False).alias("requires_business_approval"), F.lit("The failed evidence shows no pattern.").alias("why"),
    )
    return found.unionByName(review)


def _text(check: Column, name: Column, low: Column, high: Column) -> Column:
    """Business wording of a candidate rule."""
    readable = F.replace(name, F.lit("_"), F.lit(" "))
    bounds = F.concat(F.lit(" must be between "), low, F.lit(" and "), high)
    return (
        F.when(check == "not_null", F.concat(readable, F.lit(" must not be null or empty")))
        .when(check == "range", F.concat(readable, bounds))
        .when(check == "length", F.concat(readable, F.lit(" length"), bounds))
        .when(check == "uniqueness", F.concat(readable, F.lit(" must be unique")))
    )


def _number(value: Column) -> Column:
    """Whole numbers without a decimal part, others with four decimals."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(F.format_string("%.4f", value))


def column_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest and largest number, or text length, of each column, and its NULL count: one aggregate."""
    measures, structs = [], []
    for i, name in enumerate(columns):
        kind = df.schema[name].dataType.simpleString()
        number = F.length(F.col(f"`{name}`")).cast("double") if kind == "string" else F.col(f"`{name}`").try_cast("double")
        if kind in ("string", "boolean") or kind.startswith(("int", "bigint", "double", "float", "decimal", "smallint", "tinyint")):
            measures += [F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}")]
            low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        else:
            low = high = F.lit(None).cast("double")
        measures.append(F.count_if(F.col(f"`{name}`").isNull()).alias(f"n{i}"))
        declared = "timestamp" if kind.startswith("timestamp") else "string" if kind == "string" else "date" if kind == "date" else "double"
        structs.append(F.struct(
            F.lit(i + 1).alias("position"), F.lit(name).alias("name"), F.lit(declared).alias("type"),
            low.alias("low"), high.alias("high"), F.col(f"n{i}").alias("null_count"),
        ))
    return df.agg(*measures).select(F.inline(F.array(*structs)))


def rule_suggestions(bounds: DataFrame, existing: DataFrame) -> DataFrame:
    """G1: candidate rules from types and profile that no existing rule text covers.

    Types suggest the checks, the profile gives ranges and lengths their bounds. Checks
    that need knowledge no profile has (patterns, comparisons) are not suggested.
    """
    checks = bounds.withColumn("check_type", F.explode(inferred_checks(F.col("name"), F.col("type"))))
    has_bounds = F.col("low").isNotNull()
    usable = checks.filter(
        F.col("check_type").isin("not_null", "uniqueness") | (F.col("check_type").isin("range", "length") & has_bounds)
    )
    complexity, category = classified(F.col("check_type"), F.lit(1), F.lit(False))
    candidates = usable.select(
        "position", "name", "check_type", complexity.alias("complexity"), category.alias("category"),
        _text(F.col("check_type"), F.col("name"), _number(F.col("low")), _number(F.col("high"))).alias("business_rule"),
    )
    return new_rules_only(candidates, existing)
