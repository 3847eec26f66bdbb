"""Run log, remediation log and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.evaluate import pass_rate
from gaugeline.operators.ranking import competition_rank, global_position, latest_per_key, run_label, top_per_group

# A run row: rule_name, passed_count, failed_count, ts (timestamp), error (text or NULL).


def with_pass_rate(runs: DataFrame) -> DataFrame:
    """Pass rate of each run; a run that ended in an error counts as 0."""
    rate = pass_rate(F.col("passed_count"), F.col("failed_count"))
    return runs.withColumn("pass_rate", F.when(F.col("error").isNotNull(), F.lit(0.0)).otherwise(rate))


def run_rows(results: DataFrame, when: Column) -> DataFrame:
    """Run rows of evaluated rules: what the run log, its questions and its documents read.

    A rule that ended in an error has run without rows.
    """
    return results.select(
        F.col("rule").alias("rule_name"), F.coalesce("passed_count", F.lit(0).cast("bigint")).alias("passed_count"),
        F.coalesce("failed_count", F.lit(0).cast("bigint")).alias("failed_count"), when.alias("ts"), "error",
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each rule; of equal times the greater counts stay."""
    return latest_per_key(with_pass_rate(runs), ["rule_name"], ["ts", "failed_count", "passed_count"])


def indexed_rules(rules: DataFrame, order: str) -> DataFrame:
    """1-based position of each rule in file order."""
    return global_position(rules, [order], name="rule_index")


def run_log(rules: DataFrame, runs: DataFrame, compiled: DataFrame) -> DataFrame:
    """Executed rules with their latest result, index, classes and whether a check is compiled.

    ``rules`` has (rule_index, rule_name, category, complexity), ``compiled`` (rule_name, check_type).
    """
    checks = compiled.groupBy("rule_name").agg(F.min("check_type").alias("check_type"))
    return (
        latest_runs(runs).join(rules.select("rule_index", "rule_name", "category", "complexity"), "rule_name")
        .join(checks, "rule_name", "left")
        .select(
            "rule_index", "rule_name", "category", "complexity", "passed_count", "failed_count", "pass_rate", "ts",
            F.col("check_type").isNotNull().alias("has_code"), F.coalesce("check_type", F.lit("")).alias("check_type"),
        )
    )


def run_history(runs: DataFrame) -> DataFrame:
    """RUN-0001, ... in time order for all runs without an error."""
    good = with_pass_rate(runs).filter(F.col("error").isNull())
    placed = global_position(good, ["ts", "rule_name"], name="run_number")
    return placed.withColumn("run_id", run_label(F.col("run_number")))


def average_pass_rate(runs: DataFrame) -> DataFrame:
    """Executed rules and the unweighted mean of their latest pass rates."""
    return latest_runs(runs).agg(
        F.count("*").alias("rules_executed"), F.round(F.coalesce(F.avg("pass_rate"), F.lit(0.0)), 4).alias("avg_pass_rate")
    )


def runs_between(runs: DataFrame, after: Column | None = None, before: Column | None = None) -> DataFrame:
    """Q1: runs strictly after and/or before a time."""
    chosen = runs
    if after is not None:
        chosen = chosen.filter(F.col("ts") > after)
    if before is not None:
        chosen = chosen.filter(F.col("ts") < before)
    return chosen


def runs_on(runs: DataFrame, day: Column) -> DataFrame:
    """Q1: runs of one day, as a time range so that the filter can reach the scan."""
    start = day.cast("date").cast("timestamp_ntz")
    return runs.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))


def most_recent_run(runs: DataFrame) -> DataFrame:
    """Q2: the last run; of equal times the first name."""
    return runs.orderBy(F.col("ts").desc(), F.col("rule_name")).limit(1)


def execution_order(runs: DataFrame) -> DataFrame:
    """Q2: position of each rule's latest run in time."""
    return global_position(latest_runs(runs).select("rule_name", "ts"), ["ts", "rule_name"], name="place")


def extreme_rules(log: DataFrame) -> DataFrame:
    """Q4: the rule with most failed rows and the one with the worst rate (first name on ties)."""
    most = F.min_by("rule_name", F.struct(-F.col("failed_count"), "rule_name"))
    worst = F.min_by("rule_name", F.struct("pass_rate", "rule_name"))
    return log.agg(
        most.alias("most_failures"), F.max("failed_count").alias("failed_count"),
        worst.alias("worst_rate"), F.min("pass_rate").alias("pass_rate"),
    )


def ranked_rules(log: DataFrame) -> DataFrame:
    """Q5: rules ranked by pass rate, best first; equal rates share a rank."""
    return competition_rank(log, "pass_rate", ["rule_name"], descending=True)


def rule_difference(log: DataFrame, first: str, second: str) -> DataFrame:
    """Q6: how much the failures and rates of two rules differ (first minus second)."""
    sign = F.when(F.col("rule_name") == first, 1).when(F.col("rule_name") == second, -1)
    chosen = log.filter(F.col("rule_name").isin(first, second))
    return chosen.agg(
        F.sum(sign * F.col("failed_count")).alias("failed_difference"),
        F.sum(sign * F.col("pass_rate")).alias("rate_difference"),
        F.count("*").alias("n_rules"),
    )


def failed_total(log: DataFrame) -> DataFrame:
    """Q8: failed rows over the latest results."""
    return log.agg(F.coalesce(F.sum("failed_count"), F.lit(0)).alias("total_failed"))


def rules_by_category(rules: DataFrame) -> DataFrame:
    """Number of rules per category with all names in rule order.

    The names are ranked rows, so that a large category is neither one list nor one task: ranks
    are places in the order of the whole table, counted from the category's first.
    """
    named = rules.select(F.coalesce("category", F.lit("unknown")).alias("category"), "rule_index", "rule_name")
    placed = global_position(named, ["category", "rule_index", "rule_name"], name="__place")
    totals = placed.groupBy("category").agg(F.count("*").alias("n_rules"), F.min("__place").alias("__first"))
    return placed.join(totals, "category").select(
        "category", "n_rules", (F.col("__place") - F.col("__first") + 1).cast("int").alias("rank"), "rule_name"
    )


def rules_per_table(rule_tables: DataFrame) -> DataFrame:
    """Q14: number of distinct rules that involve each table, names compared without case."""
    lowered = rule_tables.select(F.lower("table_name").alias("table_name"), "rule_name").distinct()
    return lowered.groupBy("table_name").agg(F.count("*").alias("n_rules"))


def rules_of_table(rule_tables: DataFrame, table: str) -> DataFrame:
    """Q14: rules that involve a table."""
    return rule_tables.filter(F.lower("table_name") == table.lower()).select("rule_name").distinct()


def tables_of_rule(rules: DataFrame, rule_tables: DataFrame, number: int) -> DataFrame:
    """Q14: tables of the n-th rule."""
    chosen = rules.filter(F.col("rule_index") == number).select("rule_name")
    return rule_tables.join(chosen, "rule_name", "left_semi").select("table_name").distinct()


def compiled_status(rules: DataFrame, compiled: DataFrame) -> DataFrame:
    """Q16: every rule with its check type and id column, and whether a check is compiled."""
    return rules.join(compiled, "rule_name", "left").select(
        "rule_name", F.col("check_type").isNotNull().alias("has_code"),
        F.coalesce("check_type", F.lit("")).alias("check_type"), F.coalesce("id_column", F.lit("")).alias("id_column"),
    )


def remediation_totals(log: DataFrame) -> DataFrame:
    """Actions applied, rows changed and ids targeted."""
    return log.agg(
        F.count("*").alias("total_actions"),
        F.coalesce(F.sum("rows_affected"), F.lit(0)).alias("total_rows_fixed"),
        F.coalesce(F.sum("n_ids"), F.lit(0)).alias("total_ids"),
    )


def remediation_history(log: DataFrame) -> DataFrame:
    """Q15: the actions in time order with their number."""
    return global_position(log, ["ts", "rule_name"], name="action")


def table_columns(columns: DataFrame) -> DataFrame:
    """Number of columns of each table."""
    return columns.select("table_name", "column_name").distinct().groupBy("table_name").agg(F.count("*").alias("column_count"))


def dashboard(tables: DataFrame, columns: DataFrame, rules: DataFrame, mapped: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of totals; each total is a scalar subquery of its own."""
    rates = latest_runs(runs)

    def one(df: DataFrame, value: Column) -> Column:
        return df.agg(value.alias("v")).scalar()

    base = rules.agg(F.count("*").alias("total_rules"))
    return base.select(
        one(tables.select("table_name").distinct(), F.count("*")).alias("total_tables"),
        one(columns.select("table_name", "column_name").distinct(), F.count("*")).alias("total_columns"),
        "total_rules",
        one(mapped.select("entity").distinct(), F.count("*")).alias("mapped_entities"),
        one(rates, F.count("*")).alias("executed_rules"),
        one(rates, F.round(F.avg("pass_rate"), 4)).alias("avg_pass_rate"),
    )
