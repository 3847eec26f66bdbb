"""Exports (S6-S8). Every export is written by the executors, never gathered first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.sources.tables import CSV_OPTIONS


class ExportError(ValueError):
    """An export without the rows or ids it needs."""


def export_failed(failed: DataFrame | None, path: str, id_column: str | None, failed_ids: Sequence) -> None:
    """Write all failed rows as CSV with a header (ids must have been found first)."""
    if failed is None:
        raise ExportError("No failed records found.")
    if not failed_ids:
        raise ExportError("No failed IDs provided.")
    if not id_column or id_column not in failed.columns:
        raise ExportError(f"ID column '{id_column}' not found in dataset.")
    failed.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def export_remediated(remediated: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write a repaired table."""
    writer = remediated.write.mode("overwrite")
    if file_format == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(file_format).save(path)


def export_id_lists(lists: DataFrame, path: str) -> None:
    """Write passed and failed id lists as JSON records, one per rule and chunk."""
    lists.select(
        F.col("rule").alias("Rule"), "chunk",
        F.col("passed_records").alias("Passed_records"), F.col("failed_records").alias("Failed_records"),
    ).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append run-log or remediation-log rows to a stored log."""
    rows.write.mode("append").parquet(path)
