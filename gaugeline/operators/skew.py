"""Joins and scans that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Hash of a row: the same after a recomputation, unlike a random number."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in (columns or df.columns)])


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join for inner, left, semi and anti joins whose left keys may be hot.

    Spark's adaptive execution splits the partitions of a hot left key while the join runs: no
    scan looks for hot keys before, and both sides are compared in their common type. The
    left columns keep their order, the right side's others follow.
    """
    keys = list(on)
    joined = left.join(right, keys, how)
    others = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in keys]
    return joined.select(*[F.col(f"`{c}`") for c in (*left.columns, *others)])


def spread_rows(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all shuffle partitions, for work that is heavy per row.

    Runtime coalescing goes by bytes and would put many small, expensive rows in one task;
    it leaves an explicit number of partitions alone.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, row_hash(df))
