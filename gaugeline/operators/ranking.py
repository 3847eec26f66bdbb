"""Orderings: global positions, top rows per group, latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.skew import spread_join
from gaugeline.session import settle

# monotonically_increasing_id() is (partition << 33) + row number in the partition.
_PARTITION_BITS = 33
# Stands for NULL where a key must be joined on.
_NO_KEY = "\u0000"


def global_position(df: DataFrame, order: Sequence[Column | str], name: str = "position", start: int = 1) -> DataFrame:
    """Number all rows in the given total order without gathering them in one task.

    Rows are range-partitioned and sorted; a row's position is its place in its partition
    plus the sizes of the partitions before it. Only the partition sizes are ordered in
    one task: one row per partition, whatever the size of the data.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    marked = settle(ranged.withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__row", _PARTITION_BITS)
    sizes = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    in_part = F.col("__row") - F.shiftleft(F.col("__part"), _PARTITION_BITS)
    return (
        marked.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + in_part + F.lit(start))
        .drop("__part", "__row", "__offset")
    )


def position_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Number the rows of each group from 1, a group of any size spread over all tasks.

    Rows are placed in the order of group, then ``order``, over the whole table; the first place of a group is taken off. The
    group's columns must not be NULL.
    """
    placed = global_position(df, [*group, *order], name="__at")
    first = placed.groupBy(*group).agg(F.min("__at").alias("__first"))
    joined = spread_join(placed, first, list(group))
    return joined.withColumn(name, F.col("__at") - F.col("__first") + 1).drop("__at", "__first")


def competition_rank(df: DataFrame, key: str, tie_break: Sequence[str], descending: bool = True, name: str = "rank") -> DataFrame:
    """``rank() over (order by key)`` for a whole table: equal keys share their first position."""
    ordering = F.col(key).desc() if descending else F.col(key).asc()
    placed = global_position(df, [ordering, *tie_break], name="__place")
    keyed = placed.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit(_NO_KEY)))
    first = keyed.groupBy("__key").agg(F.min("__place").alias(name))
    return spread_join(keyed.select("__key", "__place", *df.columns), first, ["__key"]).drop("__key", "__place")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    Spark turns the ``row_number() <= k`` filter into a limit per group inside each task
    before the shuffle, so a hot group sends at most k rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` per key, by a partially aggregated ``max_by``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    )
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the smallest ``order`` per key (first one wins)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    )
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def pass_rate_band(rate: Column) -> Column:
    """Good from 0.9, fair from 0.7, else poor."""
    return F.when(rate >= 0.9, "good").when(rate >= 0.7, "fair").otherwise("poor")


def score_band(score: Column) -> Column:
    """Strong from 0.7, medium from 0.4, else weak."""
    return F.when(score >= 0.7, "strong").when(score >= 0.4, "medium").otherwise("weak")


def run_label(position: Column) -> Column:
    """RUN-0001, RUN-0002, ... (numbers beyond four digits keep all digits)."""
    digits = position.cast("string")
    return F.concat(F.lit("RUN-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
