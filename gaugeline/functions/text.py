"""Scalar text functions on Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fallback slug, the slug prefix and the run-log time format.
EMPTY_SLUG = "dq_rule"
CHECK_PREFIX = "dq_"
RUN_TIME_FORMAT = "dd MMM yyyy HH:mm:ss"


def slug(value: Column) -> Column:
    """Trimmed lower-case text, runs of other characters as one ``_``, never empty."""
    lowered = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""))
    joined = F.regexp_replace(lowered, r"[^a-zA-Z0-9_]+", "_")
    return F.coalesce(F.nullif(F.trim(joined, F.lit("_")), F.lit("")), F.lit(EMPTY_SLUG))


def check_name(value: Column) -> Column:
    """Name of the check built for a rule."""
    return F.concat(F.lit(CHECK_PREFIX), slug(value))


def normalized_name(value: Column) -> Column:
    """Lower case, ``_`` and ``.`` as spaces, other punctuation dropped."""
    return F.regexp_replace(F.translate(F.lower(value), "_.", "  "), "[^a-z0-9 ]", "")


def sanitized_name(value: Column) -> Column:
    """P1 on a column of names: runs of dots and white space become ``_``."""
    return F.regexp_replace(value, r"[.\s]+", "_")


def sanitize(name: str) -> str:
    """P1 for one column name of a schema."""
    return re.sub(r"[.\s]+", "_", name)


def variable_name(value: Column) -> Column:
    """Every character other than a letter, digit or ``_`` becomes ``_``."""
    return F.regexp_replace(value, "[^a-zA-Z0-9_]", "_")


def json_safe_number(value: Column) -> Column:
    """NaN and infinities become NULL."""
    number = value.cast("double")
    unsafe = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~unsafe, number)


def json_safe_time(value: Column) -> Column:
    """Dates and times as ISO text."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")


def to_number(value: Column) -> Column:
    """Text to double, NULL where it is not a number."""
    return value.try_cast("double")


def run_time(value: Column) -> Column:
    """Parse ``02 Jan 2025 15:04:05``; NULL where the text is no such time."""
    return F.try_to_timestamp(value, F.lit(RUN_TIME_FORMAT))


def without_id_assignments(text: Column) -> Column:
    """Drop the lines that assign a literal to the id variable."""
    assigns = r"^\s*id_column\s*=\s*['\"]"
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(assigns)), "\n")


def words(text: Column) -> Column:
    """White-space tokens of a text; an empty list for blank text.

    All white space becomes a space first: splitting at one plain character is several
    times faster than splitting at a pattern.
    """
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")
