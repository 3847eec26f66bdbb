"""Cleaning and reading of JSON replies held in a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_CHECK = "not_null"


def without_fences(text: Column) -> Column:
    """Drop code-fence marks and surrounding white space."""
    bare = F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def outer_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; the whole text when there is no such span."""
    body = without_fences(text)
    span = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.coalesce(F.nullif(span, F.lit("")), body)


def outer_array(text: Column) -> Column:
    """From the first ``[`` to the last ``]``, after writing out ``[v for _ in range(n)]``."""
    body = expanded_ranges(without_fences(text))
    span = F.regexp_extract(body, r"(?s)\[.*\]", 0)
    return F.coalesce(F.nullif(span, F.lit("")), body)


def expanded_ranges(text: Column) -> Column:
    """Write ``[v for _ in range(n)]`` out as a list of n values, at every occurrence."""
    pattern = r"\[(\S+)\s+for\s+_\s+in\s+range\((\d+)\)\]"
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    counts = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    between = F.split(text, pattern.replace("(", "(?:", 1).replace(r"(\d+)", r"\d+"), -1)
    written = F.transform(
        F.arrays_zip(values.alias("v"), counts.alias("n")),
        lambda m: F.concat(F.lit("["), F.array_join(F.array_repeat(m["v"], m["n"].cast("int")), ", "), F.lit("]")),
    )
    pieces = F.transform(
        between, lambda part, i: F.concat(part, F.coalesce(F.get(written, i), F.lit("")))
    )
    return F.when(F.size(values) > 0, F.array_join(pieces, "")).otherwise(text)


def parsed_object(text: Column) -> Column:
    """The reply's object as a variant, NULL when it does not parse."""
    return F.try_parse_json(outer_object(text))


def parsed_array(text: Column) -> Column:
    """The reply's array as a variant, NULL when it does not parse."""
    return F.try_parse_json(outer_array(text))


def check_type_or_default(text: Column) -> Column:
    """The check type named in a reply, ``not_null`` when the reply cannot be read.

    A reply that parses but names no check type stays NULL, as it is used unchanged.
    """
    value = parsed_object(text)
    return F.when(value.isNull(), F.lit(DEFAULT_CHECK)).otherwise(F.try_variant_get(value, "$.check_type", "string"))


def parameters_or_default(text: Column) -> Column:
    """The parameters of a reply as JSON text, ``{}`` when the reply cannot be read."""
    value = parsed_object(text)
    return F.when(value.isNull(), F.lit("{}")).otherwise(
        F.to_json(F.try_variant_get(value, "$.parameters", "variant"))
    )
