"""Signals read from question text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and phrases that decide how a question is handled.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
CODE_REQUESTS = (
    "give code", "show code", "display code", "give me code", "show me code",
    "pyspark code for", "generate code for",
)
FOLLOW_UP_STARTS = (
    "it ", "its ", "that ", "this ", "they ", "these ", "those ", "and ", "but ", "so ",
    "also ", "then ", "what about ", "how about ", "what if ",
)
FOLLOW_UP_PHRASES = (
    "the same", "explain in", "tell me more", "give me more", "what does that mean",
    "can you elaborate", "simplify", "in simple",
)
FOLLOW_UP_WHOLE = ("why?", "how?", "when?", "who?", "which?", "explain.", "elaborate.", "more?")
ENUMERATION_WORDS = (
    "list", "give", "show", "tell", "what are", "give me all", "all schema", "all target",
    "schema columns", "target schema columns",
)
ALL_MAPPING_WORDS = (
    "all", "every", "each", "complete", "across all", "for all rules", "all rules",
    "every rule", "full mapping", "all mappings",
)
NUMBER_PREFIX = r"(?i)\brule\s+(?:#\s*|no\.?\s*|number\s*)?"
RULE_NUMBER = NUMBER_PREFIX + r"(\d+)\b"
ORDINAL_RULE = r"(?i)\b(" + "|".join(ORDINALS) + r")\s+rule\b"

# Longer questions than this are neither clear follow-ups nor worth a second look.
SHORT_QUESTION = 4
MIDDLE_QUESTION = 15


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases])


def rule_number(text: Column) -> Column:
    """Number in "rule 3", "rule #3", "rule no. 3"; else of "third rule"; else NULL."""
    digits = F.regexp_extract(text, RULE_NUMBER, 1)
    ordinal = F.lower(F.regexp_extract(text, ORDINAL_RULE, 1))
    place = F.array_position(F.array(*[F.lit(o) for o in ORDINALS]), ordinal)
    return F.when(digits != "", digits.try_cast("bigint")).when(ordinal != "", place)


def follow_up(text: Column, has_history: Column) -> Column:
    """``yes``, ``no`` or ``undecided`` (5 to 15 words and no clear signal)."""
    q = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    n_words = F.size(F.filter(F.split(q, r"\s+"), lambda t: t != ""))
    starts = reduce(or_, [q.startswith(p) for p in FOLLOW_UP_STARTS])
    signal = starts | (n_words <= SHORT_QUESTION) | q.isin(*FOLLOW_UP_WHOLE) | has_any(q, FOLLOW_UP_PHRASES)
    return (
        F.when(~has_history | has_any(q, CODE_REQUESTS), "no")
        .when(signal, "yes")
        .when(n_words <= MIDDLE_QUESTION, "undecided")
        .otherwise("no")
    )


def asks_enumeration(text: Column) -> Column:
    """X11: the question asks to list or show things."""
    return has_any(F.lower(text), ENUMERATION_WORDS)


def asks_all_mappings(text: Column) -> Column:
    """X11: the question is about the mappings of all rules."""
    return has_any(F.lower(text), ALL_MAPPING_WORDS)


def settled_intent(intent: Column, text: Column) -> Column:
    """X11: a structure question that enumerates columns is a column-data question."""
    return F.when((intent == "schema_query") & asks_enumeration(text), "schema_data_query").otherwise(intent)
