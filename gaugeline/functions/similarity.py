"""Name and vector similarities (M1, M2, T4).

Vector measures are Column expressions. Name similarity needs a longest common subsequence,
which Spark has no function for. Nested higher-order functions can express it but are
interpreted; with many pairs the Arrow functions below were faster, with few slower.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside higher-order functions Spark evaluates a repeated expression every time it
    appears; as an element of a one-element array it is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def name_tokens(normalized: Column) -> Column:
    """Sorted distinct tokens of a normalised name."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(normalized, " "), "")))


def token_key(normalized: Column) -> Column:
    """Sorted distinct tokens of a normalised name as one text."""
    return F.array_join(name_tokens(normalized), " ")


@lru_cache(maxsize=1 << 16)
def _letter_masks(text: str) -> dict[str, int]:
    """For each letter the places it has in the text, as bits."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(text):
        masks[letter] = masks.get(letter, 0) | 1 << i
    return masks


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit operation per letter of ``b``."""
    masks, full = _letter_masks(a), (1 << len(a)) - 1
    state = full
    for letter in b:
        hit = state & masks.get(letter, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


@lru_cache(maxsize=1 << 16)
def _token_set(name: str) -> frozenset[str]:
    return frozenset(name.split())


@lru_cache(maxsize=1 << 18)
def token_set_similarity(a: str, b: str) -> float:
    """M1: token-set similarity, 0 to 1, of two names given as tokens joined by spaces.

    The shared tokens and the two remainders, each sorted and joined, give three pairs of
    texts; the result is the best ratio ``1 - indel distance / summed length`` over them.
    A name that holds the whole other name is a full match.
    """
    left, right = _token_set(a), _token_set(b)
    if not left or not right:
        return 0.0
    shared = left & right
    if shared and (len(shared) == len(left) or len(shared) == len(right)):
        return 1.0
    rest_left, rest_right = " ".join(sorted(left - shared)), " ".join(sorted(right - shared))
    n_left, n_right = len(rest_left), len(rest_right)
    n_shared = len(" ".join(shared))
    gap = 1 if shared else 0
    indel = n_left + n_right - 2 * common_subsequence(rest_left, rest_right)
    whole = 1 - indel / (2 * (n_shared + gap) + n_left + n_right)
    if not shared:
        return whole
    return max(whole, 1 - (1 + n_left) / (2 * n_shared + 1 + n_left), 1 - (1 + n_right) / (2 * n_shared + 1 + n_right))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """M1 of two columns of token keys."""
    return pd.Series([token_set_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pool_similarities(key: pd.Series, pool: pd.Series) -> pd.Series:
    """M1 of a token key with every token key of its pool."""
    return pd.Series([[token_set_similarity(x, y) for y in names] for x, names in zip(key, pool, strict=True)])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine(a: Column, b: Column) -> Column:
    """M2: cosine of two vectors, 0 when either has no length or is missing."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, dot(a, b) / norms), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; all zeros stay zeros and a missing vector stays missing."""
    return bind(F.sqrt(dot(a, a)), lambda norm: F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0))))


def squared_l2(a: Column, b: Column) -> Column:
    """T4: squared Euclidean distance, the order a flat L2 index ranks by."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s)
