"""Similarity of two segments' signatures: no built-in function has this matching, so an Arrow UDF does it.

Where only a threshold is asked for, upper bounds of the ratio come first, as Column expressions: by the lengths, then by
the letters that both have, counted in a few groups. A pair whose bound stays below the threshold is never sent to Python.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters counted together, frequent ones alone; all others are one more group. Any groups give a bound.
GROUPS = (" ", "e", "t", "a", "o", "i", "n", "s", "r", "h", "l", "d", "c", "u", "mfpgwybvkxjqz", "0123", "456789", ".+-*/=")


@lru_cache(maxsize=50_000)
def _ratio(a: str, b: str) -> float:
    """Comparisons of a prompt meet in one task and repeat signatures, so each pair is matched once."""
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def signature_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of (a, b), in this order; 1 for two empty signatures, null for a null."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _ratio_of(matches: Column, a: Column, b: Column) -> Column:
    """As the ratio is computed from the characters in matching blocks, so that a bound is never below it by rounding."""
    return F.lit(2.0) * matches / (F.length(a) + F.length(b))


def histogram(text: Column) -> Column:
    """How many characters of each of :data:`GROUPS`, and of all others, the text has."""
    return F.array(*[F.length(text) - F.length(F.translate(text, g, "")) for g in GROUPS], F.length(F.translate(text, "".join(GROUPS), "")))


def length_bound(a: Column, b: Column) -> Column:
    """The ratio if the shorter text matched whole."""
    return F.when(F.length(a) + F.length(b) == 0, F.lit(1.0)).otherwise(_ratio_of(F.least(F.length(a), F.length(b)), a, b))


def letter_bound(a: Column, b: Column, letters: tuple[Column, Column] | None = None) -> Column:
    """The ratio if all characters matched that both have, by group. ``letters``: both histograms, where they are known."""
    ours, theirs = letters or (histogram(a), histogram(b))
    shared = F.aggregate(F.zip_with(ours, theirs, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return F.when(F.length(a) + F.length(b) == 0, F.lit(1.0)).otherwise(_ratio_of(shared, a, b))


def can_reach(a: Column, b: Column, threshold: float, letters: tuple[Column, Column] | None = None) -> Column:
    """False only if the similarity of a and b is below the threshold; letters are counted only where lengths leave it open."""
    return F.when(length_bound(a, b) < threshold, F.lit(False)).otherwise(letter_bound(a, b, letters) >= threshold)


def near_identical(a: Column, b: Column, threshold: float, letters: tuple[Column, Column] | None = None) -> Column:
    """Whether the similarity of a and b is ``threshold`` or more; false for a null. Only pairs that can reach it, and differ,
    are matched."""
    open_ = (a != b) & can_reach(a, b, threshold, letters)
    matched = signature_similarity(F.when(open_, a), F.when(open_, b)) >= threshold
    return F.coalesce(((a == b) & F.lit(threshold <= 1)) | F.coalesce(matched, F.lit(False)), F.lit(False))
