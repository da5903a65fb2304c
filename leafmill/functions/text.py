"""Text expressions that behave as Python's do on Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def word_count(text: Column) -> Column:
    """Runs of letters, digits and underscores; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")), F.lit(0))


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """The first match of ``pattern`` replaced, Java syntax; the text as it is without one.

    The pattern is widened to take the rest of the text, so that replacing all
    matches replaces one.
    """
    groups = F.regexp_replace(text, rf"(?s)(?:{pattern})(?<leafrest>.*)\z", replacement + "${leafrest}")
    return F.when(text.rlike(pattern), groups).otherwise(text)
