"""Native text measures shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A word: no character of these.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text; a null is empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def n_words(name: str = "text") -> Column:
    """Number of words of the whole text; 0 for a null."""
    return F.regexp_count(text_of(name), F.lit(WORD)).cast("bigint")
